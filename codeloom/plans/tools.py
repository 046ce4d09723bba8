"""The nine tools for assistants: typed inputs, a JSON object out, with an envelope of timing and savings.

Errors are results, not exceptions. A repository is chosen by a path inside it.
"""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from codeloom.functions.identity import session_id
from codeloom.operators import stats
from codeloom.plans.config import Config
from codeloom.plans.repository import Repository
from codeloom.sources import git


class Counters:
    """Calls and tokens of this process."""

    def __init__(self) -> None:
        self.id, self.started, self.calls, self.tokens, self._lock = session_id(), datetime.now(UTC), 0, 0, threading.Lock()

    def record(self, tokens: int) -> None:
        with self._lock:
            self.calls += 1
            self.tokens += tokens

    def snapshot(self) -> dict:
        with self._lock:
            return {"id": self.id, "tokens_saved": self.tokens, "call_count": self.calls, "started_at": self.started.strftime("%Y-%m-%dT%H:%M:%SZ")}


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def resolve_root(path: str, cwd: str) -> str:
    """The git root around a path, else the folder itself."""
    here = os.path.join(cwd, path) if path else cwd
    folder = here if os.path.isdir(here) else os.path.dirname(here)
    return git.root_of(folder) or os.path.abspath(folder)


class Tools:
    def __init__(self, spark: SparkSession, config: Config | None = None, cwd: str | None = None) -> None:
        self.spark, self.config, self.cwd, self.counters = spark, config or Config(), cwd or os.getcwd(), Counters()

    NAMES = ("search", "get", "deps", "outline", "tree", "overview", "env", "diff", "status")

    def call(self, tool: str, **given: object) -> dict:
        """The tool's object with ``metadata``, or ``{"error": ..., "is_error": true}``."""
        began = time.time()
        try:
            if tool not in self.NAMES:
                raise LookupError(f"no such tool: {tool}")
            repo = Repository(self.spark, resolve_root(str(given.pop("path", "") or ""), self.cwd), self.config, must_exist=tool != "env")
            out, tokens = getattr(self, f"_{tool}")(repo, **given)
        except Exception as e:  # noqa: BLE001  every failure becomes a result
            return {"error": f"{tool}: {e}", "is_error": True}
        self.counters.record(tokens)
        elapsed = 1000 * (time.time() - began)
        if tool != "env":
            repo.session = self.counters.id
            repo.record(tool, elapsed, tokens)
        total = rows(repo.savings())[0] if repo.store.exists() else {}
        return out | {"metadata": {"timing_ms": elapsed, "tokens_saved": tokens, "session": self.counters.snapshot(), "repo_total": total}}

    def _search(self, repo: Repository, query: str, kind: str = "", language: str = "", limit: int = 0) -> tuple[dict, int]:
        found = rows(repo.search(query, kind, language, limit=limit))
        return {"symbols": found, "total": len(found)}, stats.saved_by_call("search", len(found))

    def _get(self, repo: Repository, ids: list[str] = (), files: list[str] = (), include_context_lines: int = 0) -> tuple[dict, int]:
        symbols, contents = repo.get(ids or (), files or (), include_context_lines)
        found = rows(symbols)
        return {"symbols": found, "files": rows(contents)}, sum(max(0, stats.FILE_BYTES - len(s.get("source", "").encode())) // 4 for s in found)

    def _deps(self, repo: Repository, id: str, direction: str = "both", depth: int = 1) -> tuple[dict, int]:  # noqa: A002
        found = rows(repo.deps(id, direction or "both", depth))
        calls, callers = ([r for r in found if r["direction"] == d] for d in ("calls", "callers"))
        return {"id": id, "calls": calls, "called_by": callers, "has_dynamic_edges": any(r["confidence"] == "dynamic" for r in calls)}, stats.saved_by_call("deps", len(found))

    def _outline(self, repo: Repository, file: str) -> tuple[dict, int]:
        found = rows(repo.outline(file))
        return {"file": file, "symbols": found}, stats.saved_by_call("outline", len(found))

    def _tree(self, repo: Repository, scope: str = "", depth: int = 0, include_symbol_counts: bool = False) -> tuple[dict, int]:
        return {"root": scope, "nodes": nest(rows(repo.tree(scope, depth, include_symbol_counts)))}, stats.saved_by_call("tree", 0)

    def _overview(self, repo: Repository) -> tuple[dict, int]:
        return rows(repo.overview())[0], stats.saved_by_call("overview", 0)

    def _env(self, repo: Repository) -> tuple[dict, int]:
        files, variables = repo.env()
        found = rows(variables.drop("value"))
        return {"env_files": rows(files), "variables": found, "warnings": [v["warning"] for v in found if v.get("warning")]}, stats.saved_by_call("env", 0)

    def _diff(self, repo: Repository, since: str) -> tuple[dict, int]:
        found = rows(repo.diff(since))
        return {"since": since} | {k: [r for r in found if r["change"] == k] for k in ("added", "modified", "deleted")}, stats.saved_by_call("diff", len(found))

    def _status(self, repo: Repository, verify: bool = False) -> tuple[dict, int]:
        return rows(repo.status(verify))[0], stats.saved_by_call("status", 0)


def nest(nodes: list[dict]) -> list[dict]:
    """Flat tree rows as nested objects, by name."""
    by_path = {n["path"]: n | ({"children": []} if n["is_dir"] else {}) for n in nodes}
    roots = []
    for path in sorted(by_path):
        node = by_path[path]
        home = by_path.get(node.get("parent", ""))
        (home["children"] if home else roots).append(node)
    return roots


def serve(tools: Tools, read: Callable[[], str], write: Callable[[str], None]) -> None:
    """JSON-RPC by lines: ``tools/list`` and ``tools/call`` until the input ends."""
    while line := read():
        if not line.strip():
            continue
        try:
            asked = json.loads(line)
            params = asked.get("params") or {}
            if asked.get("method") == "initialize":
                result: dict = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "codeloom", "version": "0.1"}}
            elif asked.get("method") == "tools/list":
                result = {"tools": [{"name": n, "inputSchema": {"type": "object"}} for n in tools.NAMES]}
            elif asked.get("method") == "tools/call":
                out = tools.call(params.get("name", ""), **(params.get("arguments") or {}))
                result = {"content": [{"type": "text", "text": json.dumps(out)}], "isError": bool(out.get("is_error"))}
            elif "id" not in asked:
                continue
            else:
                write(json.dumps({"jsonrpc": "2.0", "id": asked["id"], "error": {"code": -32601, "message": "no such method"}}) + "\n")
                continue
            write(json.dumps({"jsonrpc": "2.0", "id": asked.get("id"), "result": result}) + "\n")
        except (json.JSONDecodeError, AttributeError, TypeError) as e:
            write(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}) + "\n")
