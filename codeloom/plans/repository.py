"""The queries of a repository: each returns frames over its store."""

from __future__ import annotations

import os
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import security, units
from codeloom.functions.identity import session_id
from codeloom.operators import diff, envs, files, graph, retrieve, search, stats, tree
from codeloom.plans import index as indexing
from codeloom.plans import store as stores
from codeloom.plans.config import Config
from codeloom.sources import filesystem, git


class NotIndexedError(LookupError):
    """The repository has no index yet."""


class Repository:
    """One indexed source tree."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, must_exist: bool = False) -> None:
        self.spark, self.root, self.config = spark, os.path.abspath(root), config or Config()
        self.store = stores.Store(spark, self.config.cache_root, root, self.config.cache_shared)
        self.session = session_id()
        if must_exist and not self.store.exists():
            raise NotIndexedError(f"{self.root} is not indexed: run index first")

    def index(self, force: bool = False, describe=None) -> indexing.IndexResult:
        return indexing.index(self.spark, self.root, self.config, force, describe)

    def sync(self) -> indexing.IndexResult:
        return indexing.sync(self.spark, self.root, self.config)

    @property
    def files(self) -> DataFrame:
        return self.store.read("files")

    @property
    def symbols(self) -> DataFrame:
        return self.store.read("symbols")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("edges")

    def search(self, q: str, kind: str = "", language: str = "", file: str = "", limit: int = search.DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
        keyed = self.symbols.withColumn("row_", indexing.row_key())
        found = search.search(keyed, self.store.search_index(), q, "row_", ("name", "qualified_name"), limit, offset, {"kind": kind, "language": language, "file": file})
        return found.drop("row_")

    def get(self, ids: Sequence[str] = (), paths_: Sequence[str] = (), context: int = 0) -> tuple[DataFrame, DataFrame]:
        """(symbols with source, files with content). A path outside the root is an error; redacted files show no content."""
        wanted = files.by_ids(self.symbols, ids) if ids else self.symbols.limit(0)
        texts = filesystem.contents(wanted.select(F.col("file").alias("path")).distinct(), self.root)
        context = min(max(context, 0), retrieve.MAX_CONTEXT)
        symbols = retrieve.with_source(wanted, texts, context).withColumn("context_lines", F.lit(context))
        for p in paths_:
            if not security.safe_path(self.root, p):
                raise FileNotFoundError(p)
        listed = self.spark.createDataFrame([(p,) for p in paths_], "path string")
        hidden = security.tier(F.col("path"), self.config.extra_ignore_filenames, self.config.extra_secret_filenames) != security.NORMAL
        out = retrieve.shown(filesystem.contents(listed, self.root), hidden)
        return symbols, out

    def deps(self, symbol: str, direction: str = "both", depth: int = 1) -> DataFrame:
        return graph.trace(self.edges, self.symbols, symbol, direction, depth)

    def outline(self, file: str) -> DataFrame:
        return files.outline(self.symbols, file)

    def tree(self, scope: str = "", depth: int = tree.DEFAULT_DEPTH, counts: bool = True, source_only: bool = False) -> DataFrame:
        return tree.tree(self.files, stats.symbols_by_file(self.symbols) if counts else None, scope, depth, source_only)

    def overview(self) -> DataFrame:
        meta = self.store.meta() or {}
        row = stats.overview(self.files, self.symbols)
        return row.withColumns({"repo": F.lit(meta.get("name", "")), "index_age_seconds": self._age(), "last_indexed_commit": F.lit(meta.get("last_indexed_commit") or "")})

    def _age(self):
        meta = self.store.meta() or {}
        return units.age_seconds(F.to_timestamp(F.lit(meta.get("last_sync"))))

    def env(self) -> tuple[DataFrame, DataFrame]:
        """(files looked for, variables)."""
        found, lines = filesystem.env_lines(self.spark, self.root)
        return found, envs.variables(lines)

    def diff(self, since: str) -> DataFrame:
        changed = diff.parse_name_status(git.name_status(self.spark, self.root, since))
        return diff.diff_files(self.symbols, changed).select("id", "kind", "qualified_name", "file", "signature", "change").orderBy("change", "file", "id")

    def status(self, verify: bool = False) -> DataFrame:
        meta = self.store.meta() or {}
        row = stats.status(self.symbols, self.files, self.edges)
        commit = meta.get("last_indexed_commit")
        row = row.withColumns({"mode": F.lit(meta.get("mode", "filesystem")), "index_age_seconds": self._age(), "commit_valid": F.lit(git.reachable(self.root, commit) if commit else None).cast("boolean")})
        if verify:
            texts = filesystem.contents(self.files.select("path"), self.root)
            row = row.crossJoin(retrieve.verify(self.symbols.filter("content_hash is not null"), texts))
        return row

    def savings(self, session: str | None = None) -> DataFrame:
        return stats.savings(self.store.savings(), session)

    def sessions(self, top: int | None = None) -> DataFrame:
        ledger = self.store.savings()
        return stats.sessions(ledger) if top is None else stats.top_sessions(ledger, top)

    def record(self, tool: str, timing_ms: float, tokens: int) -> None:
        """One row for the ledger; calls that save nothing leave none."""
        if tokens > 0:
            row = [(self.session, tool, time.time(), timing_ms, tokens)]
            self.store.append_savings(self.spark.createDataFrame(row, "session_id string, tool_name string, t double, timing_ms double, tokens_saved long").withColumn("call_at", F.timestamp_seconds("t")))
