"""The store of a repository: a log of segments for its relations and its inverted index, and what lies beside it.

The cache folder is a path or the URL of any file system that Spark knows. On a cluster a path of one machine is refused,
unless the configuration says that all machines share it.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from codeloom import schemas
from codeloom.functions.identity import repo_hash
from codeloom.operators import search
from codeloom.plans.segments import Change, Log, Manifest, Table
from codeloom.sources.storage import is_local, storage

#: Columns of the inverted index.
INDEXED = ["name", "qualified_name", "signature", "summary"]
#: ``unread`` are files that were looked at but hold nothing to index: binary, too large or unreadable ones; ``calls`` are
#: edges as parsed.
#: A change of the index names files, whose path is the second part of a row's key.
_OWNER = "element_at(split(id, '\\0'), 2)"
TABLES = {
    "files": Table(schemas.FILES, "path", "path"),
    "symbols": Table(schemas.SYMBOLS, "file", "file"),
    "edges": Table(schemas.EDGES, "caller_id", "caller_id"),
    "calls": Table(schemas.CALLS, "file", "file"),
    "unread": Table(schemas.FILES, "path", "path"),
    "postings": Table(search.POSTINGS, _OWNER, "term", search.BY_TERM),
    "lengths": Table(search.LENGTHS, _OWNER, "id", ("id",)),
}


class VersionError(RuntimeError):
    """The store was written by a newer version."""


class Store:
    """The relations of one repository below a cache folder that driver and executors share."""

    def __init__(self, spark: SparkSession, cache_root: str, repo: str, shared: bool = False) -> None:
        master = spark.sparkContext.master
        if is_local(cache_root) and not shared and master != "local" and not master.startswith("local["):
            raise ValueError(f"{cache_root} is a folder of one machine: name a URL that all executors see, or set cache_shared")
        self.spark, self.cache_root, self.repo = spark, cache_root, os.path.abspath(repo)
        self.hash = repo_hash(repo)
        self.storage = storage(cache_root, spark)
        self.log = Log(spark, self.storage, self.hash, TABLES)

    def at(self, name: str) -> str:
        return f"{self.hash}/{name}"

    def url(self, name: str) -> str:
        return self.storage.url(self.at(name))

    def create(self) -> None:
        self.storage.make(self.at("manifests"))
        self.version()

    def version(self) -> int:
        """The schema version; a new store gets this one, and what an older version kept is dropped to be built anew."""
        name = self.at("version")
        found = int(self.storage.read_text(name)) if self.storage.exists(name) else 0
        if found > schemas.VERSION:
            raise VersionError(f"schema version {found} is newer than {schemas.VERSION}")
        if found < schemas.VERSION:
            for old in ("snapshots", "CURRENT"):
                self.storage.delete(self.at(old))
            self.storage.write_text(name, str(schemas.VERSION))
        return schemas.VERSION

    def exists(self) -> bool:
        return bool(self.log.numbers())

    def read(self, relation: str, manifest: Manifest | None = None) -> DataFrame:
        return self.log.read(relation, manifest)

    def search_index(self, manifest: Manifest | None = None) -> search.TextIndex:
        """The inverted index of the present state."""
        manifest = manifest or self.log.current()
        return search.TextIndex(self.log.read("postings", manifest), self.log.read("lengths", manifest), INDEXED)

    def write(self, base: Manifest, changes: dict[str, Change]) -> Manifest:
        """Commits these changes of ``base``, and merges segments where that is due."""
        self.log.commit(self.log.stage(base, changes))
        return self.log.compact()

    def _appended(self, name: str, schema: str) -> DataFrame:
        if not self.storage.exists(self.at(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.url(name))

    def contents(self) -> DataFrame:
        return self._appended("files", schemas.CONTENTS)

    def append_contents(self, new: DataFrame) -> None:
        new.select(schemas.names(schemas.CONTENTS)).write.mode("append").parquet(self.url("files"))

    def savings(self) -> DataFrame:
        return self._appended("savings", schemas.SAVINGS)

    def append_savings(self, rows: DataFrame) -> None:
        rows.select(schemas.names(schemas.SAVINGS)).write.mode("append").parquet(self.url("savings"))

    def meta(self) -> dict | None:
        name = self.at("meta.json")
        return json.loads(self.storage.read_text(name)) if self.storage.exists(name) else None

    def write_meta(self, **values: object) -> None:
        self.storage.write_text(self.at("meta.json"), json.dumps((self.meta() or {}) | values, indent=2))


# --- the manifest of repositories, and the cache


def manifest(cache_root: str) -> list[dict]:
    at = storage(cache_root)
    return json.loads(at.read_text("repos.json")) if at.exists("repos.json") else []


def _write_manifest(cache_root: str, rows: list[dict]) -> None:
    storage(cache_root).write_text("repos.json", json.dumps(rows, indent=2))


def upsert_repo(cache_root: str, entry: dict) -> None:
    rows = [r for r in manifest(cache_root) if r["hash"] != entry["hash"]]
    _write_manifest(cache_root, sorted([*rows, entry], key=lambda r: r["hash"]))


def cache_status(cache_root: str) -> dict:
    at = storage(cache_root)
    repos = [r | {"size_bytes": at.size(r["hash"])} for r in manifest(cache_root)]
    return {"repos": repos, "total_bytes": sum(r["size_bytes"] for r in repos)}


def invalidate(cache_root: str, repo: str) -> bool:
    """Drops a repository's data but keeps it in the manifest."""
    at, own = storage(cache_root), repo_hash(repo)
    there = at.exists(own)
    at.delete(own)
    return there


def remove(cache_root: str, repo: str) -> bool:
    own = repo_hash(repo)
    there = invalidate(cache_root, repo)
    _write_manifest(cache_root, [r for r in manifest(cache_root) if r["hash"] != own])
    return there


def clear(cache_root: str) -> int:
    rows = manifest(cache_root)
    for r in rows:
        storage(cache_root).delete(r["hash"])
    if rows:
        _write_manifest(cache_root, [])
    return len(rows)


def prune(cache_root: str, older_than_s: float, now: float | None = None) -> list[str]:
    """Drops repositories without an index, or whose index is older than the limit."""
    at, cutoff, gone, kept = storage(cache_root), (time.time() if now is None else now) - older_than_s, [], []
    for r in manifest(cache_root):
        manifests = at.children(f"{r['hash']}/manifests")
        if not manifests or at.modified(f"{r['hash']}/manifests/{manifests[-1]}") < cutoff:
            at.delete(r["hash"])
            gone.append(r["hash"])
        else:
            kept.append(r)
    if gone:
        _write_manifest(cache_root, kept)
    return gone
