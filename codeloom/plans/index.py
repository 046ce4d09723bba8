"""Indexing: walk, compare, read, parse, resolve, commit the changes. A full build and a change run are one plan."""

from __future__ import annotations

import logging
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.functions import identity, paths, security, text
from codeloom.operators import enrich, files, graph, ignore, search
from codeloom.parsers.parse import parse_files
from codeloom.plans import store as stores
from codeloom.plans.config import Config
from codeloom.plans.segments import Change, ConflictError
from codeloom.session import shared_folder
from codeloom.sources import filesystem, git
from codeloom.sources.storage import HadoopStorage


#: Runs that are started over because another one has committed first.
ATTEMPTS = 5


@dataclass
class IndexResult:
    """What an index run did."""

    indexed: int
    skipped: int
    deleted: int
    symbols: int
    edges: int
    warnings: list[str]
    mode: str
    seconds: float


def walk(spark: SparkSession, root: str, config: Config) -> tuple[str, DataFrame]:
    """(mode, files): git's list inside a work tree, else the folder's; ignored tiers and rules are left out."""
    use_git = (git.version() or (0, 0)) >= (2, 25) and git.root_of(root) is not None
    stat = filesystem.listing(spark, root, config.extra_ignore_filenames)
    if use_git:
        listed = git.walk(spark, root)
        lines = [line for name in filesystem.IGNORE_FILES[1:] for line in filesystem.read_lines(os.path.join(root, name))]
        rules = ignore.rules_table(spark, (("", k, line) for k, line in enumerate(lines)))
        listed = listed.filter(~paths.is_excluded(F.col("path"), config.extra_ignore_filenames))
        listed = ignore.with_ignored(listed, rules).filter("not ignored").drop("ignored")
        found = listed.join(stat, "path", "left")
    else:
        found = stat.withColumns({"blob_sha": F.lit(None).cast("string"), "untracked": F.lit(False)})
    found = found.filter(security.tier(F.col("path"), config.extra_ignore_filenames, config.extra_secret_filenames) != security.IGNORED)
    return ("git" if use_git else "filesystem"), found.select("path", "blob_sha", "mtime", "size", "untracked")


def symbols_and_edges(contents: DataFrame, all_files: DataFrame, config: Config, stamp: str, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, edges and parse errors of files (path, language, content, untracked). The contents go no further than the parser.

    ``keep`` holds what is used more than once.
    """
    parsed = keep(parse_files(contents, [*security.SECRET_PATTERNS, *config.extra_secret_patterns]))
    tier = security.tier(F.col("file"), config.extra_ignore_filenames, config.extra_secret_filenames)
    homes = paths.with_package_root(all_files.select("path")).select(F.col("path").alias("file"), "package_root")
    rows = parsed.filter("record = 'symbol'").select("secret", *[c for c in schemas.names(schemas.PARSED) if c in schemas.names(schemas.SYMBOLS)])
    rows = rows.join(contents.select(F.col("path").alias("file"), "language", "untracked"), "file").join(homes, "file", "left")
    rows = redacted(rows, (tier == security.REDACTED), F.col("secret"))
    none = F.lit(None)
    rows = rows.withColumns({"children": none.cast("array<string>"), "imports": none.cast("array<string>"), "possible_unresolved": F.lit(False), "indexed_at": F.lit(stamp)})
    edges = parsed.filter("record = 'edge'").select("file", "caller_id", F.lit(None).cast("string").alias("callee_id"), "raw_expression", "confidence")
    return rows.select(schemas.names(schemas.SYMBOLS)), edges, parsed.filter("record = 'error'").select("file", "error")


def redacted(rows: DataFrame, hidden_file: Column, secret: Column) -> DataFrame:
    """Symbols of hidden files and secret ones without offsets and hash, so that no source is shown; secret ones are tagged."""
    shown = ~(hidden_file | secret)
    return rows.withColumns(
        {
            "content_hash": F.when(shown, F.col("content_hash")),
            "byte_start": F.when(shown, F.col("byte_start")),
            "byte_end": F.when(shown, F.col("byte_end")),
            "summary": F.when(secret, F.lit("[redacted]")).otherwise(F.col("summary")),
            "tags": F.when(secret, F.array(F.lit("secret"))).otherwise(F.lit(None).cast("array<string>")),
        }
    )


def row_key() -> Column:
    """Symbols may share an id, so the index names a row by id, file and place."""
    return F.concat_ws("\0", "id", "file", F.coalesce(F.col("byte_start"), F.lit(-1)).cast("string"), F.col("line_start").cast("string"), "kind")


def edge_changes(old_edges: DataFrame, old_calls: DataFrame, calls: DataFrame, old_symbols: DataFrame, symbols: DataFrame, new_symbols: DataFrame, touched: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[Change, Change]:
    """The edges of the callers that are new, gone, or whose calls now mean something else; and the calls as parsed.

    A call is resolved by a name that only one symbol has, so only calls of names that a touched file had or has can change.
    Edges are made from the calls, which are kept by file: calls of one callee are one edge but may be several again when its
    name is no longer unique, and symbols of several files may share an id.
    """
    stale = keep(old_symbols.join(touched, "file", "left_semi").select("id", "name"))
    names = keep(stale.select("name").unionByName(symbols.select("name")).distinct())
    owners = stale.select(F.col("id").alias("caller_id")).unionByName(calls.select("caller_id")).distinct()
    called = text.callee_name(F.col("raw_expression"))
    among = new_symbols.select("name", "id").join(names, "name", "left_semi")
    asked = old_edges.filter("raw_expression is not null").join(owners, "caller_id", "left_anti")
    asked = asked.withColumns({"was": F.col("callee_id"), "name": called}).join(names, "name", "left_semi")
    now = graph.resolve(asked.withColumn("callee_id", F.lit(None).cast("string")), among, F.col("name"))
    changed = now.filter(~F.col("callee_id").eqNullSafe(F.col("was"))).select("caller_id")
    callers = keep(owners.unionByName(changed).distinct())
    live = files.replace_by_file(old_calls, calls, touched).join(callers, "caller_id", "left_semi").select(old_edges.columns)
    # a call of such a caller may be of any name, so all symbols are asked
    fresh = files.dedup_edges(graph.resolve(files.dedup_edges(files.sure(live)), new_symbols.select("name", "id"), called).drop("resolved"))
    return Change(fresh, callers), Change(calls, touched)


def index(spark: SparkSession, root: str, config: Config | None = None, force: bool = False, describe=None) -> IndexResult:
    """Brings the repository's store up to date; if another run commits first, starts again from what it left."""
    config = config or Config()
    for _ in range(ATTEMPTS - 1):
        try:
            return _index(spark, root, config, force, describe)
        except ConflictError as e:
            logging.getLogger(__name__).info("%s", e)
    return _index(spark, root, config, force, describe)


def _index(spark: SparkSession, root: str, config: Config, force: bool, describe) -> IndexResult:
    """One attempt. What is used more than once is written to the shared folder, which also keeps the plans small, or cached."""
    folder, cached = shared_folder(spark, "index"), []

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def cache(df: DataFrame) -> DataFrame:
        cached.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return cached[-1]

    try:
        return _index_once(spark, root, config, force, describe, keep, cache)
    finally:
        for df in cached:
            df.unpersist()
        HadoopStorage(spark, folder).delete("")


def _index_once(spark: SparkSession, root: str, config: Config, force: bool, describe, keep: Callable[[DataFrame], DataFrame], cache: Callable[[DataFrame], DataFrame]) -> IndexResult:
    began = time.time()
    stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(began))
    store = stores.Store(spark, config.cache_root, root, config.cache_shared)
    store.create()
    base = store.log.current()
    mode, found = walk(spark, root, config)
    found = keep(found)
    old_files, old_symbols, old_edges, old_unread = (store.read(r, base) for r in ("files", "symbols", "edges", "unread"))
    old_all = old_files.unionByName(old_unread)
    looked = files.changes(found, old_all)
    pending = keep(looked if force else looked.filter("status != 'same'"))
    todo = pending
    if not force:  # a change within the second of the last run doesn't show in the time: such files are read again
        before = old_all.select("path", F.col("last_indexed").alias("before"))
        todo = todo.unionByName(looked.filter("status = 'same' and blob_sha is null").join(before, "path").filter("mtime >= before").select(todo.columns))
    # those known to have changed come first; the rest is still new or changed next time
    todo = todo.withColumn("late", (F.col("status") == "same") if not force else F.lit(False)).orderBy("late", "path").limit(config.max_files).drop("late")
    todo = keep(todo)
    read = filesystem.contents(todo, root, config.max_file_bytes)
    usable = F.col("content").isNotNull() & ~security.is_binary(F.col("content"))
    sha = F.coalesce("blob_sha", identity.blob_sha(F.col("content")))
    read = cache(read.withColumns({"blob_sha": sha, "language": paths.language(F.col("path")), "usable": F.coalesce(usable, F.lit(False))}))
    known = old_files.select("path", F.col("blob_sha").alias("was"))
    changed = read.filter("usable")
    if not force:  # a file may have been touched only
        changed = changed.join(known, "path", "left").filter(~F.col("blob_sha").eqNullSafe(F.col("was"))).drop("was")
    changed = cache(changed)
    gone = files.deleted(found, old_files).select("path").unionByName(read.filter("not usable").join(known, "path", "left_semi").select("path"))
    touched = keep(changed.select(F.col("path").alias("file")).unionByName(gone.select(F.col("path").alias("file"))).distinct())

    symbols, edges, errors = symbols_and_edges(changed, found, config, stamp, keep)
    if describe is not None:
        texts = changed.select(F.col("path").alias("file"), "content")
        source = F.decode(identity.byte_slice(F.col("content"), F.col("byte_start"), F.col("byte_end")), "UTF-8")
        symbols = enrich.enrich(symbols.join(texts, "file").withColumn("source", source).drop("content"), describe).drop("source")
    symbols, edges = keep(symbols), keep(edges)
    stale = keep(old_symbols.join(touched, "file", "left_semi").select("id").distinct())
    new_symbols = files.replace_by_file(old_symbols, symbols, touched)
    lost = stale.join(new_symbols.select("id"), "id", "left_anti")
    flagged = files.unresolved_callers(old_edges, lost).join(symbols.select("id"), "id", "left_anti")  # parsing clears the flag
    flagged = keep(old_symbols.filter("not possible_unresolved").join(touched, "file", "left_anti").join(flagged, "id", "left_semi").select("id", "file"))
    beside = flagged.select("file").distinct()  # their files are written again, with the flags
    hit = flagged.select("id").distinct().withColumn("hit_", F.lit(True))
    flagged_rows = old_symbols.join(beside, "file", "left_semi").join(hit, "id", "left").withColumn("possible_unresolved", F.coalesce("hit_", "possible_unresolved")).select(symbols.columns)
    new_rows = read.select("usable", "path", "blob_sha", "mtime", "size", F.lit(stamp).alias("last_indexed"))
    good, bad = new_rows.filter("usable").drop("usable"), new_rows.filter("not usable").drop("usable")
    fresh = search.build_index(symbols.withColumn("row_", row_key()), "row_", stores.INDEXED)
    changed_edges, changed_calls = edge_changes(old_edges, store.read("calls", base), edges, old_symbols, symbols, new_symbols, touched, keep)
    changes = {
        "files": Change(good, gone.select("path").unionByName(good.select("path"))),
        "unread": Change(bad, old_unread.join(found.select("path"), "path", "left_anti").select("path").unionByName(new_rows.select("path"))),
        "symbols": Change(symbols.unionByName(flagged_rows), touched.unionByName(beside)),
        "edges": changed_edges,
        "calls": changed_calls,
        "postings": Change(fresh.postings, touched),
        "lengths": Change(fresh.lengths, touched),
    }

    n_found, n_pending, n_changed, n_gone = found.count(), pending.count(), changed.count(), gone.count()
    warnings = [f"{r.file}: {r.error}" for r in errors.orderBy("file").limit(100).collect()]
    if n_pending > config.max_files:
        warnings.append(f"limit of {config.max_files} files reached: {n_pending - config.max_files} files are left for the next run")
        logging.getLogger(__name__).warning("%s", warnings[-1])
    store.append_contents(files.mirror(store.contents(), changed))
    state = store.write(base, changes)
    store.write_meta(
        hash=store.hash, path=store.repo, name=store.repo.rsplit("/", 1)[-1], mode=mode, last_sync=stamp, initialized_at=(store.meta() or {}).get("initialized_at", stamp), last_indexed_commit=git.head(root) if mode == "git" else None
    )
    stores.upsert_repo(config.cache_root, {"hash": store.hash, "path": store.repo, "name": store.repo.rsplit("/", 1)[-1], "last_indexed": stamp})
    return IndexResult(n_changed, max(0, n_found - n_changed), n_gone, store.read("symbols", state).count(), store.read("edges", state).count(), warnings, mode, time.time() - began)


def sync(spark: SparkSession, root: str, config: Config | None = None) -> IndexResult:
    return index(spark, root, config, force=False)
