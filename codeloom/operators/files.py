"""Changes to the relations: every change is a new frame, never an update in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key isn't among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti").select(old.columns)


def replace_by_file(old: DataFrame, new: DataFrame, files: DataFrame, file: str = "file") -> DataFrame:
    """Symbols of ``files`` (one column ``file``) replaced by ``new``, which may have none for a file."""
    kept = old.join(files.select(F.col(file)).distinct(), file, "left_anti").select(old.columns)
    return kept.unionByName(new.select(old.columns))


def dedup_edges(edges: DataFrame, order: Sequence[str | Column] = ("confidence",)) -> DataFrame:
    """The first edge of each (caller, callee), or of each (caller, raw expression) if the callee is unknown.

    ``order`` says which is first; with a total order the result is the same in every run.
    """
    resolved = F.col("callee_id").isNotNull()
    key = F.when(resolved, F.col("callee_id")).otherwise(F.col("raw_expression"))
    names = [c for c in edges.columns if c not in ("caller_id",)]
    rank = F.struct(*order, *(F.col(c) for c in names))
    first = edges.groupBy("caller_id", resolved.alias("resolved_"), key.alias("key_")).agg(F.min_by(F.struct(*names), rank).alias("row_"))
    return first.select("caller_id", *(F.col("row_")[c].alias(c) for c in names)).select(edges.columns)


def sure(edges: DataFrame) -> DataFrame:
    """An empty confidence becomes static."""
    return edges.withColumn("confidence", F.when(F.coalesce("confidence", F.lit("")) == "", F.lit("static")).otherwise(F.col("confidence")))


def replace_edges(old: DataFrame, new: DataFrame, callers: DataFrame) -> DataFrame:
    """Edges of ``callers`` (column ``id``) replaced; an empty confidence becomes static."""
    kept = old.join(callers.select(F.col("id").alias("caller_id")).distinct(), "caller_id", "left_anti").select(old.columns)
    return dedup_edges(kept.unionByName(sure(new).select(old.columns)))


def mark_unresolved(symbols: DataFrame, files: DataFrame, file: str = "file") -> DataFrame:
    """``possible_unresolved`` set for the symbols of ``files``."""
    hit = files.select(F.col(file)).distinct().withColumn("hit_", F.lit(True))
    flag = F.coalesce("hit_", F.lit(False)) | F.coalesce("possible_unresolved", F.lit(False))
    return symbols.join(hit, file, "left").withColumn("possible_unresolved", flag).drop("hit_").select(symbols.columns)


def unresolved_callers(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Symbols that call a deleted one: (id)."""
    return edges.join(deleted.select(F.col("id").alias("callee_id")).distinct(), "callee_id", "left_semi").select(F.col("caller_id").alias("id")).distinct()


def changes(walk: DataFrame, files: DataFrame) -> DataFrame:
    """Each walked file with ``status`` new, changed or same.

    A file with a hash changes with it; without one it changes with its size, then its modification time.
    """
    old = files.select("path", F.col("blob_sha").alias("old_sha"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("known_"))
    has_sha = (F.coalesce("blob_sha", F.lit("")) != "") & (F.coalesce("old_sha", F.lit("")) != "")
    by_stat = ~(F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime")))
    changed = F.when(has_sha, F.col("blob_sha") != F.col("old_sha")).otherwise(by_stat)
    status = F.when(F.col("known_").isNull(), F.lit("new")).when(changed, F.lit("changed")).otherwise(F.lit("same"))
    return walk.join(old, "path", "left").withColumn("status", status).select(*walk.columns, "status")


def deleted(walk: DataFrame, files: DataFrame) -> DataFrame:
    return files.join(walk.select("path"), "path", "left_anti").select(files.columns)


def mirror(store: DataFrame, new: DataFrame) -> DataFrame:
    """Contents not yet stored, once each: to be appended."""
    return new.select("blob_sha", "content").dropDuplicates(["blob_sha"]).join(store.select("blob_sha"), "blob_sha", "left_anti")


def outline(symbols: DataFrame, file: str, file_col: str = "file", columns: Sequence[str] | None = None, order: Sequence[str] = ("line_start", "byte_start", "id")) -> DataFrame:
    """The symbols of one file in order; none for an unknown file."""
    columns = columns or ["id", "kind", "name", "signature", "line_start", "line_end", "depth"]
    return symbols.filter(F.col(file_col) == file).orderBy(*order).select(*columns)


def by_ids(df: DataFrame, ids: Sequence, key: str = "id") -> DataFrame:
    """Rows of these ids; unknown ids are skipped."""
    return df.filter(F.col(key).isin(list(ids)))


def by_path(files: DataFrame, path: str) -> DataFrame:
    """The file of this path; no row for an unknown one."""
    return files.filter(F.col("path") == path)


def filtered(df: DataFrame, **equal: object) -> DataFrame:
    """Equality on each column whose value isn't empty, so that only real predicates reach the scan."""
    for column, value in equal.items():
        if value not in (None, ""):
            df = df.filter(F.col(column) == value)
    return df


def listed(files: DataFrame) -> DataFrame:
    """Files by path."""
    return files.orderBy("path")


def capped(walk: DataFrame, limit: int, key: str = "path") -> DataFrame:
    """The first files by path."""
    return walk.orderBy(key).limit(limit)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place_", place).filter("place_ = 1").drop("place_")
