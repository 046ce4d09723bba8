"""Directory trees as flat rows: one for each directory and file down to a depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import basename, clean_scope, directory, in_scope, language

DEFAULT_DEPTH = 2


def tree(files: DataFrame, counts: DataFrame | None = None, scope: str = "", depth: int = DEFAULT_DEPTH, source_only: bool = False) -> DataFrame:
    """(path, name, parent, depth, is_dir, language, supported, symbol_count, size_bytes), paths relative to the scope.

    Directories count nothing themselves. With ``source_only``, files in no known language go, and so do directories
    without a known file within the depth (those at the depth limit among them).
    """
    depth, scope = depth if depth > 0 else DEFAULT_DEPTH, clean_scope(scope)
    own = files.filter(in_scope(F.col("path"), scope))
    relative = F.when(F.col("path").startswith(scope + "/"), F.substr(F.col("path"), F.lit(len(scope) + 2))).otherwise(F.col("path")) if scope else F.col("path")
    if counts is not None:
        own = own.join(counts.select("path", F.col("symbol_count").alias("n_")), "path", "left")
    else:
        own = own.withColumn("n_", F.lit(0))
    rows = own.select(relative.alias("path"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), F.coalesce("n_", F.lit(0)).cast("bigint").alias("n_"))
    rows = rows.withColumn("language", F.coalesce(language(F.col("path")), F.lit(""))).withColumn("level", F.size(F.split("path", "/")))
    if source_only:
        rows = rows.filter("language != ''")
    parts = F.split("path", "/")
    leaves = rows.filter(F.col("level") <= depth).groupBy("path").agg(F.max("language").alias("language"), F.max("n_").alias("symbol_count"), F.max("size").alias("size_bytes"), F.max("level").alias("depth"))
    deep = rows.filter("level > 1")
    if source_only:
        deep = deep.filter(F.col("level") <= depth)
    above = F.transform(F.sequence(F.lit(1), F.least(F.col("level") - 1, F.lit(depth))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = deep.select(F.explode(above).alias("path")).distinct()
    dirs = dirs.select("path", F.lit("").alias("language"), F.lit(0).cast("bigint").alias("symbol_count"), F.lit(0).cast("bigint").alias("size_bytes"), F.size(F.split("path", "/")).alias("depth"), F.lit(True).alias("is_dir"))
    out = leaves.withColumn("is_dir", F.lit(False)).unionByName(dirs)
    return out.select(
        "path",
        basename(F.col("path")).alias("name"),
        directory(F.col("path")).alias("parent"),
        "depth",
        "is_dir",
        "language",
        (F.col("language") != "").alias("supported"),
        "symbol_count",
        "size_bytes",
    ).orderBy("path")
