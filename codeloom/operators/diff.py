"""Differences: by file status, and by comparing two snapshots of the symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_name_status(lines: DataFrame, line: str = "value") -> DataFrame:
    """(path, status) from lines of status and paths: the first letter, the last field; blank lines go.

    Fields stand between tabs, as paths may hold blanks; a line without tabs is split at white space.
    """
    fields = F.when(F.col(line).contains("\t"), F.split(F.col(line), r"\t+")).otherwise(F.split(F.trim(F.col(line)), r"\s+"))
    rows = lines.filter(F.trim(F.col(line)) != "").filter(F.size(fields) >= 2)
    return rows.select(F.element_at(fields, -1).alias("path"), F.substring(F.trim(F.element_at(fields, 1)), 1, 1).alias("status"))


def change_kind(status: Column) -> Column:
    return F.when(status == "A", F.lit("added")).when(status == "D", F.lit("deleted")).otherwise(F.lit("modified"))


def diff_files(symbols: DataFrame, changed: DataFrame, file: str = "file") -> DataFrame:
    """Every symbol of a changed file with the file's ``change``."""
    status = changed.select(F.col("path").alias("path_"), change_kind(F.col("status")).alias("change"))
    return symbols.join(status, F.col(file) == F.col("path_")).drop("path_")


def diff_symbols(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("id", "file")) -> DataFrame:
    """Keys with change added, deleted, modified_signature or modified_body; equal symbols are left out."""
    a = old.select(*keys, F.col("signature").alias("s0"), F.col("content_hash").alias("h0"), F.lit(True).alias("a_"))
    b = new.select(*keys, F.col("signature").alias("s1"), F.col("content_hash").alias("h1"), F.lit(True).alias("b_"))
    change = (
        F.when(F.col("a_").isNull(), F.lit("added"))
        .when(F.col("b_").isNull(), F.lit("deleted"))
        .when(~F.col("s0").eqNullSafe(F.col("s1")), F.lit("modified_signature"))
        .when(~F.col("h0").eqNullSafe(F.col("h1")), F.lit("modified_body"))
    )
    return a.join(b, list(keys), "full").withColumn("change", change).filter("change is not null").select(*keys, "change")
