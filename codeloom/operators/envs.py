"""Environment files: one value for each key, with its state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import env


def variables(lines: DataFrame) -> DataFrame:
    """(key, value, state, note, warning) from lines (file_rank, line_no, line): the first file that has a key gives it,
    and within a file its last line."""
    rows = lines.filter(env.is_assignment(F.col("line"))).select("file_rank", "line_no", env.key(F.col("line")).alias("key"), env.value(F.col("line")).alias("value"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("file_rank", F.desc("line_no")))
    best = rows.withColumn("place", place).filter("place = 1").withColumn("state", env.state(F.col("value")))
    return best.select("key", "value", "state", env.note(F.col("state")).alias("note"), env.warning(F.col("key"), F.col("state")).alias("warning")).orderBy("key")


def compare(actual: DataFrame, template: DataFrame) -> DataFrame:
    """(key, state): keys of the template that the actual file lacks are missing; empty ones are unset."""
    own = actual.select("key", F.col("state").alias("own"))
    both = template.select("key").distinct().join(own, "key", "left")
    return both.select("key", F.when(F.col("own").isNull(), F.lit("missing")).when(F.col("own") == "empty", F.lit("unset")).otherwise(F.col("own")).alias("state"))
