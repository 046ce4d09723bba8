"""Similarity of vectors against one query vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_topk(df: DataFrame, query: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to the one row of ``query`` (column ``q``), itself included."""
    near = df.crossJoin(F.broadcast(query.limit(1)))  # one row
    norm = lambda v: F.sqrt(dot(v, v))
    cosine = dot(F.col(vector), F.col("q")) / (norm(F.col(vector)) * norm(F.col("q")))
    return near.select(id_col, F.round(cosine, 6).alias("cosine")).orderBy(F.desc("cosine"), id_col).limit(k)
