"""Connected components of a link table, by alternating large and small stars.

Links are rows (a, b). Every round replaces each node's links by links to the least neighbour, from above and from below,
until nothing changes; then each node links to the least node of its component. Rounds grow with the logarithm of the
longest chain. Only a count and a checksum reach the driver. Every round is written to the shared folder, and the one before
deleted. Hub nodes: the least neighbour is reduced map-side, and among ``MANY`` links it is written before the links meet it,
so that the join is one of two tables, which adaptive execution splits where a hub has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import drop_folder, passing, shared_folder, written, written_to


MANY = 50_000


def _large(links: DataFrame, many: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = written(least, "least") if many else least
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame, many: bool) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    least = written(least, "least") if many else least
    moved = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` but the roots, root being the least node of its component."""
    spark = links.sparkSession
    folder = shared_folder(spark, "links")
    links = written_to(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), folder)
    before = _state(links)
    while True:
        following, many = shared_folder(spark, "links"), before[0] >= MANY
        with passing(spark):
            stars = _large(links, many)
            if many:
                stars = written(stars, "stars")
            links = written_to(_small(stars, many), following)
        drop_folder(spark, folder)  # what is written needs no lineage
        folder, after = following, _state(links)
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
