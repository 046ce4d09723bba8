"""A pipeline over ``documents``: quality rules, near duplicates, repeated passages, benchmark leaks, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of ``documents``. :func:`run` writes each stage's rows as Parquet to the shared folder and reads them again.

Defined cases: those of the operators; an empty table passes through; other columns of ``documents`` are dropped by the
first stage. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, decontam, quality, simhash, suffixdedup
from codeloom.llm.common import drop_folder, passing, shared_folder, table, written_to

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    judged = quality.apply_quality(docs.select(COLUMNS), clean=True).filter("kept")
    cut = F.col("clean_text") != F.col("text")
    chars = F.when(cut, F.length("clean_text").cast("bigint")).otherwise(F.col("n_chars"))
    return judged.withColumns({"n_chars": chars, "text": F.col("clean_text")}).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each component."""
    return simhash.deduplicate(docs).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated passages; one of which nothing is left goes."""
    cut = suffixdedup.remove_repeats(docs.select(COLUMNS), with_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    left = cut.filter("n_removed = 0 or kept_text rlike '[^\\\\s]'")
    return left.withColumns({"text": text, "n_chars": chars}).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"), short=True).select(COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their count and digests."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), keep=["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("quality_rules", clean_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("byte_bpe", encode_texts),
]

#: XXH64, byte-wise suffixes and merge ranks are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"pipeline-{name}")
        with passing(spark):
            docs = written_to(stage(spark, docs, sf_dir), folder)
        if before:
            drop_folder(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
