"""Renderers: rows as JSON, as text for people, or compact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def as_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns side by side, two spaces between them."""
    return df.select(F.concat_ws("  ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns or df.columns)).alias("line"))


def as_compact(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns separated by bars, empty ones left empty."""
    return df.select(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns)).alias("line"))
