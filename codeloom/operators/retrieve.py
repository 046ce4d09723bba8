"""Source of symbols: byte slices with context, and verification of their hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.identity import byte_slice, content_hash, valid_range
from codeloom.functions.paths import language

MAX_CONTEXT = 50
REDACTED = "[redacted]"


def clamp_context(lines: Column | int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(MAX_CONTEXT), F.lit(lines) if isinstance(lines, int) else lines))


def expand_back(content: Column, start: Column, lines: Column | int) -> Column:
    """Where the n-th line feed before ``start`` stands, or 0 if there are fewer. Bytes, not characters.

    Bytes are read as Latin-1, so that a place in the text is a place in the bytes.
    """
    n = F.lit(lines) if isinstance(lines, int) else lines
    before = F.decode(F.substring(content.cast("binary"), F.lit(1), start), "ISO-8859-1")
    pieces = F.split(before, "\n")
    kept = F.length(F.array_join(F.slice(pieces, F.greatest(F.size(pieces) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))), "\n"))
    return F.when(n <= 0, start).when(F.size(pieces) - 1 < n, F.lit(0)).otherwise(start - kept - 1)


def expand_forward(content: Column, end: Column, lines: Column | int) -> Column:
    """After the n-th line feed from ``end`` on, or the end of the content if there are fewer."""
    n = F.lit(lines) if isinstance(lines, int) else lines
    size = F.octet_length(content.cast("binary"))
    after = F.decode(F.substring(content.cast("binary"), end + 1, size), "ISO-8859-1")
    pieces = F.split(after, "\n")
    taken = F.length(F.array_join(F.slice(pieces, F.lit(1), F.greatest(n, F.lit(1))), "\n")) + 1
    return F.when(n <= 0, end).when(F.size(pieces) - 1 < n, size).otherwise(end + taken)


def slice_source(content: Column, start: Column, end: Column, lines: Column | int = 0) -> Column:
    """The text of a symbol with its context; a marker for redacted, invalid or missing sources.

    Bytes that are no whole character, as where a slice begins or ends inside one, become U+FFFD.
    """
    n = clamp_context(lines)
    begin, stop = expand_back(content, start, n), expand_forward(content, end, n)
    text = F.make_valid_utf8(byte_slice(content, begin, stop).cast("string"))
    bad = F.format_string("[source unavailable: invalid byte range [%d:%d] for file size %d]", start, end, F.octet_length(content))
    return (
        F.when(start.isNull() | end.isNull(), F.lit(REDACTED))
        .when(content.isNull(), F.lit("[source unavailable: file not found]"))
        .when(~valid_range(content, start, end), bad)
        .otherwise(text)
    )


def with_source(symbols: DataFrame, contents: DataFrame, lines: int = 0, file: str = "file", path: str = "path") -> DataFrame:
    """Symbols with ``source``; files are joined once each."""
    texts = contents.select(F.col(path).alias("path_"), F.col("content").alias("content_"))
    joined = symbols.join(texts, F.col(file) == F.col("path_"), "left")
    return joined.withColumn("source", slice_source(F.col("content_"), F.col("byte_start"), F.col("byte_end"), lines)).drop("path_", "content_")


def verify(symbols: DataFrame, contents: DataFrame, file: str = "file", path: str = "path") -> DataFrame:
    """One row: symbols hashed, and those whose stored hash differs; null and invalid ranges are left out."""
    texts = contents.select(F.col(path).alias("path_"), F.col("content").alias("content_"))
    joined = symbols.join(texts, F.col(file) == F.col("path_"))
    usable = joined.filter(F.col("byte_start").isNotNull() & F.col("byte_end").isNotNull() & valid_range(F.col("content_"), F.col("byte_start"), F.col("byte_end")))
    now = content_hash(F.col("content_"), F.col("byte_start"), F.col("byte_end"))
    return usable.agg(F.count("*").alias("total"), F.count_if(now != F.col("content_hash")).alias("mismatched"))


def shown(contents: DataFrame, hidden: Column) -> DataFrame:
    """(path, content, language, supported, size_bytes) of files (path, content); hidden ones show a marker."""
    known = language(F.col("path"))
    text = F.when(hidden, F.lit(REDACTED)).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    return contents.select("path", text.alias("content"), known.alias("language"), known.isNotNull().alias("supported"), F.octet_length("content").cast("bigint").alias("size_bytes"))
