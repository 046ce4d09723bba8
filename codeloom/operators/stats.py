"""Counts and sums over the relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens saved: for each row, or for each call.
PER_ROW = {"search": 15, "deps": 20, "outline": 10, "diff": 15}
PER_CALL = {"tree": 80, "overview": 60, "env": 40, "status": 30}
FILE_BYTES = 5000
TOP = 10


def language_stats(symbols: DataFrame, language: str = "language", file: str = "file") -> DataFrame:
    """(language, files, symbols), most symbols first."""
    out = symbols.groupBy(F.col(language).alias("language")).agg(F.countDistinct(file).alias("files"), F.count("*").alias("symbols"))
    return out.orderBy(F.desc("symbols"), "language")


def package_stats(symbols: DataFrame, package: str = "package_root") -> DataFrame:
    """(package_root, symbols) without empty packages, most symbols first."""
    known = symbols.filter(F.coalesce(F.col(package), F.lit("")) != "")
    return known.groupBy(F.col(package).alias("package_root")).agg(F.count("*").alias("symbols")).orderBy(F.desc("symbols"), "package_root")


def count_flagged(df: DataFrame, flag: Column) -> DataFrame:
    return df.agg(F.count(F.when(flag, 1)).alias("n"))


def sessions(ledger: DataFrame) -> DataFrame:
    """Totals by session, the latest first."""
    out = ledger.groupBy("session_id").agg(
        F.sum("tokens_saved").alias("tokens_saved"), F.count("*").alias("calls"), F.min("call_at").alias("first_call"), F.max("call_at").alias("last_call")
    )
    return out.orderBy(F.desc("last_call"), "session_id")


def top_sessions(ledger: DataFrame, limit: int = TOP) -> DataFrame:
    """The sessions that saved most; a limit below one means ten."""
    return sessions(ledger).orderBy(F.desc("tokens_saved"), "session_id").limit(limit if limit > 0 else TOP)


def savings(ledger: DataFrame, session_id: object = None) -> DataFrame:
    """One row: tokens saved and calls, of one session or of all."""
    own = ledger if session_id is None else ledger.filter(F.col("session_id") == session_id)
    return own.agg(F.coalesce(F.sum("tokens_saved"), F.lit(0)).cast("bigint").alias("tokens_saved"), F.count("*").alias("calls"))


def savings_rollup(ledger: DataFrame, *levels: str) -> DataFrame:
    """Totals by each level, by those above it, and over all (an addition to the reference's queries)."""
    return ledger.rollup(*levels).agg(F.sum("tokens_saved").alias("tokens_saved"), F.count("*").alias("calls"))


def symbols_by_file(symbols: DataFrame, file: str = "file") -> DataFrame:
    return symbols.groupBy(F.col(file).alias("path")).agg(F.count("*").alias("symbol_count"))


def saved_by_symbol(source_bytes: Column, file_bytes: Column | int = FILE_BYTES) -> Column:
    """Tokens saved by one retrieved symbol: what the rest of its file would have cost, never below zero."""
    whole = F.lit(file_bytes) if isinstance(file_bytes, int) else file_bytes
    return F.floor(F.greatest(whole - source_bytes, F.lit(0)) / 4).cast("bigint")


def saved_by_call(tool: str, rows: int) -> int:
    return PER_ROW.get(tool, 0) * rows + PER_CALL.get(tool, 0)


def saved_by_calls(tool: Column, rows: Column) -> Column:
    """:func:`saved_by_call` for columns."""
    each, once = (F.coalesce(*(F.when(tool == name, F.lit(v)) for name, v in of.items()), F.lit(0)) for of in (PER_ROW, PER_CALL))
    return (each * rows + once).cast("bigint")


def overview(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: counts, languages and packages as arrays, top-level directories in order.

    The arrays have an entry for each language, package and first path segment.
    """
    from codeloom.functions.paths import top_level

    languages = language_stats(symbols).agg(F.array_sort(F.collect_list(F.struct(F.negative("symbols").alias("order"), "language", "files", "symbols"))).alias("languages"))
    packages = package_stats(symbols).agg(F.array_sort(F.collect_list(F.struct(F.negative("symbols").alias("order"), "package_root", "symbols"))).alias("packages"))
    tops = files.agg(F.count("*").alias("total_files"), F.sort_array(F.collect_set(top_level(F.col("path")))).alias("top_level_dirs"))
    counts = symbols.agg(F.count("*").alias("total_symbols"), F.count_if("possible_unresolved").alias("possible_unresolved_count"))
    row = counts.crossJoin(tops).crossJoin(languages).crossJoin(packages)  # four frames of one row each
    return row.withColumns(
        {
            "languages": F.transform("languages", lambda x: F.struct(x["language"].alias("language"), x["files"].alias("files"), x["symbols"].alias("symbols"))),
            "packages": F.transform("packages", lambda x: F.struct(x["package_root"].alias("package_root"), x["symbols"].alias("symbols"))),
        }
    )


def counters(calls: DataFrame, tool: str = "tool_name") -> DataFrame:
    """Calls and tokens by tool, as the counters of a process have them."""
    return calls.groupBy(F.col(tool).alias("tool_name")).agg(F.count("*").alias("calls"), F.sum("tokens_saved").alias("tokens_saved"))


def counts(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row: symbols and files."""
    return symbols.agg(F.count("*").alias("symbols")).crossJoin(files.agg(F.count("*").alias("files")))  # one row each


def folder_sizes(listing: DataFrame, folder: str = "folder", size: str = "size") -> DataFrame:
    """(folder, size_bytes, files) of a listing of files."""
    return listing.groupBy(folder).agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("size_bytes"), F.count("*").alias("files"))


def outdated(indexes: DataFrame, cutoff: DataFrame, at: str = "last") -> DataFrame:
    """Rows without an index, or whose index is older than the one row of ``cutoff``."""
    return indexes.crossJoin(F.broadcast(cutoff.limit(1))).filter(F.col(at).isNull() | (F.col(at) < F.col("cutoff"))).select(indexes.columns)


def status(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: symbols, those with callees that may be gone, files, calls without a known callee."""
    row = symbols.agg(F.count("*").alias("symbols"), F.count_if("possible_unresolved").alias("possible_unresolved"))
    return row.crossJoin(files.agg(F.count("*").alias("files"))).crossJoin(edges.agg(F.count_if(F.col("callee_id").isNull()).alias("unresolved_edges")))
