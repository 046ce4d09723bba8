"""The savings ledger as a stream (an addition: the reference has no streams)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.schemas import SAVINGS


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files that are appended to the ledger."""
    return spark.readStream.schema(SAVINGS).parquet(path)


def running_totals(ledger: DataFrame) -> DataFrame:
    """Totals by session, for output mode update or complete."""
    return ledger.groupBy("session_id").agg(F.sum("tokens_saved").alias("tokens_saved"), F.count("*").alias("calls"), F.min("call_at").alias("first_call"), F.max("call_at").alias("last_call"))


def windowed_totals(ledger: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Totals by session and window, each given once its window is closed; state is dropped behind the watermark."""
    kept = ledger.withWatermark("call_at", late)
    out = kept.groupBy(F.window("call_at", width).alias("w"), "session_id").agg(F.sum("tokens_saved").alias("tokens_saved"), F.count("*").alias("calls"))
    return out.select(F.col("w.start").alias("window_start"), "session_id", "tokens_saved", "calls")


def session_totals(ledger: DataFrame, late: str = "1 hour", idle_s: int = 3600) -> DataFrame:
    """Totals of the sessions that had calls, for output mode update; a session's state is dropped when it has been idle.

    Rows that come later than ``late`` behind the newest time are left out, as in every query with a watermark; so are rows
    without a session or a time. A session ends once the watermark is ``idle_s`` seconds past its last call; a call after
    that begins a new one of the same id. So the state holds the sessions of about the last ``late`` and ``idle_s``, however
    long the stream runs.
    """

    def add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, calls, first, last = state.get if state.exists else (0, 0, None, None)
        for part in parts:  # in pieces of bounded size
            times = part["call_at"]
            tokens, calls = tokens + int(part["tokens_saved"].fillna(0).sum()), calls + len(part)
            first, last = min(x for x in (first, times.min()) if x is not None), max(x for x in (last, times.max()) if x is not None)
        state.update((tokens, calls, first, last))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + idle_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": [key[0]], "tokens_saved": [tokens], "calls": [calls], "first_call": [first], "last_call": [last]})

    known = ledger.filter("session_id is not null and call_at is not null").withWatermark("call_at", late)
    totals = "tokens_saved long, calls long, first_call timestamp, last_call timestamp"
    return known.select("session_id", "call_at", "tokens_saved").groupBy("session_id").applyInPandasWithState(add, f"session_id string, {totals}", totals, "update", GroupStateTimeout.EventTimeTimeout)


def append_stream(ledger: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to the ledger's folder, once for each row."""
    return ledger.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
