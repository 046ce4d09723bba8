"""The ledger as a stream: state that is dropped, and rows that come late."""

from __future__ import annotations

import datetime

from codeloom.schemas import SAVINGS
from codeloom.streaming import savings

START = datetime.datetime(2024, 1, 1)


def test_state_of_idle_sessions_goes_and_late_rows_are_left_out(spark, tmp_path):
    ledger, said = f"file://{tmp_path}/ledger", []
    (tmp_path / "ledger").mkdir()

    def put(*rows):
        made = [(s, "search", START + datetime.timedelta(hours=h), 1.0, n) for s, h, n in rows]
        spark.createDataFrame(made, SAVINGS).coalesce(1).write.mode("append").parquet(ledger)
        query.processAllAvailable()
        said.append(query.lastProgress)

    totals = savings.session_totals(savings.read_ledger(spark, ledger), late="1 hour", idle_s=3600)
    query = totals.writeStream.format("memory").queryName("session_totals").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/check").start()
    try:
        put(("a", 0, 5), ("a", 0.5, 7), ("b", 0, None), (None, 0, 9))
        put(("a", 1, 1))
        for hour in range(4, 40, 4):  # a new session every four hours
            put((f"s{hour}", hour, hour))
        put(("a", 2, 100), ("c", 37, 3))  # that of a is far behind the watermark
        put(("a", 40, 2))  # begins anew
        given = [(r.session_id, r.tokens_saved, r.calls) for r in spark.table("session_totals").collect()]
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in said]
    finally:
        query.stop()
    assert ("a", 12, 2) in given and ("b", 0, 1) in given and ("a", 13, 3) in given and ("a", 2, 1) in given and ("c", 3, 1) in given
    assert not any(tokens >= 100 for _, tokens, _ in given)
    assert max(kept[4:]) <= 3 and len(given) == 14
