"""Keyed state with timers: cut into micro-batches and late rows, ends of requests, entries of a cache."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tarnwell.streaming import stateful, windows

S = 1_000_000
ZERO = datetime(2024, 1, 1, tzinfo=timezone.utc)
BEGIN = int(ZERO.timestamp())
GUARD = stateful.StreamGuard(first=10 * S, idle=5 * S, beat=2 * S, attempts=3, base=1 * S, most=8 * S, keep=60 * S)


def log(spark, rows):
    """Rows of (key, second, id, kind, subject)."""
    made = [(k, None if s is None else ZERO + timedelta(seconds=s), i, e, x) for k, s, i, e, x in rows]
    frame = spark.createDataFrame(made, "k string, ts timestamp, event_id long, kind string, subject string")
    return stateful.rows_of(frame, F.col("k"), F.col("kind"), F.col("subject"))


def test_ends_of_requests(spark):
    rows = [
        ("ok", 0, 1, "meta", None), ("ok", 3, 2, "delta", None), ("ok", 8, 3, "delta", None), ("ok", 9, 4, "done", None), ("ok", 9.5, 5, "error", None),
        ("slow", 0, 1, "meta", None), ("slow", 11, 2, "delta", None),
        ("edge", 0, 1, "meta", None), ("edge", 10, 2, "delta", None), ("edge", 15, 3, "delta", None), ("edge", 20.5, 4, "delta", None),
        ("retry", 0, 1, "meta", None), ("retry", 4, 2, "error", None), ("retry", 9, 3, "error", None), ("retry", 20, 4, "delta", None), ("retry", 21, 5, "done", None),
        ("fails", 0, 1, "error", None), ("fails", 1, 2, "error", None), ("fails", 2, 3, "error", None),
        ("late error", 0, 1, "meta", None), ("late error", 1, 2, "delta", None), ("late error", 2, 3, "error", None),
        ("again", 0, 1, "done", None), ("again", 70, 2, "done", None), ("again", 0, 1, "done", None),
        (None, 0, 1, "done", None), ("none", None, 1, "done", None), ("none", 1, None, "done", None),
    ]
    got = sorted((r.request_id, r.outcome, r.ended_us / S - BEGIN, r.attempts, r.n_deltas, r.ttft_us and r.ttft_us / S, r.n_heartbeats) for r in stateful.replay(log(spark, rows), GUARD, 200).collect())
    assert got == [
        ("again", "completed", 0, 1, 0, None, 0), ("again", "completed", 70, 1, 0, None, 0), ("edge", "idle_timeout", 20, 1, 2, 10, 9), ("fails", "failed", 2, 3, 0, None, 0),
        ("late error", "failed", 2, 1, 1, 1, 0), ("ok", "completed", 9, 1, 2, 3, 3), ("retry", "completed", 21, 3, 1, 20, 9), ("slow", "first_token_timeout", 10, 1, 0, None, 5),
    ]


def test_empty_log(spark):
    assert stateful.replay(log(spark, []), stateful.RateLimiter(1, 60), 60).count() == 0


def test_cache_entries(spark):
    rows = [("u", 0, 1, "ask", "q"), ("u", 5, 2, "ask", "q"), ("u", 10, 3, "ask", "q"), ("u", 12, 4, "ask", "p"), ("u", 13, 5, "ask", "q"), ("u", 14, 6, "bump", None), ("u", 15, 7, "ask", "q"), ("u", 16, 8, "empty", "z"), ("u", 17, 9, "empty", "z"), ("u", 18, 10, "ask", None), ("u", 19, 11, "ask", None)]
    got = {r.id: r.outcome for r in stateful.replay(log(spark, rows), stateful.TtlCache(10 * S), 60).collect()}
    assert got == {1: "miss", 2: "hit", 3: "miss", 4: "miss", 5: "hit", 7: "miss", 8: "miss", 9: "miss", 10: "miss", 11: "hit"}


@pytest.mark.parametrize("parts", [1, 4])
def test_micro_batches_and_late_rows(spark, tmp_path, parts):
    """One batch or several, rows out of order within the watermark's delay; a row behind the watermark is dropped; state survives a restart."""
    rows = [("r", 2, 2, "delta", None), ("r", 0, 1, "meta", None), ("r", 4, 3, "delta", None), ("x", 30, 9, "meta", None), ("r", 5, 4, "done", None), ("x", 100, 10, "done", None), ("far", 500, 11, "meta", None)]
    frame = log(spark, rows)
    at = f"{tmp_path}/{parts}"
    cuts = [(0, 7)] if parts == 1 else [(0, 2), (2, 4), (4, 6), (6, 7)]
    for i, j in cuts:
        log(spark, rows[i:j]).coalesce(1).write.mode("append").parquet(f"{at}/in")
        out = stateful.run(spark.readStream.schema(frame.schema).parquet(f"{at}/in"), GUARD, "40 seconds")
        with stateful.state_store(spark):
            out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    log(spark, [("r", 1, 12, "error", None), ("new", 1, 13, "done", None), ("far", 900, 14, "done", None)]).coalesce(1).write.mode("append").parquet(f"{at}/in")
    with stateful.state_store(spark):
        out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.request_id, r.outcome, r.n_deltas) for r in spark.read.parquet(f"{at}/out").collect())
    assert got == [("far", "first_token_timeout", 0), ("r", "completed", 2), ("x", "first_token_timeout", 0)]


def test_first_token_across_a_border(spark):
    rows = spark.createDataFrame([("a", "meta", ZERO + timedelta(minutes=9, seconds=59)), ("a", "delta", ZERO + timedelta(minutes=10, seconds=2)), ("b", "meta", ZERO)], "request_id string, event string, ts timestamp")
    assert {r.request_id: r.ttft_ms for r in windows.first_token(rows).collect()} == {"a": 3000.0, "b": None}
