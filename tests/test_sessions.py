"""Session tables: order of changes, replayed batches, one commit for both tables, streams."""

from datetime import datetime, timedelta, timezone

import pytest

from tarnwell.operators.sessions import SessionStore, follow
from tarnwell.sources.shared import Conflict

ZERO = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "session_id string, op string, at timestamp, id long, question string, answer string, mode string, bucket string"


def changes(spark, *rows):
    """Rows of (session, op, second, id, question)."""
    return spark.createDataFrame([(s, o, None if t is None else ZERO + timedelta(seconds=t), i, q, None, "CHAT", "clash") for s, o, t, i, q in rows], SCHEMA)


def state(store):
    """Sessions with their times, and turns; no turn may be an orphan."""
    rows = store.sessions().selectExpr("session_id", "unix_timestamp(created_at) c", "unix_timestamp(updated_at) u").collect()
    begin = int(ZERO.timestamp())
    found = sorted((r.session_id, r.c - begin, r.u - begin) for r in rows)
    turns = sorted((r.session_id, r.id, r.question) for r in store.turns().collect())
    assert {t[0] for t in turns} <= {s[0] for s in found}
    assert len(found) == len({s[0] for s in found})
    return found, turns


def test_changes_in_order(spark, tmp_path):
    store = SessionStore.create(spark, f"{tmp_path}/s", buckets=3)
    assert state(store) == ([], [])
    first = store.apply(changes(
        spark, ("a", "turn", 5, 1, "x"), (" a ", "turn", 9, 2, "y"), ("b", "open", 3, 3, None), ("c", "turn", 1, 4, "gone"), ("c", "delete", 2, 5, None), ("c", "turn", 2, 5, "tie"), ("c", "turn", 4, 6, None),
        ("d", "turn", 1, 7, "q"), ("d", "delete", 8, 8, None), (None, "turn", 1, 9, "q"), ("  ", "turn", 1, 10, "q"), ("x" * 129, "turn", 1, 11, "q"), ("e", "turn", None, 12, "q"), ("e", "turn", 1, None, "q"), ("e", "other", 1, 13, "q"),
        ("a", "turn", 9, 2, "y"),
    ))
    assert state(first) == ([("a", 5, 9), ("b", 3, 3), ("c", 4, 4)], [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("c", 6, "")])
    second = first.apply(changes(spark, ("b", "open", 20, 20, None), ("a", "open", 21, 21, None), ("c", "delete", 22, 22, None), ("nobody", "delete", 22, 23, None), ("b", "turn", 1, 24, "late")))
    assert state(second) == ([("a", 5, 9), ("b", 3, 3)], [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 24, "late")])
    assert state(first)[1][-1] == ("c", 6, "")  # who has the older one open reads on
    assert {r.session_id: r.n_turns for r in second.turn_counts().collect()} == {"a": 3, "b": 1}
    assert {r.mode for r in second.turns().collect()} == {"chat"} and {r.answer for r in second.turns().collect()} == {""}
    assert state(SessionStore.open(spark, f"{tmp_path}/s")) == state(second)


def test_replayed_batches_and_writers(spark, tmp_path):
    store = SessionStore.create(spark, f"{tmp_path}/s", buckets=2)
    one = changes(spark, ("a", "turn", 1, 1, "x"))
    after = store.apply(one, "w", 0)
    again = after.apply(one, "w", 0)
    assert again.manifest == after.manifest and state(again)[1] == [("a", 1, "x")]
    empty = again.apply(changes(spark), "w", 1)
    assert empty.manifest.writers == {"w": 1} and state(empty) == state(after)
    assert empty.apply(changes(spark)).manifest == empty.manifest
    other = empty.apply(one, "v", 0)
    assert len(state(other)[1]) == 2
    # who comes second does the batch again on what the first left, or is told
    late = after.apply(changes(spark, ("b", "turn", 2, 2, "z")), "u", 0)
    assert len(state(late)[1]) == 3 and late.manifest.writers == {"w": 1, "v": 0, "u": 0}
    with pytest.raises(Conflict):
        after.apply(changes(spark, ("b", "turn", 2, 2, "z")), tries=1)
    with pytest.raises(Conflict):
        SessionStore.create(spark, f"{tmp_path}/s")
    assert state(SessionStore.open(spark, f"{tmp_path}/s")) == state(late)
    assert SessionStore.open(spark, f"{tmp_path}/none") is None


def test_recent_compact_vacuum(spark, tmp_path):
    store = SessionStore.create(spark, f"{tmp_path}/s", buckets=2)
    for i in range(3):
        store = store.append(changes(spark, ("hot", "", i, i, f"q{i}"), ("hot", "", i, 10 + i, f"r{i}"), ("cold", "", i, i, f"c{i}")).drop("op"))
    before = state(store)
    got = sorted((r.session_id, r.place, r.question) for r in store.recent(2).collect())
    assert got == [("cold", 1, "c1"), ("cold", 2, "c2"), ("hot", 1, "q2"), ("hot", 2, "r2")]
    assert store.recent(0).count() == 0 and store.recent(1, ["hot"]).count() == 1 and store.turns(["nobody"]).count() == 0
    packed = store.compact(3)
    assert state(packed) == before and all(len(p) == 1 for p in packed.manifest.turns.values())
    assert packed.compact(3) is packed and packed.vacuum() > 0 and state(packed) == before
    bare = packed.delete(spark.createDataFrame([("hot",), ("cold",)], "session_id string"))
    assert state(bare) == ([], []) and bare.manifest.turns == {} and bare.manifest.sessions == {}


def test_stream(spark, tmp_path):
    """Batches of a stream; one replayed from an older checkpoint isn't applied again."""
    SessionStore.create(spark, f"{tmp_path}/s", buckets=2)
    schema = changes(spark).schema

    def run(checkpoint):
        rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        follow(rows, f"{tmp_path}/s", "chat").option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
        return SessionStore.open(spark, f"{tmp_path}/s")

    changes(spark, ("a", "turn", 1, 1, "x"), ("b", "turn", 1, 2, "y")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run("cp")
    changes(spark, ("a", "delete", 2, 3, None), ("b", "turn", 5, 4, "z")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    after = run("cp")
    assert state(after) == ([("b", 1, 5)], [("b", 2, "y"), ("b", 4, "z")])
    assert run("lost").manifest == after.manifest
