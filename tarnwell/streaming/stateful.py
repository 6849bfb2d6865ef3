"""Keyed state with event-time timers: guarded streams of answers, a cache with a time to live, a rate limiter.

Rows wait in the state store until the watermark has passed them; then each key's rows are handled in order of time and id, and
what was due in between (a timeout, an entry's end) happens at its own time. So results don't depend on the order in which
rows come or on the cut into micro-batches, and a key has one writer.

Defined results: rows without key, time or id are left out; rows later than the watermark are dropped by Spark; rows that repeat a
time and id of their key count once (if both come before the watermark passes); an empty stream gives an empty stream. A key's
waiting rows, those within the watermark's delay, are taken into memory when they are handled; all else is in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tarnwell.sources.shared import new_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = "at long, id long, kind string, subject string"


class InOrder(StatefulProcessor):
    """Hands each key's rows (at in microseconds, id, kind, subject) to ``step`` in order, and deadlines to ``expire``."""

    memory_schema = ""
    out_schema = ""

    def load(self, kept: tuple):
        """The state in the form that the methods below work on."""
        return kept

    def save(self, state) -> tuple:
        """The state in the form of ``memory_schema``."""
        return state

    def step(self, state, row: tuple, out: list[tuple]):
        """The state after a row."""
        raise NotImplementedError

    def deadline(self, state) -> int | None:
        """When ``expire`` is due; a row at that very time comes first."""
        return None

    def expire(self, state, at: int, out: list[tuple]):
        """The state after a deadline, which must be later or none."""
        return None

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.memory = handle.getValueState("memory", self.memory_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new = list(zip(*(frame[c].tolist() for c in ("at", "id", "kind", "subject"))))
            if new:
                self.waiting.appendList(new)
                self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000  # no row before it can still come
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = {r[:2]: r for r in held if r[0] < mark}
        rest = [r for r in held if r[0] >= mark]
        known = self.memory.exists()
        state = self.load(tuple(self.memory.get())) if known else None
        out: list[tuple] = []

        def passed(state, until: int):
            while state is not None and (at := self.deadline(state)) is not None and at < until:
                state = self.expire(state, at, out)
            return state

        for place in sorted(due):
            state = self.step(passed(state, place[0]), due[place], out)
        state = passed(state, mark)
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if state is not None:
            self.memory.update(self.save(state))
        elif known:
            self.memory.clear()
        following = [r[0] for r in rest] + [x for x in [None if state is None else self.deadline(state)] if x is not None]
        if following:
            self.handle.registerTimer(min(following) // 1000 + 1)
        if out:
            names = [c.split()[0] for c in self.out_schema.split(", ")]
            yield pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in zip(names, zip(*((key[0], *o) for o in out)))})

    def close(self) -> None:
        pass


class StreamGuard(InOrder):
    """One row a request when it ends. The first row begins it, whatever its kind.

    delta, done and error are the kinds that count. A request is completed by done; it fails by an error after the first delta or by
    the error of its last attempt; an error before the first delta begins another attempt after a wait of min(base * 2^(n-1), most).
    It times out if no delta comes within ``first`` of an attempt's begin, or nothing within ``idle`` of the row before once there
    was a delta; a row at that very time is in time. Each whole ``beat`` of silence counts one heartbeat. Rows after the end are
    ignored for ``keep``; later ones begin anew. All spans are microseconds.
    """

    memory_schema = "begin long, opened long, last long, attempts long, deltas long, first long, beats long, ended long"
    out_schema = "request_id string, outcome string, begin_us long, ended_us long, attempts long, n_deltas long, ttft_us long, n_heartbeats long"

    def __init__(self, first: int, idle: int, beat: int, attempts: int, base: int, most: int, keep: int):
        self.first, self.idle, self.beat, self.attempts, self.base, self.most, self.keep = first, idle, beat, attempts, base, most, keep

    def deadline(self, state):
        begin, opened, last, _, _, first, _, ended = state
        if ended is not None:
            return ended + self.keep
        return opened + self.first if first is None else last + self.idle

    def _end(self, state, outcome, at, out):
        begin, opened, last, attempts, deltas, first, beats, _ = state
        beats += max(0, at - last) // self.beat
        out.append((outcome, begin, at, attempts, deltas, None if first is None else first - begin, beats))
        return (begin, opened, last, attempts, deltas, first, beats, at)

    def expire(self, state, at, out):
        if state[7] is not None:
            return None
        return self._end(state, "first_token_timeout" if state[5] is None else "idle_timeout", at, out)

    def step(self, state, row, out):
        at, _, kind, _ = row
        begin, opened, last, attempts, deltas, first, beats, ended = state or (at, at, at, 1, 0, None, 0, None)
        if ended is not None:
            return state
        now = (begin, opened, last, attempts, deltas, first, beats, None)
        if kind == "done":
            return self._end(now, "completed", at, out)
        if kind == "error" and (first is not None or attempts >= self.attempts):
            return self._end(now, "failed", at, out)
        beats += (at - last) // self.beat
        if kind == "error":
            opened = at + min(self.base * 2 ** (attempts - 1), self.most)
            attempts += 1
        elif kind == "delta":
            deltas, first = deltas + 1, at if first is None else first
        return (begin, opened, at, attempts, deltas, first, beats, None)


class TtlCache(InOrder):
    """id and outcome (hit, miss) of each request of a key. Kinds: ask, empty (a request that would find nothing), bump.

    An entry is written by an ask that misses, under its subject, and lives ``ttl`` microseconds from there; hits don't refresh it and
    empty results aren't kept. A bump makes all of the key's entries void. Entries leave the state when their time is over.
    """

    memory_schema = "entries array<struct<subject string, written long>>"
    out_schema = "key string, id long, outcome string"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def load(self, kept):
        return dict(sorted(map(tuple, kept[0]), key=lambda e: e[1]))  # the oldest is first, also after what step does

    def save(self, state):
        return (list(state.items()),)

    def deadline(self, state):
        return next(iter(state.values())) + self.ttl if state else None

    def expire(self, state, at, out):
        del state[next(iter(state))]
        return state or None

    def step(self, state, row, out):
        at, id_, kind, subject = row
        if kind == "bump":
            return None
        state = state or {}
        written = state.get(subject)
        hit = written is not None and at - written < self.ttl
        out.append((id_, "hit" if hit else "miss"))
        if not hit:
            state.pop(subject, None)
            if kind != "empty":
                state[subject] = at
        return state or None


class RateLimiter(InOrder):
    """id, allowed, remaining, retry_after (seconds) of each request: at most ``limit`` in a fixed window of the clock."""

    memory_schema = "bucket long, n long"
    out_schema = "key string, id long, allowed boolean, remaining long, retry_after long"

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def deadline(self, state):
        return (state[0] + 1) * self.window * 1_000_000 - 1

    def step(self, state, row, out):
        second = row[0] // 1_000_000
        bucket = second // self.window
        n = state[1] + 1 if state and state[0] == bucket else 1
        wait = 0 if n <= self.limit else max((bucket + 1) * self.window - second, 1)
        out.append((row[1], n <= self.limit, max(self.limit - n, 0), wait))
        return (bucket, n)


def rows_of(log: DataFrame, key: Column, kind: Column, subject: Column | None = None, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """key, ts, at, id, kind, subject, as the processors take them."""
    time = F.col(ts).cast("timestamp")
    rows = log.select(
        key.cast("string").alias("key"), time.alias("ts"), F.unix_micros(time).alias("at"), F.col(id_col).cast("long").alias("id"), kind.cast("string").alias("kind"),
        (F.lit("") if subject is None else subject).cast("string").alias("subject"),
    )
    return rows.where("key is not null and at is not null and id is not null")


def run(stream: DataFrame, processor: InOrder, late: str = "10 minutes") -> DataFrame:
    """The processor's rows over a stream of ``rows_of``. The query must be started within ``state_store``."""
    return stream.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.out_schema, outputMode="Append", timeMode="EventTime"
    )


@contextmanager
def state_store(spark: SparkSession):
    """Timers and several states a key need the RocksDB state store; a query keeps the one that it was started with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


#: The key of the row that closes a replayed log.
_CLOCK = "\0clock"


def replay(rows: DataFrame, processor: InOrder, after: int) -> DataFrame:
    """The processor over a whole log (``rows_of``), as a stream from its first row to ``after`` seconds past its last one.

    The log and a last row far behind it, which moves the watermark past all deadlines, are written to the shared folder.
    """
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "replay")
    rows.write.parquet(f"{path}/log")
    log = spark.read.schema(rows.schema).parquet(f"{path}/log")
    last = (F.max("at") + after * 1_000_000).alias("at")
    clock = log.agg(last).where("at is not null").select(F.lit(_CLOCK).alias("key"), F.timestamp_micros("at").alias("ts"), "at", F.lit(0).cast("long").alias("id"), F.lit("").alias("kind"), F.lit("").alias("subject"))
    clock.write.mode("append").parquet(f"{path}/log")
    out = run(spark.readStream.schema(rows.schema).parquet(f"{path}/log"), processor, "0 seconds")
    with state_store(spark):
        done = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        done.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out").where(F.col(out.columns[0]) != _CLOCK)
