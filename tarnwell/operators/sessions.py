"""Session tables: sessions and their turns, two tables that change in one commit.

    store = SessionStore.create(spark, path)                      # or SessionStore.open(spark, path), None if there is none
    store = store.apply(changes)                                  # rows of op open, turn, delete
    follow(stream_of_changes, path, "chat").option("checkpointLocation", at).start()
    store.sessions(), store.turns(), store.recent(10)

A session is in one of ``buckets`` by the hash of its id.  Turns are appended as immutable parts, partitioned by bucket; a
deletion writes the turns of the buckets it touches anew (copy on write), and the few rows of sessions are written anew for the
buckets of a batch.  Parts are written first; then one manifest names the parts of both tables and the last batch of each writer, and
is put by a rename that fails if another writer was first.  So readers see both tables before or after a batch, never between;
a batch that is replayed after a lost driver changes nothing; a loser does its batch again on what the winner left.

Order: batches in the order they are applied; within a batch, changes by (at, id).  A deletion takes all earlier turns of its session, and
what stands at its own place; later changes begin the session anew.

Defined results: rows without a valid id (1 to 128 characters without the blanks round it), time or id, or with another op, are left out;
null questions and answers are empty; an unknown mode is rag; repeated rows are turns of their own; opening a session that is there
changes nothing; deleting one that isn't there changes nothing; an empty batch changes nothing but the writer's batch number; other columns are left out.
A session may hold any share of the turns: parts are balanced by size (a bucket may have many files), and no turns are gathered by session.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tarnwell.functions.text import normalize_mode, normalize_session
from tarnwell.sources.shared import Conflict, Folder

FORMAT = 1
#: Buckets of sessions, and parts of a bucket from which ``compact`` writes it anew.
BUCKETS, FAN = 16, 8
OPS = ("open", "turn", "delete")
SESSIONS = "session_id string, created_at timestamp, updated_at timestamp"
TURNS = "session_id string, id long, at timestamp, question string, answer string, mode string"


@dataclass(frozen=True)
class Manifest:
    """Parts by bucket (the bucket's number as text), and the last batch of each writer."""

    generation: int = -1
    buckets: int = BUCKETS
    sessions: dict[str, str] = field(default_factory=dict)
    turns: dict[str, list[str]] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)


class SessionStore:
    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest
        self.folder = Folder(spark, path)

    # -- life -----------------------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = BUCKETS) -> SessionStore:
        """An empty store; one that is there already is a conflict."""
        return cls(spark, path, Manifest(buckets=buckets))._commit(Manifest(buckets=buckets))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SessionStore | None:
        folder = Folder(spark, path)
        names = [n for n in folder.names("manifest") if n[0] != "."]
        try:
            found = json.loads(folder.read(f"manifest/{names[-1]}")) if names else {}
        except ValueError:
            return None
        return cls(spark, path, Manifest(**found)) if found and found.pop("format", None) == FORMAT else None

    def _commit(self, manifest: Manifest) -> SessionStore:
        after = replace(manifest, generation=self.manifest.generation + 1)
        self.folder.put_once(f"manifest/{after.generation:010d}.json", json.dumps(asdict(after) | {"format": FORMAT}))
        return SessionStore(self.spark, self.path, after)

    def apply(self, changes: DataFrame, writer: str | None = None, batch: int | None = None, tries: int = 3) -> SessionStore:
        """The store after changes (session_id, op, at, id, question, answer, mode). A batch of a writer that isn't newer than its last one changes nothing."""
        store = self
        for left in reversed(range(tries)):
            try:
                return store._applied(changes, writer, batch)
            except Conflict:
                if not left:
                    raise
                store = SessionStore.open(self.spark, self.path)
        return store

    def append(self, turns: DataFrame, writer: str | None = None, batch: int | None = None) -> SessionStore:
        """Also these turns (session_id, at, id, question, answer, mode); their sessions are made if they aren't there."""
        return self.apply(turns.withColumn("op", F.lit("turn")), writer, batch)

    def delete(self, ids: DataFrame, writer: str | None = None, batch: int | None = None) -> SessionStore:
        """Without these sessions (session_id) and all their turns."""
        none = F.lit(None).cast("string")
        return self.apply(ids.select("session_id", F.lit("delete").alias("op"), F.current_timestamp().alias("at"), F.lit(0).alias("id"), none.alias("question"), none.alias("answer"), none.alias("mode")), writer, batch)

    def compact(self, fan: int = FAN) -> SessionStore:
        """Write the turns of buckets that have ``fan`` or more parts as one part each."""
        many = [b for b, parts in self.manifest.turns.items() if len(parts) >= fan]
        if not many:
            return self
        name, found = self._write("turns", self.turns(buckets=many))
        return self._commit(replace(self.manifest, turns={b: [name] if b in many else parts for b, parts in self.manifest.turns.items() if b not in many or b in found}))

    def vacuum(self) -> int:
        """Delete what the newest manifest doesn't name; number of folders and manifests deleted. Not while another writes or reads."""
        m = self.manifest
        used = {"sessions": set(m.sessions.values()), "turns": {p for parts in m.turns.values() for p in parts}, "batches": set(), "manifest": {f"{m.generation:010d}.json"}}
        gone = [f"{kind}/{name}" for kind, kept in used.items() for name in self.folder.names(kind) if name not in kept and not name.startswith(f".{m.generation:010d}")]
        for name in gone:
            self.folder.delete(name)
        return len(gone)

    # -- reading --------------------------------------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("session_id"), F.lit(self.manifest.buckets)).cast("int")

    def _read(self, table: str, schema: str, parts: list[tuple[str, str]]) -> DataFrame:
        paths = [f"{self.path}/{table}/{part}/bucket={b}" for b, part in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def sessions(self, buckets: list[str] | None = None) -> DataFrame:
        """session_id, created_at, updated_at (of the latest turn, or of its making)."""
        return self._read("sessions", SESSIONS, [(b, p) for b, p in self.manifest.sessions.items() if buckets is None or b in buckets])

    def turns(self, ids: list[str] | None = None, buckets: list[str] | None = None) -> DataFrame:
        """session_id, id, at, question, answer, mode; of some sessions only, by the files of their buckets."""
        if ids is not None:
            asked = self.spark.createDataFrame([(i,) for i in ids], "session_id string").select(self.bucket().alias("b")).distinct()
            buckets = [str(r.b) for r in asked.collect()]
        rows = self._read("turns", TURNS, [(b, p) for b, parts in self.manifest.turns.items() if buckets is None or b in buckets for p in parts])
        return rows if ids is None else rows.where(F.col("session_id").isin(ids))

    def recent(self, n: int, ids: list[str] | None = None) -> DataFrame:
        """The last n turns of each session with their place, old to new; none for n <= 0."""
        back = Window.partitionBy("session_id").orderBy(F.desc("at"), F.desc("id"))
        last = self.turns(ids).withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)
        return last.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("back")))).drop("back")

    def turn_counts(self) -> DataFrame:
        """session_id, n_turns, 0 for a session without turns."""
        counts = self.turns().groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
        return self.sessions().join(counts, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_turns"))

    # -- writing --------------------------------------------------------------------------------------------------------

    def _write(self, table: str, rows: DataFrame) -> tuple[str, set[str]]:
        """Name of the new part, and the buckets that it has."""
        name = uuid.uuid4().hex
        rows.withColumn("bucket", self.bucket()).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{table}/{name}")
        return name, {n.partition("=")[2] for n in self.folder.names(f"{table}/{name}") if n.startswith("bucket=")}

    def _applied(self, changes: DataFrame, writer: str | None, batch: int | None) -> SessionStore:
        m = self.manifest
        if writer is not None and batch is not None and batch <= m.writers.get(writer, -1):
            return self
        writers = m.writers | ({writer: batch} if writer is not None and batch is not None else {})
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        rows = changes.select(
            normalize_session(F.col("session_id")).alias("session_id"), "op", F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"), text("question"), text("answer"), normalize_mode(F.col("mode")).alias("mode"),
        )
        valid = rows.where("session_id is not null and at is not null and id is not null").where(F.col("op").isin(*OPS))
        # the batch is read several times, and a source must not answer differently in between
        kept = f"batches/{uuid.uuid4().hex}"
        valid.withColumn("bucket", self.bucket()).write.parquet(f"{self.path}/{kept}")
        try:
            rows = self.spark.read.schema(f"session_id string, op string, {TURNS.partition(', ')[2]}, bucket int").parquet(f"{self.path}/{kept}")
            touched = [str(r.bucket) for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
            if not touched:
                return self if writers == m.writers else self._commit(replace(m, writers=writers))
            cuts = rows.where("op = 'delete'").groupBy("session_id").agg(F.max(F.struct("at", "id")).alias("cut"))
            live = rows.where("op <> 'delete'").join(cuts, "session_id", "left").where(F.col("cut").isNull() | (F.struct("at", "id") > F.col("cut")))
            old = self.sessions(touched)
            hit = {str(r.b) for r in old.join(cuts, "session_id", "left_semi").select(self.bucket().alias("b")).distinct().collect()}
            sessions, has_sessions = self._write("sessions", self._merged(old.join(cuts, "session_id", "left_anti"), live))
            turns = live.where("op = 'turn'").select(*self.turns(buckets=[]).columns)
            if hit:
                turns = turns.unionByName(self.turns(buckets=sorted(hit)).join(cuts, "session_id", "left_anti"))
            part, has_turns = self._write("turns", turns)
        finally:
            self.folder.delete(kept)
        stay = {b: parts for b, parts in m.turns.items() if b not in hit}
        return self._commit(replace(
            m, writers=writers, sessions={b: p for b, p in m.sessions.items() if b not in touched} | dict.fromkeys(sorted(has_sessions), sessions),
            turns=stay | {b: [*stay.get(b, []), part] for b in sorted(has_turns)},
        ))

    @staticmethod
    def _merged(old: DataFrame, live: DataFrame) -> DataFrame:
        """Sessions after a batch: those that were there keep the time of their making."""
        none = F.lit(None).cast("timestamp")
        before = old.select("session_id", "created_at", "updated_at", none.alias("made"), none.alias("turned"))
        after = live.select("session_id", none.alias("created_at"), none.alias("updated_at"), F.col("at").alias("made"), F.when(F.col("op") == "turn", F.col("at")).alias("turned"))
        both = before.unionByName(after).groupBy("session_id").agg(*(f(c).alias(c) for c, f in (("created_at", F.max), ("updated_at", F.max), ("made", F.min), ("turned", F.max))))
        created = F.coalesce("created_at", "made")
        return both.select("session_id", created.alias("created_at"), F.greatest(F.coalesce("updated_at", created), "turned").alias("updated_at"))


def follow(changes: DataFrame, path: str, writer: str) -> DataStreamWriter:
    """A stream of changes that keeps the store at ``path``, which must be there. ``writer`` names this query: another checkpoint needs another name, as batch numbers begin anew."""

    def put(rows: DataFrame, batch: int) -> None:
        SessionStore.open(rows.sparkSession, path).apply(rows, writer, batch)

    return changes.writeStream.foreachBatch(put)
