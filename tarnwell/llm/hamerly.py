"""Centroid clustering with Hamerly bounds: exact integer k-means that scans all centroids only for ambiguous vectors.

A vector's components become integers floor(SCALE * x).  The first centroids are the K vectors with the smallest hashes of
their ids.  In each round every vector goes to its nearest centroid (squared distance, ties to the smaller number), and each
centroid that has vectors becomes their componentwise floor(sum / count).

The state is a table in the shared folder: of each vector its integers, its centroid, one upper bound of the distance to it
and one lower bound of the distance to any other.  After a round the bounds are loosened by what the centroids moved.
Where the upper bound stays under the lower one, or under half the way to the next centroid, the vector stays; else the
upper bound is made exact, and where that isn't enough all centroids are compared in exact integers.  Bounds are floats rounded to the safe
side, so they only ever save scans, and a tie is never taken for a difference.  A task adds one row of sums for each centroid
to its vectors' rows, so a round is one pass: nothing is grouped, and only K rows of sums come to the driver.

Defined results: vectors that are null, haven't exactly DIMS components or have a null or non-finite one are left out; components beyond
2**27 in size count as that, so that distances fit a long; with fewer than K vectors there are as many centroids; a null id is never among the first
centroids (if all ids are null, nothing is clustered and the result is empty); repeated rows are vectors of their own, and ties of the hash go to the smaller integers; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, removed

DIMS, SCALE = 64, 256
#: Most size of a component: 64 * (2 * 2**27)**2 is 2**62.
MOST = 1 << 27
#: Up to this size sums of 64 products are exact in floats, so that a matrix product is.
FLOAT_EXACT = 1 << 20
#: Each bound is moved by this part of itself to the safe side; far above the error of the few float operations that made it.
SLACK = 1e-12

STATE = "kind int, vec_id long, v array<int>, cluster int, upper double, lower double, distance long, sums array<long>, n long, scanned long, spread decimal(38,0)"


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the vectors that are kept, as integers."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    held = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(scale * c.cast("double"), F.lit(-2.0 * MOST)), F.lit(2.0 * MOST))), F.lit(-MOST)), F.lit(MOST)).cast("int")
    good = vectors.where(x.isNotNull() & (F.size(x) == dims) & finite)
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, held).alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str = "2:") -> np.ndarray:
    """The k vectors with the smallest hashes, in ascending order; k rows come to the driver."""
    hashed = rows.where(F.col("vec_id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256))
    picked = hashed.orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in picked] or np.zeros((0, 1)), np.int64)


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of v to all of c."""
    if len(v) and len(c) and max(np.abs(v).max(), np.abs(c).max()) <= FLOAT_EXACT:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]).astype(np.int64)
    out = np.empty((len(v), len(c)), np.int64)
    for j in range(len(c)):
        out[:, j] = ((v - c[j]) ** 2).sum(1)
    return out


class Move:
    """What a round has to know: centroids, how far each moved, and half the way from each to the next."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now, k = now, len(now)
        self.drift = np.zeros(k) if before is None else np.sqrt(((now - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        far = np.sqrt(distances(now, now).astype(np.float64)) * (1 - SLACK)
        np.fill_diagonal(far, np.inf)
        self.half = far.min(1) / 2
        # the most that any other centroid moved, for each one
        order = np.argsort(-self.drift)
        self.others = np.full(k, self.drift[order[0]])
        self.others[order[0]] = self.drift[order[1]] if k > 1 else 0.0

    def assign(self, v: np.ndarray, cluster: np.ndarray | None, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """cluster, upper, lower, exact squared distance and number of scanned vectors."""
        if cluster is None:
            cluster, unsure = np.zeros(len(v), np.int64), np.arange(len(v))
            upper, lower = np.zeros(len(v)), np.zeros(len(v))
        else:
            upper = (upper + self.drift[cluster]) * (1 + SLACK)
            lower = np.maximum(lower - self.others[cluster], 0.0) * (1 - SLACK)
            safe = np.maximum(lower, self.half[cluster])
            unsure = np.flatnonzero(upper >= safe)
            own = ((v[unsure] - self.now[cluster[unsure]]) ** 2).sum(1)
            upper[unsure] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
            unsure = unsure[upper[unsure] >= safe[unsure]]
        for i in range(0, len(unsure), 4096):
            at = unsure[i:i + 4096]
            d = distances(v[at], self.now)
            best = d.argmin(1)  # of equal ones the first
            cluster[at] = best
            upper[at] = np.sqrt(d[np.arange(len(at)), best].astype(np.float64)) * (1 + SLACK)
            d[np.arange(len(at)), best] = np.iinfo(np.int64).max
            lower[at] = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK) if len(self.now) > 1 else np.inf
        return cluster, upper, lower, ((v - self.now[cluster]) ** 2).sum(1), len(unsure)


def _pass(rows: DataFrame, move: Move, path: str) -> DataFrame:
    """One assignment of all vectors, written with the sums of each task and centroid (kind 1)."""
    spark, k, dims = rows.sparkSession, *move.now.shape
    names = [x.split()[0] for x in STATE.split(", ")]
    types = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.decimal128(38, 0)]
    again = "cluster" in rows.columns

    def table(rows_: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows_, t) for c, t in zip(names, types)], names=names)

    def lists(values: np.ndarray, t) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * dims, pa.int32()), pa.array(values.reshape(-1), t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, scanned, spread = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0, [0] * k
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dims)
            get = lambda c: np.array(batch.column(c).to_numpy(zero_copy_only=False))  # noqa: B023, E731
            cluster, upper, lower, distance, more = move.assign(v, get("cluster").astype(np.int64) if again else None, get("upper") if again else None, get("lower") if again else None)
            scanned += more
            order = np.argsort(cluster, kind="stable")
            at = np.searchsorted(cluster[order], np.arange(k + 1))
            for j in np.flatnonzero(np.diff(at)):
                own = order[at[j]:at[j + 1]]
                sums[j] += v[own].sum(0)
                counts[j] += len(own)
                spread[j] += sum(map(int, distance[own])) if distance[own].max() > 1 << 40 else int(distance[own].sum())
            yield table(n, kind=pa.array(np.zeros(n), pa.int32()), vec_id=batch.column("vec_id"), v=lists(v, pa.int32()), cluster=pa.array(cluster, pa.int32()), upper=pa.array(upper), lower=pa.array(lower), distance=pa.array(distance))
        j = np.flatnonzero(counts)
        yield table(len(j), kind=pa.array(np.ones(len(j)), pa.int32()), cluster=pa.array(j, pa.int32()), sums=lists(sums[j], pa.int64()), n=pa.array(counts[j]), scanned=pa.array([scanned] + [0] * (len(j) - 1) if len(j) else [], pa.int64()), spread=pa.array([spread[i] for i in j], pa.decimal128(38, 0)))

    rows.mapInArrow(run, STATE).write.parquet(path)
    return spark.read.schema(STATE).parquet(path)


class Total(NamedTuple):
    """Of one centroid's vectors: how many, their distances' sum, how many were scanned, componentwise sums."""

    n: int
    spread: int
    scanned: int
    sums: dict[int, int]


def _totals(state: DataFrame) -> dict[int, Total]:
    """The tasks' sums added up by Spark: K numbers for each component come to the driver."""
    rows = state.where("kind = 1").select("cluster", "n", "spread", "scanned", F.posexplode("sums").alias("at", "x"))
    first = lambda c: F.sum(F.when(F.col("at") == 0, F.col(c))).alias(c)
    found: dict[int, Total] = {}
    for r in rows.groupBy("cluster", "at").agg(F.sum("x").alias("x"), first("n"), first("spread"), first("scanned")).collect():
        one = found.setdefault(r.cluster, Total(0, 0, 0, {}))
        one.sums[r["at"]] = r.x
        if r["at"] == 0:
            found[r.cluster] = Total(r.n, int(r.spread), r.scanned, one.sums)
    return found


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, DataFrame, list[int]]:
    """Members (vec_id, v, cluster, upper, lower, distance), centroids (cluster, centroid, n, spread) and how many vectors each pass scanned."""
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector_col, dims, scale)
    now = first_centroids(rows, k)
    if not len(now):
        none = spark.createDataFrame([], "vec_id long, v array<int>, cluster int, upper double, lower double, distance long")
        return none, spark.createDataFrame([], "cluster int, centroid array<long>, n long, spread decimal(38,0)"), []
    move, scans, path = Move(now), [], ""
    for done in range(rounds + 1):
        last, path = path, new_path(spark, f"bounds-{done}")
        state = _pass(rows, move, path)
        removed(spark, last)
        totals = _totals(state)
        scans.append(sum(t.scanned for t in totals.values()))
        rows = state.where("kind = 0").select("vec_id", "v", "cluster", "upper", "lower")
        if done < rounds:
            moved = move.now.copy()
            for j, t in totals.items():
                moved[j] = [t.sums[i] // t.n for i in range(dims)]
            move = Move(moved, move.now)
    members = state.where("kind = 0").select("vec_id", "v", "cluster", "upper", "lower", "distance")
    empty = Total(0, 0, 0, {})
    centres = [(j, [int(x) for x in c], totals.get(j, empty).n, Decimal(totals.get(j, empty).spread)) for j, c in enumerate(move.now)]
    return members, spark.createDataFrame(centres, "cluster int, centroid array<long>, n long, spread decimal(38,0)"), scans
