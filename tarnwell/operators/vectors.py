"""Vector index: an inverted file of cells, saved as a table partitioned by cell, with pruned and with exact search.

    index = VectorIndex.create(spark, path, vectors)         # doc_id, v, any other columns
    index.search(queries, k)                                 # query_id, q: the calibrated number of nearest cells
    index.search(queries, k, exact=True)                     # every cell that can hold one of the k best
    index.recall(queries, k); index.to_text_index(path)
    VectorIndex.open(spark, path)                            # None if there is none, or it is damaged or of another format

Cells are centroids of a k-means over SAMPLE rows, those with the least hashes of their ids; every row is then in the cell of its
nearest centroid, large cells in several files.  Search sends blocks of queries with the cells that each asks to the tasks, which
read these cells only and multiply the vectors of a cell by its queries at once; a task keeps the k best of each query.

Exact search takes the k-th best distance of the pruned search as a bound, and reads, besides, each cell whose centroid is nearer than that bound and the
cell's radius together.  Ranking is by squared distance, or by dot product where all vectors have one length (which is checked), so that both
have the same order.  ``probes`` is the least number of cells with which CALIBRATION stored rows, asked as queries, find at least TARGET of their
neighbours in the sample's cells, measured when the index is made.

Defined results: rows with a null id or vector, with null or non-finite components or another length than most have no place in the
index and are counted in ``left_out``; ids may repeat; an empty table gives an index without cells that finds nothing; queries of another length are an
error; ties go to the smaller id.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators.dense import SLACK
from tarnwell.operators.dense import first_of_ties as _first_of_ties
from tarnwell.operators.retrieval import rounded, top
from tarnwell.operators.segments import Folder, SegmentedIndex

FORMAT = 1
#: Rows that the centroids are fitted on, rows asked to calibrate, most cells, rounds, rows of a file, queries of a block.
SAMPLE, CALIBRATION, MOST_CELLS, ROUNDS, FILE_ROWS, QUERY_BLOCK = 20_000, 200, 4096, 10, 500_000, 5_000
TARGET, NEIGHBOURS = 0.95, 10


@dataclass(frozen=True)
class Cells:
    generation: int
    name: str
    dims: int
    n: int
    left_out: int
    n_cells: int
    probes: int
    unit: bool  # all vectors have length 1


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None], 0.0)


def fitted(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by k-means from the first k rows; those that lose all rows are left out."""
    c = sample[:k].copy()
    for _ in range(rounds):
        at = _squared(sample, c).argmin(1)
        counts = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        c = sums[counts > 0] / counts[counts > 0][:, None]
    return c


def calibrated(sample: np.ndarray, c: np.ndarray, target: float = TARGET, k: int = NEIGHBOURS, n: int = CALIBRATION) -> int:
    """The least number of cells in which the sample's first n rows find ``target`` of their k neighbours in the sample."""
    if len(sample) < 2 or len(c) < 2:
        return len(c)
    asked = sample[:n]
    d = _squared(asked, sample)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    cell = _squared(sample, c).argmin(1)
    order = np.argsort(_squared(asked, c), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(c)), order.shape), 1)
    needed = np.take_along_axis(place, cell[near], 1).ravel() + 1
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, cells: Cells):
        self.spark, self.path, self.cells = spark, path.rstrip("/"), cells
        self.folder = Folder(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, vectors: DataFrame, n_cells: int = 0, sample: int = SAMPLE) -> VectorIndex:
        """An index of these rows only; what is at the path stays readable until it is whole."""
        folder, name = Folder(spark, path), uuid.uuid4().hex
        at = f"{path.rstrip('/')}/versions/{name}"
        v = F.col("v")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        size = vectors.where(v.isNotNull()).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
        dims = size.d if size else 0
        good = vectors.where(F.col("doc_id").isNotNull() & v.isNotNull() & (F.size("v") == dims) & finite).withColumn("v", v.cast("array<float>"))
        picked = good.select("v", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(sample).select("v").toArrow()
        points = np.array(picked.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(picked.num_rows, max(dims, 1))
        total = vectors.count()
        c = fitted(points, n_cells or min(MOST_CELLS, max(1, int(total**0.5)))) if len(points) else np.zeros((0, max(dims, 1)))
        dealt = cls._dealt(good, c)
        dealt.write.parquet(f"{at}/dealt")
        rows = spark.read.parquet(f"{at}/dealt")
        counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"), F.min("length").alias("least"), F.max("length").alias("most"))
        found = {r.cell: r for r in counts.collect()}
        files = spark.createDataFrame([(i, -(-r.n // FILE_ROWS)) for i, r in found.items()], "cell int, files long")
        split = rows.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.xxhash64("doc_id"), F.col("files")))
        split.repartition("cell", "file").drop("file", "files", "distance", "length").write.partitionBy("cell").parquet(f"{at}/rows")
        folder.delete(f"versions/{name}/dealt")
        table = [(i, [float(x) for x in c[i]], r.n, float(r.radius) ** 0.5) for i, r in found.items()]
        spark.createDataFrame(table, "cell int, centroid array<double>, n long, radius double").coalesce(1).write.parquet(f"{at}/cells")
        n = sum(r.n for r in found.values())
        unit = bool(found) and all(abs(x - 1) < 1e-4 for r in found.values() for x in (r.least, r.most))
        generation = max((int(g.partition(".")[0]) for g in folder.names("manifest") if g[0] != "."), default=-1) + 1
        cells = Cells(generation, name, dims, n, total - n, len(found), calibrated(points, c), unit)
        body = json.dumps(asdict(cells) | {"format": FORMAT}, sort_keys=True)
        folder.put_once(f"manifest/{generation:010d}.json", json.dumps({"check": hashlib.sha256(body.encode()).hexdigest(), "body": body}))
        return cls(spark, path, cells)

    @staticmethod
    def _dealt(rows: DataFrame, c: np.ndarray) -> DataFrame:
        """The rows with their cell, squared distance to its centroid, and length."""
        schema = rows.withColumns({"cell": F.lit(0), "distance": F.lit(0.0), "length": F.lit(0.0)}).schema
        dims = c.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                if len(x):
                    d = _squared(x, c)
                    more = [pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1)), pa.array(np.sqrt((x * x).sum(1)))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "cell", "distance", "length"])

        return rows.mapInArrow(run, schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex | None:
        folder = Folder(spark, path)
        names = [g for g in folder.names("manifest") if g[0] != "."]
        try:
            outer = json.loads(folder.read(f"manifest/{names[-1]}"))
            found = json.loads(outer["body"])
            if hashlib.sha256(outer["body"].encode()).hexdigest() != outer["check"] or found.pop("format") != FORMAT:
                return None
            cells = Cells(**found)
        except (IndexError, ValueError, KeyError, TypeError):
            return None
        return cls(spark, path, cells) if all(folder.exists(f"versions/{cells.name}/{t}/_SUCCESS") for t in ("rows", "cells")) else None

    def clear(self) -> None:
        self.folder.delete()

    # -- search ---------------------------------------------------------------------------------------------------------

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/versions/{self.cells.name}/rows")

    def _centroids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centroids and radii of the cells: at most MOST_CELLS rows."""
        rows = self.spark.read.parquet(f"{self.path}/versions/{self.cells.name}/cells").orderBy("cell").collect()
        return np.array([r.cell for r in rows]), np.array([r.centroid for r in rows]), np.array([r.radius for r in rows])

    def search(self, queries: DataFrame, k: int = 10, metric: str = "l2", probes: int = 0, exact: bool = False) -> DataFrame:
        """query_id, doc_id, score, rank; score is the negative squared distance, or the dot product. queries: query_id, q."""
        if metric not in ("l2", "dot"):
            raise ValueError(f"no metric {metric}")
        if metric == "dot" and self.cells.n and not self.cells.unit:
            raise ValueError("cells rank by distance: for dot products all vectors need length 1")
        found = None
        for block in self._blocks(queries):
            one = self._search_block(*block, k, metric, min(probes or self.cells.probes, self.cells.n_cells), exact)
            found = one if found is None else found.unionByName(one)
        if found is None:
            ids = {"query_id": queries.schema["query_id"].dataType.simpleString(), "doc_id": self.rows.schema["doc_id"].dataType.simpleString() if self.cells.n else "bigint"}
            return self.spark.createDataFrame([], f"query_id {ids['query_id']}, doc_id {ids['doc_id']}, score double, rank int")
        return top(found.withColumn("score", rounded(F.col("score")) + 0.0), k).select("query_id", "doc_id", "score", "rank")

    def _blocks(self, queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Blocks of a stated query set, one after the other in the driver."""
        if not self.cells.n:
            return
        good = queries.where(F.col("query_id").isNotNull() & F.col("q").isNotNull()).select("query_id", F.when(F.size("q") == self.cells.dims, F.col("q").cast("array<double>")).otherwise(F.raise_error(F.lit("a query vector has another length"))).alias("q"))
        n = good.count()
        parts = -(-n // QUERY_BLOCK)
        for i in range(parts):
            own = good if parts == 1 else good.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
            table = own.toArrow().combine_chunks()
            if table.num_rows:
                yield table.column("query_id").combine_chunks(), table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def _search_block(self, ids: pa.Array, q: np.ndarray, k: int, metric: str, probes: int, exact: bool) -> DataFrame:
        numbers, c, radius = self._centroids()
        far = np.sqrt(_squared(q, c))
        near = np.argsort(far, axis=1, kind="stable")
        asks = np.zeros(far.shape, bool)
        np.put_along_axis(asks, near[:, :probes], True, 1)
        first = self._scan(ids, q, numbers, asks, k, metric)
        if not exact:
            return first
        # the k-th best of what the nearest cells hold bounds what others may add
        sized = top(first, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).collect()
        least = {r.query_id: r.least for r in sized if r.n >= k}
        bound = np.array([np.sqrt(max(0.0, -x if metric == "l2" else (q[i] @ q[i]) + 1 - 2 * x)) if (x := least.get(key)) is not None else np.inf for i, key in enumerate(ids.to_pylist())])
        more = (far - radius[None] <= bound[:, None] + SLACK) & ~asks
        return first.unionByName(self._scan(ids, q, numbers, more, k, metric)) if more.any() else first

    def _scan(self, ids: pa.Array, q: np.ndarray, numbers: np.ndarray, asks: np.ndarray, k: int, metric: str) -> DataFrame:
        """query_id, doc_id, score: of the asked cells each task's k best of every query, and what may tie with them after rounding."""
        wanted = numbers[asks.any(0)]
        column = {int(x): i for i, x in enumerate(numbers)}
        rows = self.rows.where(F.col("cell").isin([int(x) for x in wanted])).select("doc_id", "v", "cell")
        sent = self.spark.sparkContext.broadcast((ids, q, asks))
        doc_type = rows.schema["doc_id"].dataType.simpleString()
        query_type = {pa.int64(): "bigint", pa.int32(): "int"}.get(ids.type, "string")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, points, asked = sent.value
            own = (points * points).sum(1)
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cell), -1)
                out_q, out_d, out_s = [], [], []
                for number in np.unique(cell):
                    at, who = np.flatnonzero(cell == number), np.flatnonzero(asked[:, column[int(number)]])
                    s = points[who] @ x[at].T
                    if metric == "l2":
                        s = 2 * s - own[who][:, None] - (x[at] * x[at]).sum(1)[None]
                    if len(at) > k:
                        keep = s >= np.partition(s, len(at) - k, axis=1)[:, [len(at) - k]] - SLACK
                    else:
                        keep = np.ones(s.shape, bool)
                    for r in np.flatnonzero(keep.sum(1) > 4 * k):
                        keep[r] &= _first_of_ties(s[r], batch.column("doc_id").take(pa.array(at)), keep[r], k)
                    i, j = np.nonzero(keep)
                    out_q.append(who[i])
                    out_d.append(at[j])
                    out_s.append(s[i, j])
                if out_q:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(out_q))), batch.column("doc_id").take(pa.array(np.concatenate(out_d))), pa.array(np.concatenate(out_s))], names=["query_id", "doc_id", "score"])

        return rows.mapInArrow(run, f"query_id {query_type}, doc_id {doc_type}, score double")

    def recall(self, queries: DataFrame, k: int = 10, metric: str = "l2", probes: int = 0) -> DataFrame:
        """query_id, recall: share of the exact search's rows that the pruned one finds."""
        pruned = self.search(queries, k, metric, probes).select("query_id", "doc_id", F.lit(1).alias("hit"))
        both = self.search(queries, k, metric, exact=True).join(pruned, ["query_id", "doc_id"], "left")
        return both.groupBy("query_id").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))

    def to_text_index(self, path: str) -> SegmentedIndex:
        """A text index of the texts that were saved with the vectors (columns text and, if there is one, source)."""
        return SegmentedIndex.create(self.spark, path, self.rows.drop("v", "cell"))
