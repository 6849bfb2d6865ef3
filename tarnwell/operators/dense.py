"""Dense search of a stated query set against all rows, by blocks of queries and parts of rows that meet in tasks.

Both sides are dealt by Spark: each part of the rows meets each block of queries once, as two matrices, and hands on the k best rows of each query
(and what may tie with them after rounding), so what is shuffled afterwards grows with queries and parts, not with pairs.  Where every pair is a row
of the result, rows are dealt once and streamed past blocks of queries that are sent to the tasks, so nothing but the result grows with the pairs.
Vectors that are no finite numbers of the usual length are left to ``irregular``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries of a block and rows of a part of searches.
SEARCH = (2_000, 50_000)
#: Where every pair is a row of the result: numbers of a block of queries that is sent to the tasks, and pairs handed on at once.
SENT, PAIRS = 4_000_000, 500_000
#: Cells of a matrix of scores held at once.
_CELLS = 4_000_000
#: More than what rounding to six digits and sums of floats can move a score by.
SLACK = 1e-5


def first_of_ties(scores: np.ndarray, ids: pa.Array, among: np.ndarray, k: int) -> np.ndarray:
    """Of rows with one score (copies of a vector) only the k with the smallest ids can be among the k best."""
    at = np.flatnonzero(among)
    level = np.round(scores[at], 10)
    rank = np.empty(len(ids), np.int64)
    rank[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    order = np.lexsort((rank[at], level))
    first = np.concatenate(([True], level[order][1:] != level[order][:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    out = np.zeros(len(scores), bool)
    out[at[order[np.arange(len(order)) - start < k]]] = True
    return out


def regular(v: str, dims: int) -> Column:
    """Whether a vector has the usual length and finite numbers only."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(v) == dims) & finite, F.lit(False))


def _dealt(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, sizes: tuple[int, int]) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with the block and the part in which they meet, a task for a few of these."""
    wanted = 4 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = -(-n_queries // sizes[0])
    parts = max(-(-n_rows // sizes[1]), min(-(-wanted // blocks), -(-n_rows // 500)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", each(parts))
    r = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).withColumn("block", each(blocks))
    tasks = min(blocks * parts, max(wanted, blocks * parts // 4))
    return q.repartition(tasks, "block", "part"), r.repartition(tasks, "block", "part"), tasks


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def best(q: np.ndarray, x: np.ndarray, ids: pa.Array, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and rows, and scores: the k best rows of each query, and those that may tie with the last of them."""
    own, there = (q * q).sum(1), (x * x).sum(1)
    least = np.full(len(q), -np.inf)
    found = []
    wide = max(k, _CELLS // max(len(q), 1))
    for at in range(0, len(x), wide):
        s = q @ x[at:at + wide].T
        if metric == "l2":
            s = 2 * s - own[:, None] - there[None, at:at + wide]
        if s.shape[1] > k and not np.isfinite(least).any():
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        i, j = np.nonzero(s >= least[:, None] - SLACK)
        found.append((i, j + at, s[i, j]))
        if sum(len(f[0]) for f in found) > _CELLS // 4:
            found, least = [_trimmed(found, len(q), ids, k, least)], least
    return _trimmed(found, len(q), ids, k, least)


def _trimmed(found: list, n: int, ids: pa.Array, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The found rows that can still be among the k best; raises ``least`` to the k-th best scores."""
    i, j, s = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((-s, i))
    i, j, s = i[order], j[order], s[order]
    cuts = np.searchsorted(i, np.arange(n + 1))
    full = np.flatnonzero(np.diff(cuts) >= k)
    least[full] = np.maximum(least[full], s[cuts[full] + k - 1])
    keep = s >= least[i] - SLACK
    for r in np.flatnonzero(np.bincount(i[keep], minlength=n) > 4 * k):
        part = slice(cuts[r], cuts[r + 1])
        keep[part] &= first_of_ties(s[part], ids.take(pa.array(j[part])), keep[part], k)
    return i[keep], j[keep], s[keep]


def search_parts(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, dims: int, k: int, metric: str) -> DataFrame:
    """query_id, doc_id, score: each part's best rows of every query, not yet ranked. Sides: (query_id, q), (doc_id, v), regular vectors."""
    q, r, _ = _dealt(queries, rows, n_queries, n_rows, SEARCH)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, names = right["doc_id"].combine_chunks(), left["query_id"].combine_chunks()
        if not len(ids) or not len(names):
            i, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            i, j, s = best(_matrix(left["q"], dims), _matrix(right["v"], dims), ids, k, metric)
        return pa.table([names.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s)], names=["query_id", "doc_id", "score"])

    return q.groupBy("block", "part").cogroup(r.groupBy("block", "part")).applyInArrow(run, schema)


def all_cosines(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, dims: int) -> DataFrame:
    """query_id, doc_id, cosine of every pair with two ids, rounded to six digits half away from zero; 0 where a vector has no length."""
    spark = rows.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, cosine double"
    blocks = -(-n_queries * dims // SENT)
    dealt = rows.repartition(max(-(-n_rows // SEARCH[1]), min(4 * spark.sparkContext.defaultParallelism, -(-n_rows // 500))), "doc_id")

    def unit(x: np.ndarray) -> np.ndarray:
        length = np.sqrt((x * x).sum(1))[:, None]
        return np.divide(x, length, out=np.zeros_like(x), where=length > 0)

    def against(block: int) -> DataFrame:
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast(own.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value["query_id"].combine_chunks(), unit(_matrix(sent.value["q"], dims))
            for batch in batches:
                ids = batch.column("doc_id")
                x = unit(_matrix(pa.chunked_array([batch.column("v")]), dims)).T
                wide = max(1, PAIRS // max(len(ids), 1))
                for at in range(0, len(names), wide):
                    s = q[at:at + wide] @ x
                    s = np.copysign(np.floor(np.abs(s) * 1e6 + 0.5) / 1e6, s).ravel() + 0.0
                    n = len(s) // max(len(ids), 1)
                    i, j = np.repeat(np.arange(at, at + n), len(ids)), np.tile(np.arange(len(ids)), n)
                    out = pa.RecordBatch.from_arrays([names.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s)], names=["query_id", "doc_id", "cosine"])
                    yield out.filter(pa.compute.not_equal(out.column("query_id"), out.column("doc_id")))

        return dealt.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(against, range(blocks)))
