"""Dense search in blocks: brute force, copies of a vector, odd vectors, cosines of all pairs."""

import math

import numpy as np
import pytest

from tarnwell.operators import dense
from tarnwell.operators import retrieval as R


def frames(spark, q, v):
    return spark.createDataFrame([(i, x) for i, x in q], "query_id long, q array<float>"), spark.createDataFrame([(i, x) for i, x in v], "doc_id long, v array<float>").repartition(3)


def score(a, b, metric):
    return sum(x * y for x, y in zip(a, b)) if metric == "dot" else -sum((x - y) ** 2 for x, y in zip(a, b))


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_parts_and_blocks(spark, monkeypatch, metric):
    """Many blocks and parts, matrices of few cells, and half of the rows one vector: ranks are those of all pairs, and no part hands on more than it has to."""
    monkeypatch.setattr(dense, "SEARCH", (7, 40))
    monkeypatch.setattr(dense, "_CELLS", 60)
    rng = np.random.default_rng(4)
    v = [(i, [float(c) for c in rng.integers(-9, 9, 3)]) for i in range(300)]
    v = [(i, v[0][1] if i % 2 else x) for i, x in v]
    q = [(i, x) for i, x in v if i % 15 == 0]
    got = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in R.dense_search(*frames(spark, q, v), 5, metric).collect())
    want = []
    for i, x in q:
        want += [(i, d, s + 0.0, n + 1) for n, (s, d) in enumerate(sorted(((score(x, y, metric), d) for d, y in v), key=lambda p: (-p[0], p[1]))[:5])]
    assert got == sorted(want)
    i, _, _ = dense.best(np.array([x for _, x in q]), np.array([x for _, x in v]), __import__("pyarrow").array([d for d, _ in v]), 5, metric)
    assert np.bincount(i).max() <= 20


def test_search_plan_has_no_row_for_each_pair(spark):
    """Rows that reach the ranking follow from queries, k and parts."""
    rng = np.random.default_rng(6)
    v = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(2000)]
    q, rows = frames(spark, v[::20], v)
    handed = dense.search_parts(q, rows, 100, 2000, 4, 3, "dot").count()
    parts = min(16, 4)
    assert handed <= 100 * parts * 12 < 100 * 2000


def written(plan) -> int:
    """Rows that a finished plan wrote to shuffles; an exchange that is used again counts once."""
    name = plan.getClass().getSimpleName()
    if name.startswith("Reused"):
        return 0
    inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
    below = [inner] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("shuffleRecordsWritten")
    return (own.get().value() if own.isDefined() else 0) + sum(map(written, below))


@pytest.mark.parametrize("sent", [4_000_000, 2_000])
def test_all_cosines_shuffle_each_row_once(spark, monkeypatch, sent):
    """Whatever the number of blocks of queries, what is written grows with the rows, not with the pairs; cosines are those of all pairs."""
    monkeypatch.setattr(dense, "SENT", sent, raising=False)
    rng = np.random.default_rng(8)
    v = [(i, [float(c) for c in rng.integers(-9, 9, 4)]) for i in range(1000)]
    q, rows = frames(spark, v, v[::5])
    pairs = R.cosine_pairs(q, rows)
    x = np.array([y for _, y in v])
    length = np.sqrt((x * x).sum(1))
    length[length == 0] = 1
    want = (x / length[:, None]) @ (x / length[:, None])[::5].T
    got = pairs.collect()
    assert {(r.query_id, r.doc_id) for r in got} == {(a, b) for a, _ in v for b, _ in v[::5] if a != b} and len(got) == 1000 * 200 - 200
    assert all(abs(r.cosine - want[r.query_id, r.doc_id // 5]) <= 6e-7 for r in got)
    assert written(pairs._jdf.queryExecution().executedPlan()) <= len(v[::5]) + 3


def test_odd_vectors(spark):
    nan = float("nan")
    v = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [0.0, 0.0]), (None, [1.0, 1.0])]
    q = [(1, [1.0, 0.0]), (7, None)]
    pairs = [(a, x, b, y) for a, x in q for b, y in v]
    found = R.dense_search(*frames(spark, q, v), 99).collect()
    assert sorted((r.query_id, r.doc_id or 0) for r in found) == sorted((a, b or 0) for a, _, b, _ in pairs)
    said = {(r.query_id, r.doc_id): r.score for r in found}
    assert (said[1, 1], said[1, 2], said[1, 6], said[1, None], said[1, 3], said[7, 1]) == (1.0, 0.0, 0.0, 1.0, None, None) and math.isnan(said[1, 5])
    cos = {(r.query_id, r.doc_id): r.cosine for r in R.cosine_pairs(*frames(spark, q, v)).collect()}
    assert set(cos) == {(a, b) for a, _, b, _ in pairs if b is not None and a != b}
    assert (cos[1, 2], cos[1, 6], cos[1, 3]) == (0.0, 0.0, None)
    assert R.dense_search(*frames(spark, [(7, None)], []), 3).count() == 0
