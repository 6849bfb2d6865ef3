"""The vector index: exact search by brute force, measured recall, odd rows, atomic save, migration."""

import numpy as np
import pytest

from tarnwell.operators import vectors as V
from tarnwell.operators.vectors import VectorIndex

ROW = "doc_id long, v array<float>, text string, source string"


def points(n, dims=6, seed=1, unit=False):
    rng = np.random.default_rng(seed)
    x = np.float32(rng.normal(size=(8, dims))[rng.integers(0, 8, n)] * 3 + rng.normal(size=(n, dims)))
    return np.float32(x / np.linalg.norm(x, axis=1, keepdims=True)) if unit else x


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v], f"text {first + i}", "s") for i, v in enumerate(x)], ROW).repartition(4)


def asked(spark, q):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(q)], "query_id long, q array<double>")


def brute(x, q, k, metric, first=0):
    out = []
    for i, v in enumerate(q.astype(float)):
        s = x.astype(float) @ v if metric == "dot" else -((x.astype(float) - v) ** 2).sum(1)
        best = sorted((-round(c, 6), first + j) for j, c in enumerate(s))[:k]
        out += [(i, j, r + 1) for r, (_, j) in enumerate(best)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.doc_id, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_exact_search(spark, tmp_path, metric):
    x, q = points(400, unit=metric == "dot"), points(15, seed=2, unit=metric == "dot")
    index = VectorIndex.create(spark, f"file://{tmp_path}/v", frame(spark, x), n_cells=12)
    again = VectorIndex.open(spark, f"file://{tmp_path}/v")
    assert again.cells == index.cells and index.cells.n == 400 and 1 < index.cells.n_cells <= 12
    assert got(again.search(asked(spark, q), 7, metric, probes=1, exact=True)) == brute(x, q, 7, metric)
    assert got(again.search(asked(spark, q), 7, metric, probes=12)) == brute(x, q, 7, metric)
    q = x[::27]
    pruned = set((a, b) for a, b, _ in got(again.search(asked(spark, q), 7, metric)))
    exact = set((a, b) for a, b, _ in brute(x, q, 7, metric))
    recall = {r.query_id: r.recall for r in again.recall(asked(spark, q), 7, metric).collect()}
    assert len(pruned & exact) >= 0.9 * len(exact)
    assert recall == {i: round(sum(p[0] == i for p in pruned & exact) / 7, 6) for i in range(15)}


def test_many_copies_of_one_vector(spark, tmp_path):
    """A third of the rows is one vector: the smallest ids of them are found, and a task doesn't pass on all."""
    x = points(300)
    x[100:200] = x[7]
    index = VectorIndex.create(spark, f"file://{tmp_path}/v", frame(spark, x), n_cells=5)
    q = np.concatenate((x[7:8], points(3, seed=5)))
    assert got(index.search(asked(spark, q), 4, exact=True)) == brute(x, q, 4, "l2")
    keep = V._first_of_ties(np.array([1.0, 2.0, 1.0, 1.0, 0.0]), __import__("pyarrow").array([9, 8, 7, 6, 5]), np.array([True] * 4 + [False]), 2)
    assert keep.tolist() == [False, True, True, True, False]


def test_queries_in_blocks(spark, tmp_path, monkeypatch):
    x, q = points(120), points(20, seed=3)
    index = VectorIndex.create(spark, f"file://{tmp_path}/v", frame(spark, x), n_cells=4)
    monkeypatch.setattr(V, "QUERY_BLOCK", 6)
    assert got(index.search(asked(spark, q), 3, exact=True)) == brute(x, q, 3, "l2")


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "a", "s"), (1, [1.0, 0.0], "a", "s"), (2, None, "b", None), (3, [1.0], "c", "s"), (4, [nan, 1.0], "d", "s"), (5, [inf, 0.0], "e", "s"), (6, [None, 0.0], "f", "s"), (None, [0.0, 1.0], "g", "s"), (7, [0.0, 1.0], None, "s")]
    index = VectorIndex.create(spark, f"file://{tmp_path}/v", spark.createDataFrame(rows, ROW))
    assert (index.cells.n, index.cells.left_out, index.cells.dims) == (3, 6, 2)
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (None, [1.0, 0.0])], "query_id long, q array<double>")
    assert [(r.query_id, r.doc_id, r.score) for r in index.search(q, 5, "dot", exact=True).orderBy("rank").collect()] == [(1, 1, 1.0), (1, 1, 1.0), (1, 7, 0.1)]
    with pytest.raises(Exception, match="another length"):
        index.search(spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>"), 5)
    with pytest.raises(ValueError):
        index.search(q, 5, "cosine")
    none = VectorIndex.create(spark, f"file://{tmp_path}/none", spark.createDataFrame([], ROW))
    assert none.cells.n_cells == 0 and none.search(q, 5).count() == 0 and VectorIndex.open(spark, none.path).cells.n == 0
    other = VectorIndex.create(spark, f"file://{tmp_path}/w", spark.createDataFrame([(1, [2.0, 0.0], "", "")], ROW))
    with pytest.raises(ValueError, match="length 1"):
        other.search(q, 5, "dot")


def test_save_again_damage_clear_and_migration(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    assert VectorIndex.open(spark, path) is None
    old = VectorIndex.create(spark, path, frame(spark, points(30)))
    VectorIndex.create(spark, path, frame(spark, points(20), first=100))
    assert VectorIndex.open(spark, path).cells.n == 20 and old.search(asked(spark, points(2)), 3).count() == 6
    text = VectorIndex.open(spark, path).to_text_index(f"file://{tmp_path}/t")
    assert text.manifest.n == 20 and {r.doc_id for r in text.documents.collect()} == set(range(100, 120))
    manifest = max((tmp_path / "v/manifest").glob("0*.json"))
    manifest.write_text(manifest.read_text()[:-4])
    assert VectorIndex.open(spark, path) is None
    old.clear()
    assert not (tmp_path / "v").exists()
