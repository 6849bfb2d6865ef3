"""Similarity join: copies dealt over tasks, and pairs of large components."""

import numpy as np
import pyarrow as pa

from tarnwell.llm import jaccard



def test_jaccard_filter_with_copies_in_other_tasks(spark, monkeypatch):
    """Texts that have nothing in common but their exact copies don't get past the filter, wherever the copies are."""
    left = []
    whole = jaccard.may_have_links
    monkeypatch.setattr(jaccard, "may_have_links", lambda *x: left.append(whole(*x)) or left[-1])
    rows = [(100 * c + i, " ".join(f"t{i}w{k}" for k in range(40))) for c in range(4) for i in range(20)] + [(7, " ".join(f"t7w{k}" for k in range(40)))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id")
    assert {(r.id, r.component) for r in jaccard.join(docs, 3, 90, 100).collect()} == {(i, i % 100) for i, _ in rows}
    assert [x.count() for x in left] == [0, 0]


def test_jaccard_compares_few_pairs_of_two_components():
    """Two leaves of near copies with a label each: their pairs don't all become rows, but do where they are asked for."""
    base = np.sort(np.random.default_rng(5).integers(0, 2**63, 200).astype(np.uint64))
    leaves = []
    for leaf in range(2):
        sets = [np.delete(base, [leaf * 100 + k]) for k in range(40)]
        own = jaccard.Sets.of(list(range(leaf * 40, leaf * 40 + 40)), sets, jaccard.n_bits(200), [leaf] * 40)
        leaves.append((9, leaf, 0, 0, 0, *(x.tobytes() for x in (own.names, own.sizes, own.slack, own.labels, own.bits))))
    tile = pa.table(list(map(list, zip(*leaves))), names=["grp", "leaf", "tile", "tile_a", "tile_b", *jaccard._SUMMARY])
    few = jaccard._close_sets(80, 100, jaccard.CANDIDATES)(tile).to_pylist()
    assert len(few) == jaccard.CANDIDATES and all(r["cut"] and r["a"] < 40 <= r["b"] for r in few)
    assert jaccard._close_sets(80, 100, 0)(tile).num_rows == 1600
