"""Ranking inside blocks: what leaves a block doesn't grow with its postings, and ranks are those of all scores."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import segments
from tarnwell.operators.retrieval import TextIndex, query_terms, top


@pytest.mark.parametrize("cells", [4_000_000, 50])
def test_blocks_hand_on_their_best(spark, tmp_path, monkeypatch, cells):
    monkeypatch.setattr(segments, "CELLS", cells)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9))) if i % 3 else "w1 w2 w3", "s") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    idx = segments.SegmentedIndex.create(spark, f"file://{tmp_path}/i", docs.where("doc_id < 200"), block_docs=64).add(docs.where("doc_id >= 150"))
    idx = idx.delete(docs.where("doc_id % 6 = 0").select("doc_id"))
    asked = query_terms(spark.createDataFrame([(q, " ".join(rng.choices([*words, "none"], k=4))) for q in range(9)], "query_id long, query string"))
    want = top(idx.scores(asked).where("score > 0"), 3).select("query_id", "doc_id", "score", "rank")
    assert sorted(map(tuple, idx.search(asked, 3).collect())) == sorted(map(tuple, want.collect()))
    plain = TextIndex(docs.where("doc_id % 6 <> 0"))
    assert sorted(map(tuple, idx.tfidf_search(asked, 3).collect())) == sorted(map(tuple, plain.tfidf_search(asked, 3).collect()))
    weighted = asked.select("query_id", "term", F.col("qtf").alias("w"))
    blocks = idx.blocks().select("segment", "block").distinct().count()
    handed = idx._ranked(weighted, None, 3, idx.config).count()
    assert handed <= 9 * blocks * 12 and handed < idx.scores(asked).count()
