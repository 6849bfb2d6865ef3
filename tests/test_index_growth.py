"""Building and reading the text index: what one task holds, and what is shuffled, doesn't grow with texts or postings."""

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import retrieval as R
from tarnwell.operators import segments

DOC = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"all some{i % 7} rare{i // 2} all 中文", "s") for i in range(160)], DOC)


def test_tasks_follow_blocks(spark, tmp_path, monkeypatch, docs):
    """As many tasks write as there are groups of blocks, whatever the number of shuffle partitions (4)."""
    monkeypatch.setattr(segments, "TASK_BLOCKS", 1)
    idx = segments.SegmentedIndex.create(spark, f"file://{tmp_path}/i", docs, block_docs=8)
    tasks = {p.name.split("-")[1] for p in tmp_path.rglob("segments/*/blocks/*/part-*.parquet")}
    assert len(tasks) > 8
    plain = R.TextIndex(docs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(idx.postings()) == rows(plain.postings().select("doc_id", "dl", "term", "tf"))
    assert rows(idx.frequencies()) == rows(plain.frequencies())
    # a term's documents of a block are one row
    blocks = idx.blocks()
    assert blocks.count() == blocks.select("block", "term").distinct().count()


@pytest.mark.parametrize("few, least", [(500_000, 1), (20, 4), (10, 32), (0, 256)])
def test_norms_of_common_and_rare_terms(spark, tmp_path, monkeypatch, docs, few, least):
    monkeypatch.setattr(segments, "FEW_TERMS", few)
    idx = segments.SegmentedIndex.create(spark, f"file://{tmp_path}/i", docs, block_docs=16)
    assert idx._common_from(idx.frequencies()) == least
    want = {r.doc_id: r.norm for r in R.TextIndex(docs).tfidf_norms().collect()}
    assert {r.doc_id: r.norm for r in idx.tfidf_norms().collect()} == pytest.approx(want)


def test_texts_of_few_hits_are_not_shuffled(spark, tmp_path, monkeypatch, docs):
    idx = segments.SegmentedIndex.create(spark, f"file://{tmp_path}/i", docs)
    hits = spark.createDataFrame([(q, 2 * q) for q in range(5)] + [(9, 999)], "query_id long, doc_id long")
    found = {}
    for few in (500_000, 0):
        monkeypatch.setattr(R, "FEW_HITS", few)
        df = R.with_documents(idx, hits, "text")
        found[few] = sorted(map(tuple, df.select("query_id", "doc_id", "text").collect()))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert ("broadcast" in plan) == (few > 0)
    assert found[0] == found[500_000] and [r[1] for r in found[0]] == [0, 2, 4, 6, 8]


def test_no_task_has_more_than_its_share_of_blocks(spark, tmp_path, monkeypatch, docs):
    """Neither when blocks are made nor when they are searched, in one segment or in several."""
    monkeypatch.setattr(segments, "TASK_BLOCKS", 2)
    idx = segments.SegmentedIndex.create(spark, f"file://{tmp_path}/i", docs, block_docs=8)
    held = {}
    for p in tmp_path.rglob("segments/*/blocks/*/part-*.parquet"):
        held.setdefault(p.name.split("-")[1], set()).update(r.block for r in spark.read.parquet(f"file://{p}").select("block").distinct().collect())
    assert sorted(map(len, held.values())) == [2] * 10
    batch = spark.createDataFrame([(1, "all", 1.0), (2, "some3", 1.0)], "query_id long, term string, qtf double")
    both = idx.add(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    assert len(both.manifest.segments) == 2
    for index, tasks in ((idx, 10), (both, 20)):
        weighted = batch.join(index.term_stats(), "term").select("query_id", "term", F.col("idf").alias("w"))
        for found in (index.scores(batch), index._ranked(weighted, None, 1000, index.config)):
            block = F.struct(F.col("doc_id") >= 1000, F.pmod(F.xxhash64("doc_id"), F.lit(20)))
            shares = found.groupBy(F.spark_partition_id()).agg(F.count_distinct(block).alias("n")).collect()
            assert sorted(r.n for r in shares) == [2] * tasks
