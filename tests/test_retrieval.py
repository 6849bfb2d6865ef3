"""Ranking, fusion, chunking and statistics against known answers and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import text as T
from tarnwell.operators import chunking
from tarnwell.operators import events as E
from tarnwell.operators import retrieval as R


def search(spark, docs, query, k=5, config=R.BM25()):
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    asked = R.query_terms(spark.createDataFrame([(1, query)], "query_id int, query string"))
    return [(r.doc_id, r.score) for r in R.TextIndex(rows, config).search(asked, k).orderBy("rank").collect()]


def test_no_common_term_gives_nothing(spark):
    assert search(spark, ["alpha beta", "gamma"], "delta") == []


def test_shorter_document_ranks_higher(spark):
    assert [i for i, _ in search(spark, ["alpha " + "x y z " * 9, "alpha beta", "gamma"], "alpha")] == [1, 0]


def test_repeats_count_with_k1(spark):
    docs = ["alpha alpha alpha alpha", "beta"]
    assert search(spark, docs, "alpha", config=R.BM25(k1=0.0))[0][1] < search(spark, docs, "alpha")[0][1]


def test_repeated_query_terms_count_again(spark):
    docs = ["alpha beta", "gamma"]
    assert search(spark, docs, "alpha alpha")[0][1] == pytest.approx(2 * search(spark, docs, "alpha")[0][1], abs=2e-6)


def test_blank_documents_are_left_out(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "  \n"), (3, None)], "doc_id int, text string")
    assert R.TextIndex(rows).stats().first().n == 1


def test_row_order_and_partitions_do_not_matter(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    asked = R.query_terms(spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 60).alias("query")))
    a = R.TextIndex(rows).search(asked, 3)
    b = R.TextIndex(rows.repartition(7).orderBy(F.desc("doc_id"))).search(asked, 3)
    assert sorted(a.collect()) == sorted(b.collect())


def test_rrf_is_a_union_and_weights_flip(spark):
    lists = spark.createDataFrame([(1, "a", 10, 1), (1, "a", 11, 2), (1, "b", 11, 1), (1, "b", 12, 2)], "query_id int, list_id string, doc_id int, rank int")
    score = {r.doc_id: r.score for r in R.rrf(lists).collect()}
    assert set(score) == {10, 11, 12} and score[11] == round(1 / 61 + 1 / 62, 6) == max(score.values())
    heavy = {r.doc_id: r.score for r in R.rrf(lists, weights={"a": 5.0, "b": 0.0}).collect()}
    assert set(heavy) == {10, 11} and heavy[10] > heavy[11]


def test_mmr_moves_a_near_duplicate_back(spark):
    rows = [(1, 0, 1, 1.0, ["a", "b", "c"]), (1, 1, 2, 0.95, ["a", "b", "c"]), (1, 2, 3, 0.5, ["x", "y"])]
    c = spark.createDataFrame(rows, "query_id int, doc_id int, pos int, score double, tokens array<string>")
    assert [r.doc_id for r in R.mmr(c, 0.3).orderBy("rank").collect()] == [0, 2, 1]
    assert [r.doc_id for r in R.mmr(c, 1.0).orderBy("rank").collect()] == [0, 1, 2]
    assert R.mmr(c.where("doc_id = 0")).first().mmr_score == 1.0


def test_mmr_takes_the_best_of_the_rest_each_time(spark):
    """Every choice is checked against the definition: no other candidate that is left has a greater marginal relevance."""
    rng = random.Random(12)
    rows = [(q, 10 * q + i, i, round(rng.random(), 2) * (q > 0), rng.sample("abcdefgh", rng.randrange(0, 6))) for q in range(6) for i in range(9)]
    frame = spark.createDataFrame(rows, "query_id int, doc_id int, pos int, score double, tokens array<string>")
    out = R.mmr(frame, 0.6).orderBy("query_id", "rank").collect()
    for q in range(6):
        pool = {r[1]: r for r in rows if r[0] == q}
        order = [r.doc_id for r in out if r.query_id == q]
        assert sorted(order) == sorted(pool)
        peak = max(r[3] for r in pool.values())

        def value(doc, before):
            _, _, pos, score, tokens = pool[doc]
            near = [len(set(tokens) & set(pool[o][4])) / len(set(tokens) | set(pool[o][4]) or "x") for o in before]
            return 0.6 * (score / peak if peak else (9 - pos) / 9) - 0.4 * max(near, default=0)

        for i, doc in enumerate(order):
            assert all((value(o, order[:i]), -pool[o][2]) <= (value(doc, order[:i]) + 1e-12, -pool[doc][2] + 99 * (value(o, order[:i]) < value(doc, order[:i]) - 1e-12)) for o in order[i + 1:])


def test_saved_index_equals_a_fresh_one(spark, sf, tmp_path):
    fresh = R.TextIndex(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source"))
    saved = fresh.save(f"file://{tmp_path}/index")
    asked = R.query_terms(spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 60).alias("query")))
    for look in (lambda i: i.search(asked, 3), lambda i: i.tfidf_search(asked, 3), lambda i: R.feedback_terms(i, asked), lambda i: i.stats(), lambda i: i.term_stats()):
        assert sorted(map(tuple, look(fresh).collect())) == sorted(map(tuple, look(saved).collect()))


def test_query_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "doc_id int, v array<double>")
    asked = rows.select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    whole = sorted(map(tuple, R.dense_search(asked, rows, 3).collect()))
    monkeypatch.setattr(R, "QUERY_BLOCK", 8)
    assert sorted(map(tuple, R.dense_search(asked, rows, 3).collect())) == whole


def test_noop_keeps_a_single_score(spark):
    one = spark.createDataFrame([(1, 5, 1, 0.25), (2, 6, 1, 0.5), (2, 7, 2, 0.25)], "query_id int, doc_id int, rank int, score double")
    assert {(r.query_id, r.doc_id): r.retrieval_score for r in R.noop_rerank(one).collect()} == {(1, 5): 0.25, (2, 6): 2.0, (2, 7): 1.0}


# -- chunks -----------------------------------------------------------------------------------------------------------


def chunked(spark, texts, size, overlap):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("source", F.lit("s"))
    out = [[] for _ in texts]
    for r in chunking.chunk_documents(rows, size=size, overlap=overlap).orderBy("doc_id", "chunk_index").collect():
        out[r.doc_id].append(r.content)
    return out


@pytest.mark.parametrize(
    "text, pieces",
    [
        ("", [""]),
        ("abc", ["abc"]),
        ("aaaa\n\nbbbb\n\ncc", ["aaaa\n\n", "bbbb\n\n", "cc"]),  # coarse separators first
        ("aa bb\ncc dd eee", ["aa bb\n", "cc ", "dd ", "eee"]),  # what is too long goes on to the finer ones
        ("天地玄黄。宇宙洪荒。日月", ["天地玄黄。", "宇宙洪荒。", "日月"]),
        ("abcdefghijklmnopqrs", ["abcdefgh", "ijklmnop", "qrs"]),  # no separator: windows
        ("aaa. bb. cccccccccccc d", ["aaa.", " bb.", " ", "cccccccc", "cccc ", "d"]),
        ("a\nb\n\n\n\nc d e f", ["a\nb\n\n", "\n\n", "c d e f"]),
    ],
)
def test_pieces(spark, text, pieces):
    assert spark.range(1).select(chunking.recursive_split(F.lit(text), 8).alias("p")).first().p == pieces


@pytest.mark.parametrize(
    "pieces, overlap, chunks",
    [
        (["aaaa ", "bbbb ", "cc"], 0, ["aaaa bbbb", "cc"]),
        (["aaaa ", "bbbb ", "cc"], 3, ["aaaa bbbb", "bb cc"]),  # the next chunk begins with the last three characters
        (["abcdefghij", "klmnopqrst"], 4, ["abcdefghij", "ghijklmnop", "mnopqrst"]),  # a chunk that is over-long with them is cut again
        ([" ", "\n"], 2, []),
        ([], 2, []),
    ],
)
def test_merged(spark, pieces, overlap, chunks):
    given = F.array(*map(F.lit, pieces)).cast("array<string>")
    assert spark.range(1).select(chunking.merge_splits(given, 10, overlap).alias("c")).first().c == chunks


def test_chunk_properties(spark):
    """Pieces make the text, none is too long, and each but the last ends where it had to; chunks keep all words in order."""
    rng = random.Random(3)
    texts = ["x" * 137, "。".join("字" * rng.randrange(1, 40) for _ in range(30))]
    texts += ["".join(rng.choice(["word ", "a. ", "\n", "\n\n", "longer-token ", "。", "？"]) for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, p in zip(texts, (r.p for r in frame.select(chunking.recursive_split(F.col("t"), 60).alias("p")).collect())):
        assert "".join(p) == t and all(0 < len(x) <= 60 for x in p) and all(x.endswith(chunking.SEPARATORS) or len(x) == 60 for x in p[:-1])
    for t, none, some in zip(texts, chunked(spark, texts, 60, 0), chunked(spark, texts, 60, 10)):
        assert all(len(c) <= 60 for c in none + some)
        assert "".join("".join(none).split()) == "".join(t.split())
        at = 0
        for c in some:  # each chunk stands in the text, behind the start of the one before
            at = t.index(c, at)
        assert t.rstrip().endswith(some[-1]) if some else not t.strip()


def test_overlap_is_checked():
    with pytest.raises(ValueError):
        chunking.merge_splits(None, 10, 6)


# -- statistics -------------------------------------------------------------------------------------------------------


def test_percentiles(spark):
    r = spark.range(1, 101).agg(*E.summarize(F.col("id").cast("double"))).first()
    assert (r["count"], r.p50, r.p95, r.p99) == (100, 50.5, 95.05, 99.01)


def test_empty_sample_gives_nulls(spark):
    r = spark.range(0).agg(*E.summarize(F.col("id").cast("double"))).first()
    assert r["count"] == 0 and r.p50 is None and r["mean"] is None


def test_sign_test(spark):
    from math import comb

    rows = spark.createDataFrame([(x,) for x in [1.0] * 8 + [-1.0] * 2 + [0.0] * 5], "diff double")
    r = E.sign_test(rows).first()
    assert (r.up, r.down, r.p) == (8, 2, round(2 * sum(comb(10, i) for i in range(3)) / 2**10, 6))


@pytest.mark.parametrize("up, down", [(1600, 1600), (1700, 1500), (0, 0), (3, 0), (2000, 10)])
def test_sign_test_of_many_signs(spark, up, down):
    n = up + down
    exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(up, down) + 1)) / 2**n)
    rows = spark.range(n).select(F.when(F.col("id") < up, 1.0).otherwise(-1.0).alias("diff"))
    assert E.sign_test(rows).first().p == pytest.approx(exact, abs=1e-6)


def test_bootstrap(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([0.5] * 30 + [-0.1] * 10)], "id int, diff double")
    r = E.bootstrap(rows, 400).first()
    assert r.point == pytest.approx(0.35) and r.lo < 0.35 < r.hi and r.p == 0.0
    assert E.bootstrap(rows, 400).first() == r


def test_cache_fold(spark):
    rows = spark.createDataFrame([(1, "k", 0, 1), (2, "k", 5, 1), (3, "k", 10, 1), (4, "k", 12, 1), (5, "z", 0, 0), (6, "z", 1, 1), (7, "z", 2, 1)], "event_id int, key string, at int, n_found int")
    got = {r.event_id: r.outcome for r in E.cache_fold(rows, 10).collect()}
    assert got == {1: "miss", 2: "hit", 3: "miss", 4: "hit", 5: "miss", 6: "miss", 7: "hit"}


def test_streaming_windows_equal_batch(spark, sf, tmp_path):
    from tarnwell.streaming import windows

    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = windows.rate_limit_windows(stream, 1, 3600).writeStream.outputMode("complete").format("memory").queryName("limits").start()
    try:
        q.processAllAvailable()
        got = spark.table("limits").groupBy().agg(F.sum("requests"), F.sum("rejected")).first()
    finally:
        q.stop()
    assert got == windows.rate_limit_windows(rows, 1, 3600).groupBy().agg(F.sum("requests"), F.sum("rejected")).first()
