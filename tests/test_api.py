"""The facade: ingest, modes, cascade, evaluation."""

import pytest
from pyspark.sql import functions as F

from tarnwell.api import Retriever, rewriter
from tarnwell.operators import retrieval as R


@pytest.fixture(scope="module")
def engine(spark):
    rows = spark.createDataFrame([(1, "alpha beta", "a__1.md"), (2, "gamma delta", "b"), (3, "alpha alpha beta epsilon", "a__2.md")], "doc_id int, text string, source string")
    return Retriever(spark).ingest(rows)


def test_modes(spark, engine):
    asked = spark.createDataFrame([(1, "alpha"), (2, " "), (3, "zeta")], "query_id int, query string")
    for mode in ("bm25", "dense", "HYBRID", "other"):
        found = engine.search(asked, 2, mode).collect()
        assert {r.query_id for r in found} == {1} and {r.doc_id for r in found} == {1, 3}


def test_needs_documents(spark):
    with pytest.raises(ValueError):
        Retriever(spark).search(spark.createDataFrame([(1, "x")], "query_id int, query string"))


def test_evaluate(spark, engine):
    asked = spark.createDataFrame([(1, "gamma", "gamma delta", True), (2, "alpha", "none", False)], "query_id int, query string, evidence string, answerable boolean")
    r = engine.evaluate(asked).first()
    assert (r.n_answerable, r.hit_at_1, r.mrr) == (1, 1.0, 1.0)


def test_chunks_and_context(spark):
    rows = spark.createDataFrame([(1, "one two. " * 100, "s")], "doc_id int, text string, source string")
    engine = Retriever(spark, feedback=None).ingest(rows, chunk=True)
    hits = engine.search(spark.createDataFrame([(1, "one")], "query_id int, query string"), 2)
    assert engine.context(hits).where(F.length("context") > 500).count() == 1


def test_save_load_clear_and_fallbacks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha beta", "a"), (2, "alpha gamma gamma", "b"), (3, "delta", "c")], "doc_id int, text string, source string")
    asked = spark.createDataFrame([(1, "alpha gamma"), (2, "delta")], "query_id int, query string")
    path = f"file://{tmp_path}/index"

    def broken(*_):
        raise RuntimeError("no model")

    def found(engine, **more):
        return sorted((r.query_id, r.rank, r.doc_id, r.retrieved_by) for r in engine.search(asked, 2, **more).collect())

    plain = Retriever(spark, feedback=None).ingest(rows)
    expected = found(plain)
    assert expected == [(1, 1, 2, "bm25"), (1, 2, 1, "bm25"), (2, 1, 3, "bm25")]
    plain.save(path)
    loaded = Retriever(spark, feedback=None).load(path)
    assert found(loaded) == expected and loaded.stats()["n_docs"] == 3 and loaded.stats()["ready"]
    assert found(Retriever(spark, rewrite=broken, rerank=broken).load(path)) == expected
    assert found(Retriever(spark, feedback=None, dense=broken).load(path), mode="hybrid") == expected
    loaded.clear()
    assert not loaded.stats()["ready"] and not (tmp_path / "index").exists()


def test_model_reranks_or_is_done_without(spark):
    schema = "query_id int, doc_id int, rank int, score double, query string, text string, source string"
    rows = [(1, 1, 1, 9.0, "q", "a", "s"), (1, 2, 2, 8.0, "q", "ccc", "s"), (1, 3, 3, 7.0, "q", "bbb", "s"), (1, 4, 4, 6.0, "q", None, "s"), (2, 1, 1, 5.0, "few", "a", "s"), (2, 2, 2, 4.0, "few", "aa", "s"), (3, 1, 1, 3.0, "nan", "a", "s"), (3, 2, 2, 2.0, "nan", "aa", "s"), (4, 1, 1, 1.0, "fails", "a", "s"), (4, 2, 2, 0.5, "fails", "aa", "s"), (5, 1, 1, 7.0, "q", "aaaa", "s")]

    def predict(pairs):
        assert len(pairs) <= 2
        if pairs[0][0] == "fails":
            raise RuntimeError("no model")
        scores = [len(t) for _, t in pairs]
        return {"few": scores[1:], "nan": [float("nan")] * len(pairs)}.get(pairs[0][0], scores)

    got = R.model_rerank(spark.createDataFrame(rows, schema), predict, batch=2)
    assert got.columns == ["query_id", "doc_id", "rank", "score", "source", "reranked"]
    assert sorted((r.query_id, r["rank"], r.doc_id, r.score, r.reranked) for r in got.collect()) == [
        (1, 1, 2, 3.0, True), (1, 2, 3, 3.0, True), (1, 3, 1, 1.0, True), (1, 4, 4, 0.0, True), (2, 1, 1, 5.0, False), (2, 2, 2, 4.0, False), (3, 1, 1, 3.0, False), (3, 2, 2, 2.0, False),
        (4, 1, 1, 1.0, False), (4, 2, 2, 0.5, False), (5, 1, 1, 7.0, False),
    ]
    assert R.model_rerank(spark.createDataFrame([], schema), predict).count() == 0


def test_search_with_a_model(spark, engine):
    asked = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    by_length = Retriever(spark, feedback=None, predict=lambda pairs: [-len(t) for _, t in pairs])
    by_length.index = engine.index
    assert [(r.doc_id, r.score) for r in by_length.search(asked, 1).collect()] == [(1, -10.0)]


def test_rewriters(spark, engine):
    assert rewriter("off") is rewriter(None) is rewriter("llm") is None
    own = lambda index, batch: batch.select("query_id", "term")
    assert rewriter(" LLM ", own) is own and rewriter("off", own) is None
    asked = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    assert Retriever(spark, rewrite=rewriter("RM3")).ingest(engine.index.documents).search(asked).count() == 2
