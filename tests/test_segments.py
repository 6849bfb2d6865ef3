"""The segmented index: equal to one built anew after any changes, atomic, and refused when it is missing or damaged."""

import json

import pytest

from tarnwell.api import Retriever
from tarnwell.operators import retrieval as R
from tarnwell.operators.segments import BM25, Conflict, Folder, Manifest, SegmentedIndex

DOC = "doc_id long, text string, source string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def texts(ids, salt=0):
    """Texts of common and rare words, one blank."""
    return [(i, " " if i % 17 == 5 else " ".join(WORDS[(i * k + salt + k) % (3 + k % 8)] for k in range(1, 4 + i % 9)) + f" rare{i % 23}", f"s{i % 3}__x") for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def asked(spark):
    queries = spark.createDataFrame([(1, "alpha rare3 beta"), (2, "kappa kappa zeta"), (3, "unknown"), (4, "rare7")], "query_id long, query string")
    return R.query_terms(queries)


def figures(index, asked):
    """Everything that a search or an evaluation reads of an index."""
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    six = lambda df: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows(df)]
    return (
        six(index.stats().select("n", "avgdl", "avg_chars")), six(index.term_stats().select("term", "df", "idf")), rows(index.postings().select("doc_id", "dl", "term", "tf")), rows(index.search(asked, 5)),
        rows(index.tfidf_search(asked, 5)), rows(index.postings(asked).select("doc_id", "dl", "term", "tf")), rows(index.documents.select("doc_id", "text", "source")), six(index.tfidf_norms()),
    )


def test_equals_a_rebuild_after_every_change(spark, tmp_path, asked):
    path, docs = f"file://{tmp_path}/index", {r[0]: r for r in texts(range(40))}
    index = SegmentedIndex.create(spark, path, frame(spark, list(docs.values())), buckets=3, block_docs=8)
    before = {p for p in tmp_path.rglob("segments/*/*/*") if p.is_file()}

    def holds():
        live = [r for r in docs.values() if r[1].strip()]
        assert figures(SegmentedIndex.open(spark, path), asked) == figures(R.TextIndex(frame(spark, live)), asked)

    holds()
    more = texts(range(30, 60), salt=1)  # ten of them replace others
    index, docs = index.add(frame(spark, more)), docs | {r[0]: r for r in more}
    # a blank text isn't added, so it replaces nothing
    docs |= {i: r for i, r in ((r[0], r) for r in texts(range(30, 40))) if not docs[i][1].strip()}
    holds()
    assert before <= {p for p in tmp_path.rglob("segments/*/*/*") if p.is_file()}
    gone = [3, 33, 59, 1000]
    index, docs = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long")), {i: r for i, r in docs.items() if i not in gone}
    holds()
    index = index.add(frame(spark, texts([3])))
    docs[3] = texts([3])[0]
    holds()
    assert len(index.manifest.segments) == 3
    merged = index.merge(fan=2)
    assert len(merged.manifest.segments) < 3
    holds()
    # whoever has the older index open goes on reading it until the tables are cleaned up
    assert sorted(r.doc_id for r in index.documents.collect()) == sorted(r.doc_id for r in merged.documents.collect())
    assert merged.vacuum() > 0 and merged.vacuum() == 0
    holds()
    index = merged.delete(merged.documents.select("doc_id"))
    assert index.manifest.segments == () and index.manifest.n == 0 and index.search(asked, 5).count() == 0 and index.stats().first().avgdl == 1.0


def test_nothing_changes_nothing(spark, tmp_path):
    index = SegmentedIndex.create(spark, f"file://{tmp_path}/index", frame(spark, texts(range(5))))
    assert index.add(frame(spark, [(9, "  ", "s"), (10, None, "s")])) is index
    assert index.delete(spark.createDataFrame([(77,)], "doc_id long")) is index
    assert index.merge() is index and len(list(tmp_path.rglob("segments/*"))) == 1


def test_failed_changes_leave_the_index(spark, tmp_path, asked):
    path = f"file://{tmp_path}/index"
    index = SegmentedIndex.create(spark, path, frame(spark, texts(range(20))))
    expected = figures(index, asked)
    for wrong in ([(1, "x", "s"), (1, "y", "s")], [(None, "x", "s")]):
        with pytest.raises(ValueError, match="an id of its own"):
            index.add(frame(spark, wrong))
        with pytest.raises(ValueError, match="an id of its own"):
            SegmentedIndex.create(spark, path, frame(spark, wrong))
    with pytest.raises(Exception, match="boom"):
        from pyspark.sql import functions as F

        index.add(frame(spark, texts(range(50, 60))).withColumn("text", F.raise_error(F.lit("boom")).cast("string")))
    assert figures(SegmentedIndex.open(spark, path), asked) == expected
    # of two writers that began with the same generation the second loses
    index.add(frame(spark, texts(range(20, 22))))
    with pytest.raises(Conflict):
        index.add(frame(spark, texts(range(22, 24))))
    assert SegmentedIndex.open(spark, path).manifest.n == 21


def test_missing_damaged_or_other_format(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert SegmentedIndex.open(spark, path) is None
    index = SegmentedIndex.create(spark, path, frame(spark, texts(range(4))), BM25(k1=1.2, ngram=3))
    assert SegmentedIndex.open(spark, path).config == BM25(k1=1.2, ngram=3)
    engine = Retriever(spark)
    assert engine.try_load(path) and engine.config.k1 == 1.2 and not Retriever(spark).try_load(f"{path}-none")
    with pytest.raises(FileNotFoundError):
        engine.load(f"{path}-none")
    text = index.manifest.dumped()
    assert Manifest.loaded(text) == index.manifest
    body = json.loads(text)
    other = json.loads(body["body"]) | {"format": 1}
    for bad in ("", "{", "[]", text[:-5], text.replace("1.2", "1.3"), json.dumps({"body": json.dumps(other), "check": body["check"]})):
        assert Manifest.loaded(bad) is None
    (marker,) = tmp_path.glob("index/segments/*/terms/_SUCCESS")
    marker.unlink()
    assert SegmentedIndex.open(spark, path) is None
    folder = Folder(spark, path)
    assert not folder.exists("nothing") and folder.names("nothing") == []


def test_buckets_prune_the_scan(spark, tmp_path, asked):
    index = SegmentedIndex.create(spark, f"file://{tmp_path}/index", frame(spark, texts(range(30))))
    plan = index.postings(asked)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan


def test_save_to_its_own_path_again(spark, tmp_path):
    """What was lost before: texts that a save reads from the place that it writes to."""
    path = f"file://{tmp_path}/index"
    queries = spark.createDataFrame([(1, "alpha rare3"), (2, "nothing known")], "query_id long, query string")
    engine = Retriever(spark, feedback=None).ingest(frame(spark, texts(range(12)))).save(path)
    expected = sorted(map(tuple, engine.search(queries, 3).collect()))
    again = Retriever(spark, feedback=None).load(path).save(path).save(path)
    assert sorted(map(tuple, again.search(queries, 3).collect())) == expected and expected
    Retriever(spark).ingest(again.index.documents).save(path)
    assert Retriever(spark).load(path).stats()["n_docs"] == 11
    again = Retriever(spark, feedback=None).load(path).add(frame(spark, [(99, "nothing else", "s")]))
    assert {r.doc_id for r in again.search(queries, 3).where("query_id = 2").collect()} == {99}
    again.remove(spark.createDataFrame([(99,)], "doc_id long"))
    assert Retriever(spark).load(path).stats()["n_docs"] == 11
    memory = Retriever(spark, feedback=None).add(frame(spark, texts(range(3)))).add(frame(spark, [(1, "new words", "s")])).remove(spark.createDataFrame([(0,)], "doc_id long"))
    assert {(r.doc_id, r.text) for r in memory.index.documents.collect()} == {(1, "new words"), (2, texts([2])[0][1])}
