"""Registered queries: SQL where there is some, otherwise brute force over the same table."""

import re
import zlib
from collections import Counter

import pytest
from oracle import connection, same

from tarnwell.llm.queries import ORACLE_SQL, QUERIES

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    same(spark, connection(sf), QUERIES[name], ORACLE_SQL[name], sf)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_pages(spark, sf):
    import html

    got = {r.page_id: r for r in QUERIES["op1_html_blocks"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_base_rules(spark, sf, documents):
    got = {r.doc_id: r for r in QUERIES["op3_perplexity_rules"](spark, sf).collect()}
    assert set(got) == set(documents)
    for i, d in documents.items():
        words = SPACE.findall(d.text or "")
        windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in (d.text or "").split("\n") if SPACE.search(x)]
        r = got[i]
        counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in d.text or ""), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_language_held_out(spark, sf, documents):
    got = QUERIES["op4_language_id"](spark, sf).collect()
    assert len(got) == len(documents)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in QUERIES["op7_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    good = sorted(r.score for r in held if labels[r.doc_id] == 1)
    bad = [r.score for r in held if labels[r.doc_id] == 0]
    above = sum(sum(g > b for g in good) for b in bad) / (len(good) * len(bad))
    assert above >= 0.9


def test_surrogates(spark, sf, documents):
    got = {r.doc_id: r for r in QUERIES["op6_pii_surrogates"](spark, sf).collect()}
    assert set(got) == set(documents)
    personal = re.compile(r"[\w.]+@[\w.]+|(?<!\w)\d{16}(?!\w)|\d+\.\d+\.\d+\.\d+|\(\d{3}\)\W{1,4}\d{3}-\d{4}|[0-9a-f]{40}")
    before = {m for d in documents.values() for m in personal.findall(d.text)}
    after = {m for r in got.values() for m in personal.findall(r.text)}
    assert before and not before & after
    for i, d in documents.items():
        if not personal.search(d.text):
            assert got[i].text == d.text


def test_pipeline(spark, sf, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name != "mixing":
            assert out.columns == docs.columns
        kept[name] = {r.doc_id for r in rows}
        docs = spark.createDataFrame(rows, out.schema)
    has_letter = {i for i, d in documents.items() if any(c.isalpha() for c in d.text)}
    assert kept["language_id"] == has_letter
    # near duplicates by brute force: five words, 0.8
    sets = {}
    for i in has_letter:
        w = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in documents[i].text))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert kept["near_duplicates"] == {i for i in ids if root(i) == i}
    bad = {r.doc_id for r in QUERIES["op10_decontaminate"](spark, sf).where("contaminated").collect()}
    assert kept["decontamination"] == kept["near_duplicates"] - bad
    assert kept["personal_data"] == kept["decontamination"]
    assert kept["mixing"] < kept["personal_data"]


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",), ("corpus_pipeline.py",)])
def test_entry_without_the_subpackage(tmp_path, gone):
    """The other queries stay when the llm folders, the pipeline or both are gone, also if an empty folder is left."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "tarnwell", tmp_path / "tarnwell", ignore=shutil.ignore_patterns(*gone, "__pycache__"))
    if "llm" in gone:
        (tmp_path / "tarnwell/llm/__pycache__").mkdir(parents=True)
    for name in {"__spark_entry__.py", "corpus_pipeline.py"} - {*gone}:
        shutil.copy(root / name, tmp_path)
    code = f"import __spark_entry__ as e; q = e.queries(); assert 'hit_mrr' in q and any(k.startswith('op1') for k in q) == {'llm' not in gone} and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
