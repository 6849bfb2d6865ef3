"""Result files and document sources: names, marks, unions, failures, order, gaps."""

import csv
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarnwell.sources import files, stores

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def docx(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<?xml version='1.0' encoding='UTF-8'?><w:document {W}><w:body>{body}</w:body></w:document>")


def test_details_with_a_union_of_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, {"a": "x", "b": 'q"uo,te\nd'}), (2, {"c": "ü", "a": None}), (3, None), (4, {"b": "1", "d": ""})], "id int, m map<string,string>")
    at = f"{tmp_path}/out"
    for _ in range(2):  # written again, it is replaced
        stores.write_details(rows.repartition(3), at, "m", ("id",))
        assert [p.name for p in Path(at).iterdir()] == ["evaluation_details.csv"] and [p.name for p in tmp_path.iterdir()] == ["out"]
    raw = Path(f"{at}/evaluation_details.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    assert list(csv.reader(raw.decode("utf-8-sig").splitlines(keepends=True))) == [["id", "a", "b", "c", "d"], ["1", "x", 'q"uo,te\nd', "", ""], ["2", "", "", "ü", ""], ["3", "", "", "", ""], ["4", "", "1", "", ""]]
    rows.select("id").repartition(3).write.format("result_csv").mode("overwrite").save(at)
    assert sorted(p.name for p in Path(at).iterdir()) == ["part-00001.csv", "part-00002.csv", "part.csv"]
    assert sorted(r.id for r in spark.read.option("header", "true").csv(at).collect()) == ["1", "2", "3", "4"]


def test_fixed_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1.5, "rag")], "p50_ms double, mode string")
    files.write_result(rows, f"{tmp_path}/s", "summary", files.SUMMARY_FIELDS)
    got = next(csv.DictReader(Path(f"{tmp_path}/s/summary.csv").open()))
    assert tuple(got) == files.SUMMARY_FIELDS and {k: v for k, v in got.items() if v} == {"p50_ms": "1.5", "mode": "rag"}
    with pytest.raises(ValueError, match="other"):
        files.write_result(rows.withColumn("other", F.lit(1)), f"{tmp_path}/s", "summary", files.SUMMARY_FIELDS)
    assert len(set(files.REQUEST_FIELDS)) == 16


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    rows = spark.range(4)
    at = f"{tmp_path}/out"
    files.write_result(rows, at, "r")
    before = Path(f"{at}/r.csv").read_text()
    with pytest.raises(Exception, match="stopped"):
        files.write_result(rows.coalesce(1).select(F.when(F.col("id") == 3, F.raise_error(F.lit("stopped"))).otherwise(F.col("id")).alias("id")), at, "r")
    assert Path(f"{at}/r.csv").read_text() == before and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="overwrite"):
        rows.write.format("result_csv").mode("append").save(at)


def test_named_texts(spark, tmp_path):
    rows = spark.createDataFrame([("a/docs/read.me.md", 0, "x"), ("a/docs/read.me.md", 12, "ü\n"), ("other.txt", 1000, None), ("/top/.env", 1, "e")], "path string, i int, content string")
    named = rows.select(files.chunk_file_name(F.col("path"), F.col("i")).alias("name"), "content")
    files.write_named_texts(named, f"{tmp_path}/n")
    assert {p.name: p.read_text() for p in Path(f"{tmp_path}/n").iterdir()} == {"docs__read.me__000.md": "x", "docs__read.me__012.md": "ü\n", "root__other__1000.md": "", "top__.env__001.md": "e"}
    with pytest.raises(ValueError, match="two files"):
        files.write_named_texts(named.unionByName(named.limit(1)), f"{tmp_path}/n")
    assert len(list(Path(f"{tmp_path}/n").iterdir())) == 4


def test_docx(spark, tmp_path):
    files.register(spark)
    (tmp_path / "d" / "in").mkdir(parents=True)
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    docx(tmp_path / "d" / "b.docx", f"<w:p><w:pPr><w:tabs><w:tab w:val='left' w:pos='1'/></w:tabs></w:pPr>{run('A &amp; ')}{run('ü')}<w:r><w:tab/><w:t>c</w:t><w:br/><w:t>d</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p>{run('cell')}</w:p></w:tc></w:tr></w:tbl>")
    docx(tmp_path / "d" / "in" / "a.DOCX", f"<w:p><w:r><mc:AlternateContent><mc:Choice><w:p>{run('box')}</w:p></mc:Choice><mc:Fallback><w:p>{run('box')}</w:p></mc:Fallback></mc:AlternateContent></w:r>{run('out')}</w:p>")
    docx(tmp_path / "d" / "empty.docx", "")
    (tmp_path / "d" / "note.txt").write_text("no")
    rows = spark.read.format("docx").load(f"{tmp_path}/d")
    assert [tuple(r) for r in rows.collect()] == [("b.docx", "A & ü\tc\nd\n\ncell"), ("empty.docx", ""), ("a.DOCX", "box\nout")]
    assert stores.load_document(spark, f"{tmp_path}/d/b.docx").count() == 1
    (tmp_path / "none").mkdir()
    assert spark.read.format("docx").load(f"{tmp_path}/none").count() == 0
    (tmp_path / "d" / "bad.docx").write_bytes(b"no zip")
    with pytest.raises(Exception, match="bad.docx is no readable docx"):
        spark.read.format("docx").load(f"{tmp_path}/d").collect()


def test_rounds_to_the_first_gap(spark, tmp_path):
    for name in ("fixed_r1_chat", "fixed_r2_chat", "fixed_r4_chat", "baseline_r2_chat", "baseline_r1_rag", "other"):
        (tmp_path / f"{name}.csv").write_text("ms\n" + ("5\n" if name != "fixed_r1_chat" else ""))
    got = sorted((r.side, r["round"], r.scenario, r.ms) for r in stores.read_rounds(spark, f"{tmp_path}", "ms int").collect())
    assert got == [("baseline", 1, "rag", 5), ("fixed", 2, "chat", 5)]
    (tmp_path / "e").mkdir()
    assert stores.read_rounds(spark, f"{tmp_path}/e", "ms int").count() == 0


def test_texts_in_order(spark, tmp_path):
    for n in ("b.md", "a.txt", "c.md"):
        (tmp_path / n).write_text(n * 3)
    assert [r.source for r in stores.read_text(spark, f"{tmp_path}", ordered=True).collect()] == ["a.txt", "b.md", "c.md"]
