"""Known answers of the text functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import text as T
from tarnwell.sources import stores


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_full_width_equals_half_width(spark):
    assert one(spark, T.tokenize(F.col("s")), s="ＦＡＩＳＳ　Ｖ2") == one(spark, T.tokenize(F.col("s")), s="faiss v2") == ["faiss", "v2"]


def test_nfkc_folds_ligatures(spark):
    assert one(spark, T.nfkc(F.col("s")), s="ﬁne①") == "fine1"


def test_nfkc_of_all_code_points(spark):
    """Every assigned code point alone, after a letter, and before marks and jamo that compose with it; null and empty text."""
    points = [p for p in range(1, 0x110000) if unicodedata.category(chr(p)) not in ("Cn", "Cs")]
    texts = [f"a{chr(p)}" for p in points] + [chr(p) for p in points if not 0xE000 <= p < 0xF900 and p < 0xF0000]
    texts += [f"{chr(p)}{m}" for p in range(0x20, 0x3200) if chr(p).isprintable() for m in "\u0301\u0308\u0327\u3099\u11a8"] + [f"{chr(p)}\u11a8" for p in range(0xAC00, 0xD7A4, 7)] + [None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.nfkc(F.col("t")).alias("n"))
    assert [(r.t, r.n) for r in frame.collect() if r.n != (None if r.t is None else unicodedata.normalize("NFKC", r.t))] == []


def test_tokens_of_compatibility_forms(spark):
    assert one(spark, T.tokenize(F.col("s")), s="ﬁne ① ㎏ ＡＢ") == ["fine", "1", "kg", "ab"]
    assert one(spark, T.normalize(F.col("s")), s="ｶﾞ Ⅷ e\u0301") == "ガ viii é"


def test_four_cjk_characters_give_four_unigrams_and_three_bigrams(spark):
    assert one(spark, T.cjk_tokens(F.col("s")), s="文档切分") == ["文", "档", "切", "分", "文档", "档切", "切分"]


def test_ngram_three_and_single(spark):
    assert one(spark, T.cjk_tokens(F.col("s"), 3), s="检索x上海市") == ["检", "索", "检索", "上", "海", "市", "上海", "海市", "上海市"]
    assert one(spark, T.cjk_tokens(F.col("s")), s="海") == ["海"]


def test_latin_before_cjk_and_trailing_signs(spark):
    assert one(spark, T.tokenize(F.col("s")), s="检索 bge-small-zh-v1.5: ok.") == ["bge-small-zh-v1.5:", "ok.", "检", "索", "检索"]


@pytest.mark.parametrize("raw, clean", [("a\nb\tc", "a b c"), ("x sk-abcdefgh1 y", "x sk-*** y"), ("Token: abc", "Token=***"), ("a" * 300, "a" * 197 + "...")])
def test_safe_message(spark, raw, clean):
    assert one(spark, T.safe_message(F.col("s")), s=raw) == clean


def test_json_object(spark):
    assert one(spark, T.json_object(F.col("s")), s='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'
    assert one(spark, T.json_object(F.col("s")), s="none") is None


def test_source_group(spark):
    assert [one(spark, T.source_group(F.col("s")), s=s) for s in ("evaluation__README__003.md", "plain.md", "", "__x")] == ["evaluation", "plain.md", "?", "__x"]


def test_containment(spark):
    assert one(spark, T.char_containment(F.col("c"), F.col("e")), c="Alpha Beta", e="ha be") == 1.0
    assert one(spark, T.char_containment(F.col("c"), F.col("e")), c="abc", e="") == 0.0


def test_format_value(spark):
    assert one(spark, T.format_value(F.col("s")), s='a "b"') == '"a \\"b\\""'
    assert one(spark, T.format_value(F.col("s")), s="y" * 200) == "y" * 117 + "..."


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x\n\ny")
    (tmp_path / "b.csv").write_text("h1,h2\n1,two\n")
    assert stores.load_document(spark, f"{tmp_path}/a.md").first().asDict() == {"source": "a.md", "content": "# x\n\ny"}
    assert stores.load_document(spark, f"{tmp_path}/b.csv").first().content == "h1: 1\nh2: two"
    with pytest.raises(ValueError):
        stores.load_document(spark, "x.pdf")


def test_questions(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "q"}\n{"id": "2", "question": "r", "answerable": false, "evidence": "e"}\n')
    rows = {r.id: r for r in stores.read_questions(spark, f"{tmp_path}/q.jsonl").collect()}
    assert rows["1"].answerable and rows["1"].evidence == "" and not rows["2"].answerable


def test_index_versions(spark, tmp_path):
    path = f"{tmp_path}/index"
    assert stores.load_index(spark, path) is None
    rows = spark.createDataFrame([(1, 2, "a", 1)], "doc_id long, dl int, term string, tf long")
    stores.save_index(rows, path)
    assert stores.load_index(spark, path).collect() == rows.collect()
    rows.withColumn("version", F.lit(99)).write.mode("overwrite").parquet(path)
    assert stores.load_index(spark, path) is None
