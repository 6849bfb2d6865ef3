"""Messages of a question and texts of what a model sends."""

from pyspark.sql import functions as F

from tarnwell.functions.prompts import content_text, messages


def test_messages(spark):
    schema = "id int, question string, history array<struct<question:string,answer:string>>, sources array<string>, mode string"
    rows = spark.createDataFrame([(1, "q", [("a", "b"), (None, "c")], ["s", None, "t"], "rag"), (2, "q", None, [], None), (3, None, [], ["s"], "CHAT")], schema)
    made = messages(F.col("question"), F.col("history"), F.col("sources"), F.col("mode"), "R", "C")
    got = {r.id: [tuple(m) for m in r.m] for r in rows.select("id", made.alias("m")).collect()}
    assert got == {
        1: [("system", "R"), ("user", "a"), ("assistant", "b"), ("user", ""), ("assistant", "c"), ("user", "【参考资料】\ns\n\n\n\nt\n\n【用户问题】\nq")],
        2: [("system", "R"), ("user", "【参考资料】\n（未检索到知识库相关内容）\n\n【用户问题】\nq")],
        3: [("system", "C"), ("user", "")],
    }


def test_content(spark):
    cases = {
        '"a\\"b\\u0001"': 'a"b\x01', '["a", {"type": "text", "text": "b"}, {"type": "image"}, 5, null, ["c"], {"text": 7}]': "ab7", '{"text": "x", "more": 1}': "x", '{"other": "x"}': "", '{"text": null}': "",
        "5": "", "true": "", "null": "", "[]": "", "{}": "", "no json": "", None: "",
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", content_text(F.try_parse_json("c")).alias("t"))
    assert {r.c: r.t for r in rows.collect()} == cases
