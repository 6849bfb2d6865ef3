"""Near duplicates keep one of repeated rows also where a column has no order."""


def test_map_columns(spark):
    import corpus_pipeline

    text = "one two three four five six seven"
    rows = [(1, text, {"a": 1}), (1, text, {"a": 1}), (2, text, None), (3, "other words stand in this one here", {"b": 2}), (4, None, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>")
    got = sorted((r.doc_id, r.tags) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [(1, {"a": 1}), (3, {"b": 2}), (4, {})]
