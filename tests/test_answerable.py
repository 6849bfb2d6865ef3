"""Which passages stand in a document, on odd passages: by Python's ``in`` and by the SQL."""

import duckdb
import pytest
from oracle import same

from tarnwell.plans import ORACLE_SQL, QUERIES
from tarnwell.plans.retrieval_queries import answerable

TEXTS = ["alpha beta gamma delta", "concatenate -- it", "文档切分 and 中文 here is", "   ", "beta-9 gamma. End"]
LATIN = ["alpha", "alpha beta", "cat", "--", "ha beta gam", "missing", "gamma alpha", "beta gamma delta", "Alpha beta", "End", "", " "]
MIXED = ["档切", "分 and 中", "is 文档 here", "文档切分 and 中文 here is"]


def tables(spark, folder, passages):
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, i // 2 % 2) for i in range(len(passages))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_short_and_mixed_passages(spark, tmp_path):
    passages = LATIN + MIXED
    d = tables(spark, tmp_path, [*passages, None])
    found = {r.query_id: r.answerable for r in answerable(spark, d).collect()}
    assert found == {i: any(p in t for t in TEXTS if t.strip()) for i, p in enumerate(passages)} | {len(passages): None}


@pytest.mark.parametrize("name", ["rag_summary", "first_relevant_rank", "hit_mrr"])
def test_equal_to_sql_on_short_passages(spark, tmp_path, name):
    d = tables(spark, tmp_path, LATIN)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    same(spark, con, QUERIES[name], ORACLE_SQL[name], d)
