"""Relevance of documents for questions with evidence and for those without."""

import duckdb
from oracle import same

from tarnwell.plans import ORACLE_SQL, QUERIES


def test_pairs_by_tokens_and_by_source(spark, tmp_path):
    """Questions without evidence have the documents whose source contains theirs; a blank text is no document, blank sources ask for nothing."""
    d = str(tmp_path)
    rows = [(0, "a b c d", "src1"), (1, "a b c", "SRC10"), (2, "a b c d e f g h", "other"), (3, "  ", "src1"), (4, "x", None), (5, "y", " "), (6, "z", "src1"), (7, "w", " Src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "a b c d"), (2, "a b c d e f g q"), (3, " "), (4, "nowhere")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    found = {(r.query_id, r.doc_id): r.containment for r in QUERIES["relevance_pairs"](spark, d).collect()}
    by_source = [(-1, 0), (-1, 1), (-1, 6), (-1, 7), (-2, 1), (-3, 2), (-8, 0), (-8, 1), (-8, 6), (-8, 7)]
    assert found == {(1, 0): 1.0, (1, 2): 1.0, (2, 2): 0.875} | dict.fromkeys(by_source)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    same(spark, con, QUERIES["relevance_pairs"], ORACLE_SQL["relevance_pairs"], d)
