"""Facade: ingest, search and evaluate over batches of queries.

    engine = Retriever(spark).ingest(documents)          # doc_id, text, source
    engine.search(queries, k=4, mode="hybrid")           # query_id, query -> query_id, doc_id, rank, score, retrieved_by
    engine.evaluate(questions, k=5)                      # query_id, query, evidence, answerable -> Hit@K, MRR

Extension points are callables over DataFrames: ``dense`` (terms batch, k) -> ranked rows, ``rerank`` ranked rows -> ranked
rows, ``rewrite`` (index, batch) -> (query_id, term); ``predict`` list of (query, text) -> scores reranks a pool of hits.  One that raises when it is called is logged and done without: a
search without rewriting, the order before reranking, BM25 alone instead of hybrid.  What fails later, when Spark runs
the plan, is raised by Spark.

    engine.save(path); Retriever(spark).load(path)       # a segmented index; search reads its tables
    engine.add(documents); engine.remove(ids)            # new segments and tombstones, if the index is saved
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import text as T
from tarnwell.operators import chunking
from tarnwell.operators import retrieval as R
from tarnwell.operators.segments import SegmentedIndex

POOL = 20
#: Modes; anything else is bm25.
MODES = ("bm25", "dense", "hybrid")
log = logging.getLogger("tarnwell")


class Retriever:
    def __init__(self, spark: SparkSession, config: R.BM25 = R.BM25(), feedback: R.Feedback | None = R.Feedback(),
                 dense: Callable[[DataFrame, int], DataFrame] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None,
                 rewrite: Callable[[R.TextIndex, DataFrame], DataFrame] | None = None, predict: Callable[[list[tuple[str, str]]], Sequence[float]] | None = None):
        self.spark, self.config, self.feedback, self.dense, self.rerank = spark, config, feedback, dense, rerank
        self.predict = predict
        self.rewrite = rewrite or ((lambda index, batch: R.feedback_terms(index, batch, feedback)) if feedback else None)
        self.index: R.TextIndex | None = None

    def ingest(self, documents: DataFrame, chunk: bool = False) -> Retriever:
        """Build the index over documents, or over their chunks (doc_id is then doc_id#chunk_index)."""
        if chunk:
            rows = chunking.chunk_documents(documents)
            documents = rows.select(F.format_string("%s#%03d", F.col("doc_id").cast("string"), F.col("chunk_index")).alias("doc_id"), F.col("content").alias("text"), "source")
        self.index = R.TextIndex(documents, self.config)
        return self

    def save(self, path: str) -> Retriever:
        """Write texts and index tables; from now on search reads them. What is at the path stays readable until the new index is whole."""
        if self.index is None:
            raise ValueError("nothing has been ingested")
        if not (isinstance(self.index, SegmentedIndex) and self.index.path == path.rstrip("/")):
            self.index = SegmentedIndex.create(self.spark, path, self.index.documents, self.config)
        return self

    def load(self, path: str) -> Retriever:
        """Search a saved index, with the configuration that it was built with; an error if there is none, or it is damaged or of another format."""
        if not self.try_load(path):
            raise FileNotFoundError(f"no index of this format at {path}")
        return self

    def try_load(self, path: str) -> bool:
        """As ``load``, but False instead of an error."""
        found = SegmentedIndex.open(self.spark, path)
        if found:
            self.index, self.config = found, found.config
        return found is not None

    def add(self, documents: DataFrame) -> Retriever:
        """Also these documents (doc_id, text, source). A saved index gets a segment more, others stay untouched; one in memory is built anew."""
        if isinstance(self.index, SegmentedIndex):
            self.index = self.index.add(documents)
        elif self.index is None:
            self.ingest(documents)
        else:
            old = self.index.documents.join(documents.select("doc_id"), "doc_id", "left_anti")
            self.ingest(old.unionByName(documents.select(*old.columns)))
        return self

    def remove(self, ids: DataFrame) -> Retriever:
        """Without the documents of these ids (doc_id)."""
        if isinstance(self.index, SegmentedIndex):
            self.index = self.index.delete(ids)
        elif self.index is not None:
            self.ingest(self.index.documents.join(ids.select("doc_id"), "doc_id", "left_anti"))
        return self

    def clear(self) -> Retriever:
        """Forget the index, and delete its tables if it was saved."""
        if isinstance(self.index, SegmentedIndex):
            self.index.clear()
        self.index = None
        return self

    def stats(self) -> dict:
        """ready, n_docs and avg_chars."""
        row = self.index.stats().first() if self.index else None
        return {"ready": bool(row and row.n), "n_docs": row.n if row else 0, "avg_chars": row.avg_chars if row else None}

    def search(self, queries: DataFrame, k: int = 4, mode: str = "bm25") -> DataFrame:
        """query_id, doc_id, rank, score, retrieved_by. Blank queries find nothing."""
        if self.index is None:
            raise ValueError("nothing has been ingested")
        if not self.predict:
            return self._found(queries, k, mode)
        found = self._found(queries, max(POOL, k), mode)
        pool = found.join(queries.select("query_id", "query"), "query_id").join(self.index.documents.select("doc_id", "text"), "doc_id")
        return R.model_rerank(pool, self.predict).where(F.col("rank") <= k).select(*found.columns)

    def _found(self, queries: DataFrame, k: int, mode: str) -> DataFrame:
        mode = mode.strip().lower() if mode.strip().lower() in MODES else "bm25"
        batch = R.query_terms(queries.where(T.strip(F.col("query")) != ""), ngram=self.config.ngram)
        dense = self.dense or self.index.tfidf_search
        if mode == "dense":
            found = dense(batch, k).withColumn("retrieved_by", F.lit("dense"))
        elif mode == "hybrid":
            pool = max(POOL, k)
            try:
                found = R.hybrid(self.index.search(batch, pool), dense(batch, pool), k).withColumnRenamed("retrieval_score", "score")
            except Exception:
                log.warning("hybrid search failed, BM25 alone", exc_info=True)
                found = self._bm25(batch, k)
        else:
            found = self._bm25(batch, k)
            # a query has hits by BM25 if one of its terms is in the index: dense search is for the others, and only if there are any
            known = batch.join(self.index.frequencies().select("term"), "term", "left_semi").select("query_id").distinct()
            others = batch.join(known, "query_id", "left_anti")
            if others.limit(1).count():
                rest = dense(others, k).withColumn("retrieved_by", F.lit("dense"))
                found = found.unionByName(rest.select(*found.columns))
        found = found.select("query_id", "doc_id", "rank", "score", "retrieved_by")
        if self.rerank:
            try:
                return self.rerank(found)
            except Exception:
                log.warning("reranking failed, order kept", exc_info=True)
        return found

    def _bm25(self, batch: DataFrame, k: int) -> DataFrame:
        if self.rewrite is None:
            return self.index.search(batch, k).withColumn("retrieved_by", F.lit("bm25"))
        try:
            terms = self.rewrite(self.index, batch).select("query_id", "term")
        except Exception:
            log.warning("rewriting failed, query as it is", exc_info=True)
            return self.index.search(batch, k).withColumn("retrieved_by", F.lit("bm25"))
        weight = self.feedback.weight if self.feedback else 0.3
        found = self.index.search(R.expanded(batch, terms, weight, self.config.ngram), k)
        rewritten = terms.select("query_id").distinct().withColumn("rewritten", F.lit(True))
        by = F.when(F.col("rewritten"), "bm25+rewrite").otherwise("bm25")
        return found.join(rewritten, "query_id", "left").withColumn("retrieved_by", by).drop("rewritten")

    def evaluate(self, questions: DataFrame, k: int = 5, mode: str = "bm25", threshold: float = 0.85) -> DataFrame:
        """One row of Hit@1/3/5, MRR and mean first rank."""
        hits = self.search(questions.select("query_id", "query"), k, mode)
        evidence = questions.select("query_id", T.tokenize(F.col("evidence")).alias("etok"))
        listed = hits.join(self.index.tokens.select("doc_id", "tokens"), "doc_id").join(evidence, "query_id")
        return R.hit_mrr(R.first_relevant(listed, T.token_containment(F.col("tokens"), F.col("etok")) >= threshold, questions.select("query_id", "answerable")))

    def context(self, hits: DataFrame) -> DataFrame:
        """query_id, context: the found texts in order, with a blank line between."""
        rows = hits.join(self.index.documents.select("doc_id", "text"), "doc_id")
        parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
        return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("context"))


def rewriter(mode: str | None, terms: Callable[[R.TextIndex, DataFrame], DataFrame] | None = None, feedback: R.Feedback = R.Feedback()) -> Callable[[R.TextIndex, DataFrame], DataFrame] | None:
    """A ``rewrite`` by name: prf or rm3 is feedback, llm the given terms (index, batch) -> (query_id, term); anything else, or llm without them, none."""
    name = (mode or "").strip().lower()
    if name in ("prf", "rm3"):
        return lambda index, batch: R.feedback_terms(index, batch, feedback)
    if name == "llm" and terms is None:
        log.warning("no terms to rewrite with, queries as they are")
    return terms if name == "llm" else None
