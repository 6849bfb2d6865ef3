"""Ranked retrieval over whole batches of queries: index statistics, BM25, TF-IDF, dense, fusion, expansion, rerank.

A query batch is (query_id, term, qtf).  Only postings of query terms are shuffled: they are read from the saved index, or
tokens are exploded and joined with the batch's terms inside the scan's stage.  Document frequencies are sums per term,
combined before the shuffle, and join the batch, not the postings.
Scores are rounded to six digits before anything is ranked by them, and ties go to the smaller id.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.functions.text import cosine, dot, source_group, strip, tokenize
from tarnwell.operators.dense import all_cosines, regular, search_parts
from tarnwell.operators.substrings import substring_join
from tarnwell.sources.shared import stash


@dataclass(frozen=True)
class BM25:
    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.5
    ngram: int = 2


def rounded(x: Column) -> Column:
    return F.round(x, 6)


def top(df: DataFrame, k: int, by: str = "score", id_col: str = "doc_id", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best rows of each query, with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), id_col)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class TextIndex:
    """Statistics and postings of a collection (doc_id, text, optionally source); blank texts are left out."""

    def __init__(self, documents: DataFrame, config: BM25 = BM25(), id_col: str = "doc_id", text_col: str = "text"):
        self.config = config
        extra = [c for c in ("source",) if c in documents.columns]
        self.documents = documents.where(strip(F.col(text_col)) != "").select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra)
        self.tokens = self.documents.select("doc_id", *extra, tokenize(F.col("text"), config.ngram).alias("tokens")).withColumn("dl", F.size("tokens"))

    def stats(self) -> DataFrame:
        """One row: n, avgdl (1.0 if all documents are without tokens), avg_chars."""
        sized = self.documents.select(F.length("text").alias("chars"), F.size(tokenize(F.col("text"), self.config.ngram)).alias("dl"))
        avg = F.avg("dl")
        return sized.agg(F.count(F.lit(1)).alias("n"), F.when(avg > 0, avg).otherwise(1.0).alias("avgdl"), F.round(F.avg("chars"), 1).alias("avg_chars"))

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """doc_id, dl, term, tf; only of the given terms if there are any."""
        rows = self.tokens.select("doc_id", "dl", F.explode("tokens").alias("term"))
        if terms is not None:
            rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
        return rows.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))

    def frequencies(self, postings: DataFrame | None = None) -> DataFrame:
        """term, df."""
        return (postings if postings is not None else self.postings()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def term_stats(self, postings: DataFrame | None = None) -> DataFrame:
        """term, df, idf."""
        d = self.config.delta
        idf = F.log(1 + (F.col("n") - F.col("df") + d) / (F.col("df") + d))
        return self.frequencies(postings).crossJoin(F.broadcast(self.stats().select("n"))).select("term", "df", idf.alias("idf"))

    def scores(self, batch: DataFrame) -> DataFrame:
        """query_id, doc_id, score: BM25 of every document that shares a term. batch: query_id, term, qtf (a weight)."""
        c, found = self.config, self.postings(batch)
        weighted = batch.select("query_id", "term", "qtf").join(self.term_stats(found).select("term", "idf"), "term")
        rated = found.join(weighted, "term").crossJoin(F.broadcast(self.stats().select("avgdl")))
        part = F.col("idf") * F.col("tf") * (c.k1 + 1) / (F.col("tf") + c.k1 * (1 - c.b + c.b * F.col("dl") / F.col("avgdl")))
        return rated.groupBy("query_id", "doc_id").agg(rounded(F.sum(F.col("qtf") * part)).alias("score"))

    def search(self, batch: DataFrame, k: int = 4) -> DataFrame:
        """query_id, doc_id, score, rank."""
        return top(self.scores(batch).where("score > 0"), k).select("query_id", "doc_id", "score", "rank")

    # -- TF-IDF stand-in for a dense side -----------------------------------------------------------------------------

    def tfidf_norms(self) -> DataFrame:
        """doc_id, norm under idf = 1 + n / (1 + df)."""
        rows = self.postings()
        return rows.join(self.tfidf_idf(rows), "term").groupBy("doc_id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("w"), 2))).alias("norm"))

    def tfidf_idf(self, postings: DataFrame) -> DataFrame:
        w = 1 + F.greatest("n", F.lit(1)) / (1 + F.col("df"))
        return self.frequencies(postings).crossJoin(F.broadcast(self.stats().select("n"))).select("term", w.alias("w"))

    def tfidf_search(self, batch: DataFrame, k: int = 4) -> DataFrame:
        """query_id, doc_id, score, rank by cosine; unseen query terms weigh 1.0 in the query's norm only."""
        rows = self.postings(batch)
        weighted = batch.join(self.tfidf_idf(rows), "term", "left").withColumn("qw", F.col("qtf") * F.coalesce("w", F.lit(1.0)))
        q_norm = weighted.groupBy("query_id").agg(F.sqrt(F.sum(F.pow("qw", 2))).alias("q_norm"))
        seen = weighted.where(F.col("w").isNotNull()).select("query_id", "term", "qw", "w")
        dots = rows.select("doc_id", "term", "tf").join(seen, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("tf") * F.col("w")).alias("dot"))
        scored = dots.where("dot > 0").join(self.tfidf_norms(), "doc_id").join(q_norm, "query_id").select("query_id", "doc_id", rounded(F.col("dot") / (F.col("q_norm") * F.col("norm"))).alias("score"))
        return top(scored, k).select("query_id", "doc_id", "score", "rank")

    def save(self, path: str) -> SavedIndex:
        """Write the index: postings clustered by term, frequencies, statistics and norms; texts are tokenised once."""
        spark = self.documents.sparkSession
        self.postings().repartition(F.col("term")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        TextIndex.frequencies(self, spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/terms")
        self.stats().write.mode("overwrite").parquet(f"{path}/stats")
        saved = SavedIndex(self, path)
        TextIndex.tfidf_norms(saved).write.mode("overwrite").parquet(f"{path}/norms")
        return saved


class SavedIndex(TextIndex):
    """An index whose statistics and postings are read from tables; texts are only read where texts are asked for."""

    def __init__(self, source: TextIndex, path: str):
        self.config, self.documents, self.tokens, self.path = source.config, source.documents, source.tokens, path

    def _read(self, name: str) -> DataFrame:
        spark: SparkSession = self.documents.sparkSession
        return spark.read.parquet(f"{self.path}/{name}")

    def stats(self) -> DataFrame:
        return self._read("stats")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        rows = self._read("postings")
        return rows if terms is None else rows.join(terms.select("term").distinct(), "term", "left_semi")

    def frequencies(self, postings: DataFrame | None = None) -> DataFrame:
        return self._read("terms")

    def tfidf_norms(self) -> DataFrame:
        return self._read("norms")


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query", ngram: int = 2) -> DataFrame:
    """query_id, term, qtf; a repeated token counts again."""
    rows = queries.select(F.col(id_col).alias("query_id"), F.explode(tokenize(F.col(text_col), ngram)).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("qtf"))


def expanded(batch: DataFrame, expansion: DataFrame, weight: float, ngram: int = 2) -> DataFrame:
    """The batch plus expansion terms, each tokenised again and weighted. expansion: query_id, term."""
    if weight <= 0:
        return batch
    more = expansion.select("query_id", F.explode(tokenize(F.col("term"), ngram)).alias("term")).select("query_id", "term", F.lit(float(weight)).alias("qtf"))
    return batch.select("query_id", "term", "qtf").unionByName(more).groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))


# -- dense ------------------------------------------------------------------------------------------------------------


#: Vectors of a query set that are sent to every task at once.
QUERY_BLOCK = 10_000


def against_all(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row with every query of a stated query set, by blocks of queries that are broadcast."""
    n = queries.count()
    if n <= QUERY_BLOCK:
        return rows.crossJoin(F.broadcast(queries))
    blocks = -(-n // (QUERY_BLOCK // 2))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (rows.crossJoin(F.broadcast(queries.where(block == i))) for i in range(blocks)))


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "dot") -> DataFrame:
    """query_id, doc_id, score, rank by dot product or negative squared distance; a stated query set against all rows.

    Each side: an id and a vector (query_id, q) and (doc_id, v).
    """
    sim = dot(F.col("q"), F.col("v"))
    score = sim if metric == "dot" else -(dot(F.col("q"), F.col("q")) + dot(F.col("v"), F.col("v")) - 2 * sim)
    parts = [search_parts(*sides, k, metric) for sides in _regular(queries, vectors)]
    parts += [pairs.select("query_id", "doc_id", score.alias("score")) for pairs in _irregular(queries, vectors)]
    found = reduce(DataFrame.unionByName, parts).select("query_id", "doc_id", (rounded(F.col("score")) + 0.0).alias("score"))
    return top(found, k).select("query_id", "doc_id", "score", "rank")


def cosine_pairs(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, doc_id, cosine, rounded, of a stated query set with all rows but those of the same id."""
    parts = [all_cosines(*sides) for sides in _regular(queries, vectors)]
    parts += [p.where("doc_id <> query_id").select("query_id", "doc_id", rounded(cosine(F.col("q"), F.col("v"))).alias("cosine")) for p in _irregular(queries, vectors)]
    return reduce(DataFrame.unionByName, parts)


def _dims(queries: DataFrame) -> int:
    found = queries.where(F.col("q").isNotNull()).agg(F.mode(F.size("q"), True)).first()[0]
    return found or 0


def _regular(queries: DataFrame, vectors: DataFrame) -> list[tuple[DataFrame, DataFrame, int, int, int]]:
    """Queries and rows with an id and finite vectors of the queries' usual length, how many they are, and that length; nothing if one side is empty."""
    dims = _dims(queries)
    q, v = queries.where(F.col("query_id").isNotNull() & regular("q", dims)), vectors.where(F.col("doc_id").isNotNull() & regular("v", dims))
    n, m = q.count(), v.count()
    return [(q.select("query_id", "q"), v.select("doc_id", "v"), n, m, dims)] if n and m and dims else []


def _irregular(queries: DataFrame, vectors: DataFrame) -> list[DataFrame]:
    """The other pairs: those of queries that aren't regular with all rows, and of regular ones with rows that aren't; always one table at least."""
    dims = _dims(queries)
    good_q, good_v = F.col("query_id").isNotNull() & regular("q", dims) & F.lit(dims > 0), F.col("doc_id").isNotNull() & regular("v", dims)
    out = [against_all(queries.where(~good_q), vectors)]
    odd = vectors.where(~good_v)
    return [*out, against_all(queries.where(good_q), odd)] if odd.limit(1).count() else out


# -- fusion -----------------------------------------------------------------------------------------------------------


def rrf(lists: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id, score: reciprocal-rank fusion of lists (query_id, list_id, doc_id, rank); weight <= 0 skips a list."""
    w = F.create_map(*(F.lit(x) for p in (weights or {}).items() for x in p))[F.col("list_id")] if weights else F.lit(1.0)
    rows = lists.withColumn("w", F.coalesce(w, F.lit(1.0))).where("w > 0")
    return rows.groupBy("query_id", "doc_id").agg(rounded(F.sum(F.col("w") / (k + F.col("rank")))).alias("score"))


def interleave(lists: DataFrame) -> DataFrame:
    """query_id, doc_id, rank: round robin over the lists, each document once."""
    first = lists.groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "list_id")).alias("first"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).alias("rank"))


def noop_rerank(ranked: DataFrame) -> DataFrame:
    """Pseudo-scores n, n-1, .. 1 in place of scores, except for a single candidate."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return ranked.withColumn("retrieval_score", F.when(n >= 2, (n - F.col("rank") + 1).cast("double")).otherwise(F.col("score")))


def hybrid(sparse: DataFrame, dense: DataFrame, k: int = 4, rrf_k: int = 60, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """query_id, doc_id, rank, rrf_score, retrieval_score, retrieved_by from two ranked pools."""
    lists = sparse.select("query_id", F.lit("bm25").alias("list_id"), "doc_id", "rank").unionByName(dense.select("query_id", F.lit("dense").alias("list_id"), "doc_id", "rank"))
    by = lists.groupBy("query_id", "doc_id").agg(F.array_join(F.array_sort(F.collect_set("list_id")), ",").alias("retrieved_by"))
    fused = rrf(lists, rrf_k, {"bm25": weights[0], "dense": weights[1]}).join(by, ["query_id", "doc_id"])
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return noop_rerank(ranked).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", F.col("score").alias("rrf_score"), "retrieval_score", "retrieved_by")


def cascade(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """The first list; for queries that it has nothing for, the fallback, marked as degraded."""
    rest = fallback.join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.withColumn("degraded", F.lit(False)).unionByName(rest.withColumn("degraded", F.lit(True)))


def mmr(candidates: DataFrame, lam: float = 0.7) -> DataFrame:
    """query_id, doc_id, rank, mmr_score: maximal marginal relevance. candidates: query_id, doc_id, pos, score, tokens.

    A query's candidates are a pool of bounded size, so they are one array. A fold over its length takes the best of the
    rest each time and raises what the others have in common with it; equal values go to the smaller pos.
    """
    pool = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id", "score", "tokens"))).alias("pool"))
    n, peak = F.size("pool"), F.array_max(F.transform("pool", lambda c: c["score"]))
    worth = lambda rel, near: F.lit(lam) * rel - F.lit(1 - lam) * near

    def entry(rel: Column, near: Column, back: Column, doc: Column, tokens: Column) -> Column:
        return F.struct(worth(rel, near).alias("value"), back.alias("back"), rel.alias("rel"), near.alias("near"), doc.alias("doc_id"), tokens.alias("tokens"))

    def first(c: Column, i: Column) -> Column:
        rel = F.when(peak > 0, c["score"] / peak).otherwise((n - i) / n)
        return entry(rel, F.lit(0.0), -i, c["doc_id"], c["tokens"])

    def shared(a: Column, b: Column) -> Column:
        both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
        return F.when(either > 0, both / either).otherwise(F.lit(0.0))

    def step(acc: Column, _: Column) -> Column:
        best = F.array_max(acc["rest"])
        others = F.filter(acc["rest"], lambda x: x["back"] != best["back"])
        nearer = F.transform(others, lambda x: entry(x["rel"], F.greatest(x["near"], shared(x["tokens"], best["tokens"])), x["back"], x["doc_id"], x["tokens"]))
        return F.struct(nearer.alias("rest"), F.concat(acc["out"], F.array(F.struct(best["doc_id"].alias("doc_id"), best["value"].alias("value")))).alias("out"))

    kind = candidates.schema["doc_id"].dataType.simpleString()
    start = F.struct(F.transform("pool", first).alias("rest"), F.array().cast(f"array<struct<doc_id:{kind},value:double>>").alias("out"))
    chosen = pool.select("query_id", F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: acc["out"]).alias("out"))
    least = F.array_min(F.transform("out", lambda x: x["value"]))
    rows = chosen.select("query_id", F.size("out").alias("n"), least.alias("least"), F.posexplode("out").alias("at", "x"))
    score = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.col("x.value") - F.col("least") + F.lit(1e-9))
    return rows.select("query_id", "x.doc_id", (F.col("at") + 1).alias("rank"), score.alias("mmr_score"))


# -- texts of hits ----------------------------------------------------------------------------------------------------


#: Hits up to which they are sent to every task that reads documents, so that no text is shuffled for them; they are counted.
FEW_HITS = 500_000


def with_documents(index: TextIndex, hits: DataFrame, *columns: str) -> DataFrame:
    """The hits (doc_id, ..), written once, with columns of their documents."""
    hits = stash(hits, "hits")
    few = hits.count() <= FEW_HITS
    return index.documents.select("doc_id", *columns).join(F.broadcast(hits) if few else hits, "doc_id")


# -- expansion by feedback --------------------------------------------------------------------------------------------


def model_rerank(hits: DataFrame, predict: Callable[[list[tuple[str, str]]], Sequence[float]], batch: int = 16) -> DataFrame:
    """The hits (query_id, doc_id, rank, score, query, text, ..) without their texts, in the order of a model's scores, the smaller id first among equals; and reranked.

    ``predict`` gets up to ``batch`` pairs (query, text) of one query, null texts as empty ones.  A query keeps its ranks and scores, and reranked is
    false, if predict raises, answers with another number of scores, or with one that is no finite number, and if it has but one hit.
    A query's hits are the pool of a search, so they are taken into memory.
    """
    kept = [f for f in hits.schema.fields if f.name not in ("query", "text", "reranked")]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", reranked boolean"

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[names].assign(reranked=False)
        pairs = [(q or "", t or "") for q, t in zip(rows["query"], rows["text"])]
        if len(pairs) < 2:
            return out
        try:
            scores = [float(s) for i in range(0, len(pairs), batch) for s in predict(pairs[i : i + batch])]
        except Exception:
            logging.getLogger("tarnwell").warning("reranking failed, order kept", exc_info=True)
            return out
        if len(scores) != len(pairs) or not all(map(math.isfinite, scores)):
            return out
        out = out.assign(score=scores, reranked=True).sort_values(["score", "doc_id"], ascending=[False, True])
        return out.assign(rank=range(1, len(out) + 1))

    return hits.select(*names, "query", "text").groupBy("query_id").applyInPandas(order, schema)


@dataclass(frozen=True)
class Feedback:
    docs: int = 3
    terms: int = 6
    weight: float = 0.3
    min_len: int = 2
    min_support: int = 2
    per_source: int = 2
    min_idf: float = 0.6


def source_cap(hits: DataFrame, per_source: int, docs: int) -> DataFrame:
    """At most ``per_source`` hits a source group, the first ``docs`` of these. hits: query_id, doc_id, rank, source."""
    grouped = hits.withColumn("grp", source_group(F.col("source")))
    within = F.row_number().over(Window.partitionBy("query_id", "grp").orderBy("rank"))
    kept = grouped.withColumn("nth", within).where(F.col("nth") <= per_source)
    return kept.withColumn("kept_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("kept_rank") <= docs).drop("nth")


def feedback_terms(index: TextIndex, batch: DataFrame, config: Feedback = Feedback()) -> DataFrame:
    """query_id, term, weight, support, rank: expansion terms from the first hits; a few rows a query, written once."""
    hits = with_documents(index, index.search(batch, config.docs * 3), "source")
    kept = source_cap(hits, config.per_source, config.docs).select("query_id", "doc_id")
    # the texts of the kept documents have their terms; no other posting is read
    texts = with_documents(index, kept, "text")
    terms = texts.select("query_id", "doc_id", F.explode(tokenize(F.col("text"), index.config.ngram)).alias("term"))
    idf = index.term_stats().where(F.col("idf") >= config.min_idf).select("term", "idf")
    usable = (F.length("term") >= config.min_len) & ~F.col("term").rlike("^[0-9]+$")
    found = terms.where(usable).groupBy("query_id", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf")).join(batch.select("query_id", "term"), ["query_id", "term"], "left_anti").join(idf, "term")
    rated = found.groupBy("query_id", "term").agg(rounded(F.sum(F.col("tf") * F.col("idf"))).alias("weight"), F.count(F.lit(1)).alias("support")).where(F.col("support") >= config.min_support)
    best = rated.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "term"))).where(F.col("rank") <= config.terms)
    return stash(best, "feedback")


# -- relevance and checks of question sets -----------------------------------------------------------------------------


def relevance(index: TextIndex, questions: DataFrame, threshold: float = 0.85) -> DataFrame:
    """query_id, doc_id, containment: documents with enough of the evidence's tokens, and what part of them; for questions without evidence,
    those whose source contains source_contains, with a null.

    questions: query_id, evidence, source_contains.  Case doesn't count in sources; blank texts count as missing, and a question with neither
    has no relevant document.  Tokens come from the index; sources are searched once each, whatever number of documents they have.
    """
    evidence = F.coalesce(strip(F.col("evidence")), F.lit(""))
    etok = questions.where(evidence != "").select("query_id", F.array_distinct(tokenize(F.col("evidence"), index.config.ngram)).alias("etok"))
    terms = stash(etok.select("query_id", F.size("etok").alias("ne"), F.explode("etok").alias("term")), "evidence")
    held = index.postings(terms).select("doc_id", "term").join(terms, "term").groupBy("query_id", "doc_id").agg((F.count(F.lit(1)) / F.first("ne")).alias("c"))
    by_source = questions.where(evidence == "").select(F.col("query_id").alias("needle_id"), F.lower(strip(F.col("source_contains"))).alias("needle"))
    sources = index.documents.select("doc_id", F.lower("source").alias("text"))
    found = substring_join(sources.select("text").distinct().select(F.col("text").alias("text_id"), "text"), by_source)
    rows = found.join(sources, F.col("text_id") == F.col("text")).select(F.col("needle_id").alias("query_id"), "doc_id")
    return held.where(F.col("c") >= threshold).select("query_id", "doc_id", F.col("c").alias("containment")).unionByName(rows.withColumn("containment", F.lit(None).cast("double")))


def relevant_documents(index: TextIndex, questions: DataFrame, threshold: float = 0.85) -> DataFrame:
    """query_id, doc_id of ``relevance``."""
    return relevance(index, questions, threshold).select("query_id", "doc_id")


def dataset_violations(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """id, violation, n: five checks of a question set. questions: id, answerable, evidence, reference_answer; documents: text.

    Evidence has to stand in one text, blanks aside; nulls are empty, and a null ``answerable`` is false.
    """
    empty = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    yes = F.coalesce("answerable", F.lit(False))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    rows = questions.select("id", yes.alias("yes"), empty("evidence").alias("blank"), empty("reference_answer").alias("mute"), F.when(yes & ~empty("evidence"), bare("evidence")).alias("needle"))
    needles = rows.where("needle is not null").select("needle").distinct().select(F.col("needle").alias("needle_id"), "needle")
    held = substring_join(documents.select(F.lit(0).alias("text_id"), bare("text").alias("text")), needles).select(F.col("needle_id").alias("needle")).distinct()
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("violation"), "n")
    foreign = rows.where("needle is not null").join(held, "needle", "left_anti").select("id", F.lit("evidence not in corpus").alias("violation"))
    by_row = rows.select("id", F.explode(F.array_compact(F.array(
        F.when(F.col("yes") & F.col("blank"), "no evidence"), F.when(F.col("yes") & F.col("mute"), "no reference answer"), F.when(~F.col("yes") & ~F.col("blank"), "evidence though unanswerable"),
    ))).alias("violation"))
    return by_row.unionByName(foreign).groupBy("id", "violation").agg(F.count(F.lit(1)).alias("n")).unionByName(repeated)


# -- quality of rankings ----------------------------------------------------------------------------------------------


def first_relevant(hits: DataFrame, relevant: Column, questions: DataFrame) -> DataFrame:
    """query_id, answerable, first_rank (null if none): questions: query_id, answerable."""
    best = hits.where(relevant).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return questions.join(best, "query_id", "left").select("query_id", "answerable", F.when(F.col("answerable"), F.col("first_rank")).alias("first_rank"))


def hit_mrr(ranks: DataFrame, *keys: str) -> DataFrame:
    """Hit@1/3/5, MRR and mean first rank over answerable questions."""
    n = F.greatest(F.count_if("answerable"), F.lit(1))
    hit = lambda k: F.round(F.count_if(F.col("answerable") & (F.col("first_rank") <= k)) / n, 4).alias(f"hit_at_{k}")
    mrr = F.round(F.coalesce(F.sum(F.when(F.col("answerable"), 1 / F.col("first_rank"))), F.lit(0.0)) / n, 4).alias("mrr")
    return ranks.groupBy(*keys).agg(F.count_if("answerable").alias("n_answerable"), hit(1), hit(3), hit(5), mrr, F.round(F.avg("first_rank"), 3).alias("avg_first_rank"))
