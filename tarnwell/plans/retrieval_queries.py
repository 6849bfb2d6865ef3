"""Queries of chunking, indexing, ranking, expansion and their evaluation.

``documents`` is the collection; the passages of ``benchmark`` are the evidence, and as a whole also the questions.  Only the
comparisons of strategies, weights and rewriting ask with a passage's first eight tokens (SHORT), as its whole would be
found by all of them.  A passage is answerable if some document contains it word by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.functions import text as T
from tarnwell.functions.prompts import messages
from tarnwell.operators import chunking
from tarnwell.operators import events as E
from tarnwell.operators import retrieval as R
from tarnwell.operators.segments import SegmentedIndex
from tarnwell.operators.substrings import substring_join
from tarnwell.operators.vectors import VectorIndex
from tarnwell.sources.shared import new_path

from .registry import query, table

SHORT = 8
_TOK = "regexp_extract_all(lower({}), '[a-z0-9][a-z0-9._+#/:-]*')"

_BASE = f"""
d AS (SELECT doc_id, source, text, {_TOK.format('text')} AS tokens FROM documents WHERE trim(text) <> ''),
x AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM x GROUP BY 1, 2, 3),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
ts AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM ts, st),
q AS (SELECT item_id AS query_id, unnest({_TOK.format('text')}) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM q GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM post JOIN qt USING (term) JOIN idf USING (term), st GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0),
ev AS (SELECT item_id AS query_id, text AS evidence, {_TOK.format('text')} AS etok FROM benchmark),
ans AS (SELECT query_id, bool_or(contains(d.text, evidence)) AS answerable FROM ev, d GROUP BY 1)"""

_SHORT = _BASE.replace(f"unnest({_TOK.format('text')}) AS term FROM benchmark", f"unnest(list_slice({_TOK.format('text')}, 1, {SHORT})) AS term FROM benchmark")

_TFIDF = """
w AS (SELECT term, 1 + greatest(n, 1) / (1 + df) AS w FROM ts, st),
norm AS (SELECT doc_id, sqrt(sum(pow(tf * w, 2))) AS norm FROM post JOIN w USING (term) GROUP BY 1),
qn AS (SELECT query_id, sqrt(sum(pow(qtf * coalesce(w, 1.0), 2))) AS q_norm FROM qt LEFT JOIN w USING (term) GROUP BY 1),
dots AS (SELECT query_id, doc_id, sum(qtf * w * tf * w) AS dot FROM post JOIN qt USING (term) JOIN w USING (term) GROUP BY 1, 2),
cs AS (SELECT query_id, doc_id, round(dot / (q_norm * norm), 6) AS score FROM dots JOIN norm USING (doc_id) JOIN qn USING (query_id) WHERE dot > 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs)"""

_REL = """
hits AS (SELECT r.query_id, r.doc_id, r.rank, len(list_intersect(list_distinct(etok), tokens)) / len(list_distinct(etok)) >= 0.85 AS rel
         FROM {ranked} r JOIN d USING (doc_id) JOIN ev USING (query_id) WHERE r.rank <= 5),
fr AS (SELECT query_id, answerable, CASE WHEN answerable THEN first_rank END AS first_rank
       FROM ans LEFT JOIN (SELECT query_id, min(rank) AS first_rank FROM hits WHERE rel GROUP BY 1) USING (query_id))"""

_HIT = """count_if(answerable)::BIGINT AS n_answerable, round(count_if(answerable AND first_rank <= 1) / greatest(count_if(answerable), 1), 4) AS hit_at_1,
round(count_if(answerable AND first_rank <= 3) / greatest(count_if(answerable), 1), 4) AS hit_at_3, round(count_if(answerable AND first_rank <= 5) / greatest(count_if(answerable), 1), 4) AS hit_at_5,
round(coalesce(sum(CASE WHEN answerable THEN 1 / first_rank END), 0) / greatest(count_if(answerable), 1), 4) AS mrr, round(avg(first_rank), 3) AS avg_first_rank"""


_saved: dict[tuple, str] = {}


def _state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Files, bytes and latest change of a table, which tell whether an index of it is still good."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = store.getContentSummary(at)
    return whole.getFileCount(), whole.getLength(), max([store.getFileStatus(at).getModificationTime(), *(f.getModificationTime() for f in store.listStatus(at))])


def _key(spark: SparkSession, d: str) -> tuple:
    return (spark.sparkContext.applicationId, d, *_state(spark, f"{d}/documents.parquet"))


def index(spark: SparkSession, d: str) -> R.TextIndex:
    """The index of documents, saved in the shared folder when it is first asked for, and again if the table changes."""
    key = _key(spark, d)
    if key not in _saved:
        path = new_path(spark, "index")
        SegmentedIndex.create(spark, path, table(spark, d, "documents").select("doc_id", "text", "source"))
        _saved[key] = path
    return SegmentedIndex.open(spark, _saved[key])


def batch(spark: SparkSession, d: str, short: bool = False) -> DataFrame:
    """query_id, term, qtf of the questions."""
    tokens = T.tokenize(F.col("text"))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.slice(tokens, 1, SHORT) if short else tokens).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("qtf"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("evidence"), T.tokenize(F.col("text")).alias("etok"))


def answerable(spark: SparkSession, d: str) -> DataFrame:
    """query_id, answerable, null where a passage is; no rows without documents. Every text is searched for all passages, in one pass."""
    texts = table(spark, d, "documents").where(~F.col("text").rlike(r"^\p{Zs}*\z")).select(F.lit(0).alias("text_id"), "text")
    ev = evidence(spark, d).select("query_id", "evidence")
    held = substring_join(texts, ev.select(F.col("evidence").alias("needle_id"), F.col("evidence").alias("needle")).distinct()).select(F.col("needle_id").alias("evidence")).distinct()
    # an empty passage stands in every text
    found = ev.join(held.withColumn("held", F.lit(True)), "evidence", "left").withColumn("held", F.when(F.col("evidence").isNotNull(), F.coalesce("held", F.col("evidence") == "")))
    return found.crossJoin(F.broadcast(texts.select("text_id").limit(1))).groupBy("query_id").agg(F.bool_or("held").alias("answerable"))


def tokens_of(idx: R.TextIndex, hits: DataFrame) -> DataFrame:
    """The hits with their documents' tokens; only texts of hits are tokenised."""
    rows = R.with_documents(idx, hits, "text")
    return rows.withColumn("tokens", T.tokenize(F.col("text"))).drop("text")


def ranks_of(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """query_id, answerable, first_rank: containment is computed on the listed documents only."""
    idx, ev = index(spark, d), evidence(spark, d)
    listed = tokens_of(idx, hits.where("rank <= 5")).join(ev, "query_id")
    return R.first_relevant(listed, T.token_containment(F.col("tokens"), F.col("etok")) >= 0.85, answerable(spark, d))


# -- tokens and text functions over the tables ------------------------------------------------------------------------


@query("normalize_text", "SELECT doc_id, lower(text) AS normal FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("normal"))


@query("tokenize_latin", f"SELECT doc_id, array_to_string({_TOK.format('text')}, ' ') AS tokens FROM documents")
def tokenize_latin(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.latin_tokens(T.normalize(F.col("text"))), " ").alias("tokens"))


#: Vowels of the documents become ideographs, so that their words hold runs of them.
_CJK_FROM, _CJK_TO = "aeiou", "文档切分海"


@query(
    "tokenize_cjk",
    f"""WITH r AS (SELECT doc_id, regexp_extract_all(translate(lower(text), '{_CJK_FROM}', '{_CJK_TO}'), '[㐀-䶿一-鿿豈-﫿]+') AS runs FROM documents),
    g AS (SELECT doc_id, flatten(list_transform(runs, lambda r: list_concat(list_transform(range(1, len(r) + 1), lambda i: substring(r, i, 1)),
      CASE WHEN len(r) >= 2 THEN list_transform(range(1, len(r)), lambda i: substring(r, i, 2)) ELSE [] END))) AS g FROM r)
    SELECT doc_id, array_to_string(g, ' ') AS tokens FROM g""",
)
def tokenize_cjk(spark, d):
    text = F.translate(F.lower("text"), _CJK_FROM, _CJK_TO)
    return table(spark, d, "documents").select("doc_id", F.array_join(T.cjk_tokens(text), " ").alias("tokens"))


@query("tokenize_counts", f"SELECT doc_id, len({_TOK.format('text')})::BIGINT AS n_tokens FROM documents")
def tokenize_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokenize(F.col("text"))).cast("long").alias("n_tokens"))


@query("strip_ws", "SELECT doc_id, lower(regexp_replace(text, '\\s+', '', 'g')) AS bare FROM documents")
def strip_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_ws(F.col("text")).alias("bare"))


# -- chunks -----------------------------------------------------------------------------------------------------------


def chunks(spark, d) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents"))


@query("chunk_documents")
def chunk_documents(spark, d):
    return chunks(spark, d)


@query("chunk_split")
def chunk_split(spark, d):
    pieces = chunking.recursive_split(T.strip(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.posexplode(pieces).alias("pos", "piece"))


@query("chunk_merge")
def chunk_merge(spark, d):
    words = F.split(F.col("text"), "(?<= )")
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.merge_splits(words)).alias("pos", "chunk"))


@query("chunk_stats")
def chunk_stats(spark, d):
    return chunks(spark, d).agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(F.length("content")), 6).alias("avg_chars"), F.max(F.length("content")).alias("max_chars"))


@query("ingest_chunk_counts", """WITH w AS (SELECT doc_id, source, text FROM documents WHERE trim(text) <> '')
SELECT source, count(*) AS n_docs, sum(len(text))::BIGINT AS n_chars FROM w GROUP BY 1""")
def ingest_chunk_counts(spark, d):
    rows = table(spark, d, "documents").where(T.strip(F.col("text")) != "")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


# -- index ------------------------------------------------------------------------------------------------------------


@query("term_freq", f"WITH {_BASE} SELECT doc_id, term, tf FROM post")
def term_freq(spark, d):
    return index(spark, d).postings().select("doc_id", "term", "tf")


@query("doc_freq", f"WITH {_BASE} SELECT term, df FROM ts")
def doc_freq(spark, d):
    return index(spark, d).term_stats().select("term", "df")


@query("idf", f"WITH {_BASE} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf(spark, d):
    return index(spark, d).term_stats().select("term", "df", R.rounded(F.col("idf")).alias("idf"))


@query("corpus_stats", f"WITH {_BASE} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, d):
    return index(spark, d).stats().select("n", R.rounded(F.col("avgdl")).alias("avgdl"))


@query("index_stats", "SELECT count(*) AS n_docs, round(avg(len(text)), 1) AS avg_chars FROM documents WHERE trim(text) <> ''")
def index_stats(spark, d):
    return index(spark, d).stats().select(F.col("n").alias("n_docs"), "avg_chars")


@query("tfidf_norm", f"WITH {_BASE}, {_TFIDF} SELECT doc_id, round(norm, 6) AS norm FROM norm")
def tfidf_norm(spark, d):
    return index(spark, d).tfidf_norms().select("doc_id", R.rounded(F.col("norm")).alias("norm"))


@query("content_index", "SELECT md5(text) AS content, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents GROUP BY text")
def content_index(spark, d):
    rows = table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("content"))
    return rows.agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("ids"))


@query("index_roundtrip", f"WITH {_BASE} SELECT count(*) AS n_postings, sum(tf)::BIGINT AS n_tokens FROM post")
def index_roundtrip(spark, d):
    found = SegmentedIndex.open(spark, index(spark, d).path).postings()
    return found.agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens"))


#: What the index holds after the changes of ``changed_index``: documents that aren't labelled toxic.
_CHANGED = _BASE.replace("FROM documents WHERE trim(text) <> ''", "FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")


def changed_index(spark: SparkSession, d: str) -> SegmentedIndex:
    """An index by changes: a segment for each language, with the first one's texts cut to be replaced by whole ones; then toxic documents are deleted and segments merged."""
    key = (*_key(spark, d), "changed")
    if key not in _saved:
        rows = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
        langs = sorted(r.lang or "" for r in rows.select("lang").distinct().collect())
        part = lambda lang: rows.where(F.coalesce("lang", F.lit("")) == lang).drop("lang")
        idx = SegmentedIndex.create(spark, new_path(spark, "changed"), part(langs[0]).withColumn("text", F.concat(F.lit("old "), F.substring("text", 1, 50))))
        for lang in [*langs[1:], langs[0]]:
            idx = idx.add(part(lang))
        idx = idx.delete(table(spark, d, "labels").where("toxic = 1").select("doc_id"))
        idx.merge(3)
        _saved[key] = idx.path
    return SegmentedIndex.open(spark, _saved[key])


@query("changed_index_topk", f"WITH {_CHANGED} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 5")
def changed_index_topk(spark, d):
    return changed_index(spark, d).search(batch(spark, d), 5)


@query("changed_index_terms", f"WITH {_CHANGED} SELECT term, df, round(idf, 6) AS idf FROM idf")
def changed_index_terms(spark, d):
    return changed_index(spark, d).term_stats().select("term", "df", R.rounded(F.col("idf")).alias("idf"))


# -- ranking ----------------------------------------------------------------------------------------------------------


@query("bm25_scores", f"WITH {_BASE} SELECT query_id, doc_id, score FROM bm")
def bm25_scores(spark, d):
    return index(spark, d).scores(batch(spark, d))


@query("bm25_topk", f"WITH {_BASE} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 5")
def bm25_topk(spark, d):
    return index(spark, d).search(batch(spark, d), 5)


@query("tfidf_cosine_topk", f"WITH {_BASE}, {_TFIDF} SELECT query_id, doc_id, score, rank FROM dense WHERE rank <= 5")
def tfidf_cosine_topk(spark, d):
    return index(spark, d).tfidf_search(batch(spark, d), 5)


_PRF = """
fb AS (SELECT r.*, split_part(source, '__', 1) AS grp FROM ranked r JOIN d USING (doc_id) WHERE r.rank <= 9),
fb2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY rank) AS nth FROM fb),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS kept_rank FROM fb2 WHERE nth <= 2),
cand AS (SELECT k.query_id, p.term, round(sum(p.tf * i.idf), 6) AS weight, count(*) AS support FROM kept k JOIN post p USING (doc_id) JOIN idf i USING (term)
  WHERE k.kept_rank <= 3 AND i.idf >= 0.6 AND len(p.term) >= 2 AND NOT regexp_full_match(p.term, '[0-9]+') AND NOT EXISTS (SELECT 1 FROM qt WHERE qt.query_id = k.query_id AND qt.term = p.term)
  GROUP BY 1, 2 HAVING count(*) >= 2),
prf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS rank FROM cand) WHERE rank <= 6)"""


@query("source_cap", f"WITH {_BASE}, {_PRF} SELECT query_id, doc_id, rank, kept_rank FROM kept WHERE kept_rank <= 3")
def source_cap(spark, d):
    idx = index(spark, d)
    hits = R.with_documents(idx, idx.search(batch(spark, d), 9), "source")
    return R.source_cap(hits, 2, 3).select("query_id", "doc_id", "rank", "kept_rank")


@query("prf_terms", f"WITH {_BASE}, {_PRF} SELECT query_id, term, weight, support, rank FROM prf")
def prf_terms(spark, d):
    return R.feedback_terms(index(spark, d), batch(spark, d)).select("query_id", "term", "weight", "support", "rank")


def _expanded_sql(weight: str, more: str) -> str:
    return f"""
ex AS (SELECT query_id, unnest({_TOK.format('term')}) AS term, {weight} AS qtf FROM {more}),
qt2 AS (SELECT query_id, term, sum(qtf) AS qtf FROM (SELECT query_id, term, qtf FROM qt UNION ALL SELECT query_id, term, qtf FROM ex) GROUP BY 1, 2),
bm2 AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN qt2 USING (term) JOIN idf USING (term), st GROUP BY 1, 2),
ranked2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm2 WHERE score > 0)"""


@query("bm25_expanded", f"WITH {_BASE}, more AS (SELECT item_id AS query_id, 'the' AS term FROM benchmark UNION ALL SELECT item_id, 'de' FROM benchmark), {_expanded_sql('0.3', 'more')} SELECT query_id, doc_id, score, rank FROM ranked2 WHERE rank <= 5")
def bm25_expanded(spark, d):
    more = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit("the"), F.lit("de"))).alias("term"))
    return index(spark, d).search(R.expanded(batch(spark, d), more, 0.3), 5)


@query("bm25_prf_topk", f"WITH {_BASE}, {_PRF}, {_expanded_sql('0.3', 'prf')} SELECT query_id, doc_id, score, rank, CASE WHEN query_id IN (SELECT query_id FROM prf) THEN 'bm25+rewrite' ELSE 'bm25' END AS retrieved_by FROM ranked2 WHERE rank <= 5")
def bm25_prf_topk(spark, d):
    idx, b = index(spark, d), batch(spark, d)
    terms = R.feedback_terms(idx, b).select("query_id", "term")
    found = idx.search(R.expanded(b, terms, 0.3), 5)
    by = terms.select("query_id").distinct().withColumn("x", F.lit(1))
    return found.join(by, "query_id", "left").select("query_id", "doc_id", "score", "rank", F.when(F.col("x").isNotNull(), "bm25+rewrite").otherwise("bm25").alias("retrieved_by"))


_LISTS = "lists AS (SELECT query_id, 'bm25' AS list_id, doc_id, rank FROM ranked WHERE rank <= 20 UNION ALL SELECT query_id, 'dense', doc_id, rank FROM dense WHERE rank <= 20)"
_FUSED = f"{_LISTS}, fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, array_to_string(list_sort(list(DISTINCT list_id)), ',') AS retrieved_by FROM lists GROUP BY 1, 2)"
_HYBRID = f"{_FUSED}, hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM fused)"


def _pools(spark, d, short: bool = False):
    idx, b = index(spark, d), batch(spark, d, short)
    return idx.search(b, 20), idx.tfidf_search(b, 20)


def _lists(spark, d, short: bool = False) -> DataFrame:
    sparse, dense = _pools(spark, d, short)
    return sparse.select("query_id", F.lit("bm25").alias("list_id"), "doc_id", "rank").unionByName(dense.select("query_id", F.lit("dense").alias("list_id"), "doc_id", "rank"))


@query("rrf_fusion", f"WITH {_BASE}, {_TFIDF}, {_FUSED} SELECT query_id, doc_id, score FROM fused")
def rrf_fusion(spark, d):
    return R.rrf(_lists(spark, d))


@query("interleave_dedup", f"WITH {_BASE}, {_TFIDF}, {_LISTS}, f AS (SELECT query_id, doc_id, min((rank, list_id)) AS first FROM lists GROUP BY 1, 2) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM f")
def interleave_dedup(spark, d):
    return R.interleave(_lists(spark, d))


@query("hybrid_topk", f"WITH {_BASE}, {_TFIDF}, {_HYBRID} SELECT query_id, doc_id, rank, score AS rrf_score, CASE WHEN n >= 2 THEN (n - rank + 1)::DOUBLE ELSE score END AS retrieval_score, retrieved_by FROM hy WHERE rank <= 4")
def hybrid_topk(spark, d):
    return R.hybrid(*_pools(spark, d), k=4)


@query("cascade_fallback", f"WITH {_BASE}, {_TFIDF}, one AS (SELECT * FROM ranked WHERE rank <= 4 AND query_id % 2 = 0) SELECT query_id, doc_id, score, rank, false AS degraded FROM one UNION ALL SELECT query_id, doc_id, score, rank, true FROM dense WHERE rank <= 4 AND query_id NOT IN (SELECT query_id FROM one)")
def cascade_fallback(spark, d):
    idx, b = index(spark, d), batch(spark, d)
    return R.cascade(idx.search(b.where("query_id % 2 = 0"), 4), idx.tfidf_search(b, 4))


@query("mmr_rerank")
def mmr_rerank(spark, d):
    idx = index(spark, d)
    pool = tokens_of(idx, idx.search(batch(spark, d), 20)).withColumn("tokens", F.array_distinct("tokens"))
    return R.mmr(pool.select("query_id", "doc_id", F.col("rank").alias("pos"), "score", "tokens"))


_VEC_Q = "SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0"


def _vectors(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


_VEC_RANK = """SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
 FROM (SELECT query_id, vec_id AS doc_id, round({}, 6) + 0.0::DOUBLE AS score FROM embeddings, qv)) WHERE rank <= {}"""
_DOT = "list_dot_product(q::DOUBLE[], embedding::DOUBLE[])"


@query("dense_dot_topk", f"WITH qv AS ({_VEC_Q}) " + _VEC_RANK.format(_DOT, 20))
def dense_dot_topk(spark, d):
    return R.dense_search(*_vectors(spark, d), 20)


@query("dense_topk", f"WITH qv AS ({_VEC_Q}) " + _VEC_RANK.format(f"-(list_dot_product(q::DOUBLE[], q::DOUBLE[]) + list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 2 * {_DOT})", 10))
def dense_topk(spark, d):
    return R.dense_search(*_vectors(spark, d), 10, "l2")


def vector_index(spark: SparkSession, d: str) -> VectorIndex:
    """The index of embeddings with the texts of documents of the same number, saved when it is first asked for."""
    key = (*_key(spark, d), *_state(spark, f"{d}/embeddings.parquet"), "vectors")
    if key not in _saved:
        texts = table(spark, d, "documents").select("doc_id", "text", "source")
        rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")).join(texts, "doc_id", "left")
        path = new_path(spark, "vectors")
        VectorIndex.create(spark, path, rows)
        _saved[key] = path
    return VectorIndex.open(spark, _saved[key])


@query("vector_index_topk", f"WITH qv AS ({_VEC_Q}) " + _VEC_RANK.format(f"-(list_dot_product(q::DOUBLE[], q::DOUBLE[]) + list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 2 * {_DOT})", 10))
def vector_index_topk(spark, d):
    return vector_index(spark, d).search(_vectors(spark, d)[0], 10, exact=True)


@query("vector_index_recall")
def vector_index_recall(spark, d):
    """Pruned search against exact search, of every row whose id is divisible by 20."""
    return vector_index(spark, d).recall(_vectors(spark, d)[0], 10)


_STORED = _BASE.replace("FROM documents WHERE trim(text) <> ''", "FROM documents WHERE trim(text) <> '' AND doc_id IN (SELECT vec_id FROM embeddings)")


@query("dense_to_sparse_topk", f"WITH {_STORED} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 5")
def dense_to_sparse_topk(spark, d):
    """A text index made of the texts that the vector index has."""
    key = (*_key(spark, d), "migrated")
    if key not in _saved:
        _saved[key] = vector_index(spark, d).to_text_index(new_path(spark, "migrated")).path
    return SegmentedIndex.open(spark, _saved[key]).search(batch(spark, d), 5)


@query("cosine_pairs", f"WITH qv AS ({_VEC_Q}) SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine FROM embeddings, qv WHERE vec_id <> query_id")
def cosine_pairs(spark, d):
    return R.cosine_pairs(*_vectors(spark, d))


@query("recall_at_threshold", f"WITH qv AS ({_VEC_Q}), t AS ({_VEC_RANK.format(_DOT, 10)}) SELECT query_id, round(sum(CASE WHEN score >= 0.35 THEN 1 ELSE 0 END) / 10.0, 1) AS recall FROM t GROUP BY 1")
def recall_at_threshold(spark, d):
    found = R.dense_search(*_vectors(spark, d), 10)
    return found.groupBy("query_id").agg(F.round(F.sum(F.when(F.col("score") >= 0.35, 1).otherwise(0)) / 10.0, 1).alias("recall"))


@query("resolve_dups", """WITH l AS (SELECT doc_id AS local_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents)
SELECT doc_id, local_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS nth FROM documents) JOIN l USING (text, nth)""")
def resolve_dups(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content"))
    nth = lambda order: F.row_number().over(Window.partitionBy("content").orderBy(order))
    local = rows.select(F.col("doc_id").alias("local_id"), "content").withColumn("nth", nth(F.col("local_id")))
    return rows.withColumn("nth", nth(F.desc("doc_id"))).join(local, ["content", "nth"]).select("doc_id", "local_id")


# -- evaluation -------------------------------------------------------------------------------------------------------


@query("token_containment", f"WITH {_BASE} SELECT query_id, doc_id, round(len(list_intersect(list_distinct(etok), tokens)) / len(list_distinct(etok)), 6) AS containment FROM ranked JOIN d USING (doc_id) JOIN ev USING (query_id) WHERE rank <= 5")
def token_containment(spark, d):
    idx = index(spark, d)
    rows = tokens_of(idx, idx.search(batch(spark, d), 5)).join(evidence(spark, d), "query_id")
    return rows.select("query_id", "doc_id", R.rounded(T.token_containment(F.col("tokens"), F.col("etok"))).alias("containment"))


_BARE = "lower(regexp_replace({}, '\\s+', '', 'g'))"


@query("char_containment", f"""WITH {_BASE}, b AS (SELECT query_id, doc_id, {_BARE.format('d.text')} AS c, {_BARE.format('evidence')} AS e FROM ranked JOIN d USING (doc_id) JOIN ev USING (query_id) WHERE rank <= 5)
SELECT query_id, doc_id, round(CASE WHEN contains(c, e) THEN 1.0 ELSE len(list_filter(string_split(e, ''), lambda x: contains(c, x))) / len(e) END, 6) AS containment FROM b""")
def char_containment(spark, d):
    idx = index(spark, d)
    rows = R.with_documents(idx, idx.search(batch(spark, d), 5), "text").join(evidence(spark, d), "query_id")
    return rows.select("query_id", "doc_id", R.rounded(T.char_containment(F.col("text"), F.col("evidence"))).alias("containment"))


@query("char_overlap", f"""WITH b AS (SELECT item_id, {_BARE.format('left(text, 60)')} AS q, {_BARE.format('substr(text, 61)')} AS e FROM benchmark)
SELECT item_id, round(len(list_filter(string_split(q, ''), lambda x: contains(e, x))) / len(q), 6) AS overlap FROM b""")
def char_overlap(spark, d):
    rows = table(spark, d, "benchmark")
    return rows.select("item_id", R.rounded(T.char_overlap(F.substring("text", 1, 60), F.expr("substring(text, 61)"))).alias("overlap"))


_PAIRS = """et AS (SELECT query_id, unnest(list_distinct(etok)) AS term, len(list_distinct(etok)) AS ne FROM ev),
pairs AS (SELECT query_id, doc_id, count(*) / any_value(ne) AS containment FROM et JOIN (SELECT DISTINCT doc_id, term FROM x) USING (term) GROUP BY 1, 2)"""


def _pairs(spark, d) -> DataFrame:
    """query_id, doc_id, containment of all pairs with a common token, by an equi-join on tokens."""
    ev = evidence(spark, d).select("query_id", F.array_distinct("etok").alias("etok"))
    terms = ev.select("query_id", F.size("etok").alias("ne"), F.explode("etok").alias("term"))
    rows = index(spark, d).postings(terms).select("doc_id", "term")
    return rows.join(terms, "term").groupBy("query_id", "doc_id").agg((F.count(F.lit(1)) / F.first("ne")).alias("containment"))


_TRIM = "trim(source, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))"


@query("relevance_pairs", f"""WITH {_BASE}, {_PAIRS}, s AS (SELECT -1 - min(doc_id) AS query_id, lower({_TRIM}) AS needle FROM documents WHERE {_TRIM} <> '' GROUP BY source)
SELECT query_id, doc_id, round(containment, 6) AS containment FROM pairs WHERE containment >= 0.85 UNION ALL SELECT s.query_id, d.doc_id, NULL::DOUBLE FROM s JOIN d ON contains(lower(d.source), needle)""")
def relevance_pairs(spark, d):
    """Passages by their tokens; questions without evidence ask for each source, numbered down from -1 by its smallest doc_id, and have no containment."""
    passages = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("evidence"), F.lit("").alias("source_contains"))
    sources = table(spark, d, "documents").groupBy("source").agg((-1 - F.min("doc_id")).alias("query_id")).select("query_id", F.lit(" ").alias("evidence"), F.col("source").alias("source_contains"))
    return R.relevance(index(spark, d), passages.unionByName(sources)).select("query_id", "doc_id", R.rounded(F.col("containment")).alias("containment"))


@query("relevant_documents", f"""WITH {_BASE}, {_PAIRS} SELECT concat('e', query_id) AS query_id, doc_id FROM pairs WHERE containment >= 0.85
UNION ALL SELECT concat('s', s.source), d.doc_id FROM (SELECT DISTINCT source FROM documents) s JOIN d ON contains(lower(d.source), lower(s.source))""")
def relevant_documents(spark, d):
    """Questions with evidence are the passages; those without ask for each source in capitals, which others may contain (src1 in src10)."""
    passages = table(spark, d, "benchmark").select(F.concat(F.lit("e"), "item_id").alias("query_id"), F.col("text").alias("evidence"), F.lit("").alias("source_contains"))
    sources = table(spark, d, "documents").select("source").distinct().select(F.concat(F.lit("s"), "source").alias("query_id"), F.lit(" ").alias("evidence"), F.upper("source").alias("source_contains"))
    return R.relevant_documents(index(spark, d), passages.unionByName(sources))


_SET = """SELECT concat('b', item_id) AS id, true AS answerable, text AS evidence, text AS answer FROM benchmark UNION ALL
SELECT concat('c', conv_id, ':', role), role = 'assistant', CASE WHEN role <> 'system' AND turn <> 2 THEN text ELSE ' ' END, CASE WHEN turn <> 1 THEN text ELSE '' END FROM conversations"""


@query("dataset_checks", f"""WITH s AS MATERIALIZED ({_SET}), c AS (SELECT regexp_replace(text, '\\s+', '', 'g') AS bare FROM documents),
n AS (SELECT DISTINCT regexp_replace(evidence, '\\s+', '', 'g') AS needle FROM s WHERE answerable AND trim(evidence) <> ''),
h AS (SELECT needle, bool_or(contains(bare, needle)) AS held FROM n, c GROUP BY 1),
v AS (SELECT id, 'no evidence' AS violation FROM s WHERE answerable AND trim(evidence) = '' UNION ALL SELECT id, 'no reference answer' FROM s WHERE answerable AND trim(answer) = ''
  UNION ALL SELECT id, 'evidence though unanswerable' FROM s WHERE NOT answerable AND trim(evidence) <> ''
  UNION ALL SELECT id, 'evidence not in corpus' FROM s JOIN h ON h.needle = regexp_replace(evidence, '\\s+', '', 'g') WHERE answerable AND NOT held)
SELECT id, violation, count(*) AS n FROM v GROUP BY 1, 2 UNION ALL SELECT id, 'duplicate id', count(*) FROM s GROUP BY 1 HAVING count(*) > 1""")
def dataset_checks(spark, d):
    turns = table(spark, d, "conversations")
    asked = turns.select(
        F.concat(F.lit("c"), "conv_id", F.lit(":"), "role").alias("id"), (F.col("role") == "assistant").alias("answerable"), F.when((F.col("role") != "system") & (F.col("turn") != 2), F.col("text")).otherwise(" ").alias("evidence"),
        F.when(F.col("turn") != 1, F.col("text")).otherwise("").alias("reference_answer"),
    )
    passages = table(spark, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), F.lit(True).alias("answerable"), F.col("text").alias("evidence"), F.col("text").alias("reference_answer"))
    return R.dataset_violations(passages.unionByName(asked), table(spark, d, "documents"))


@query("decontaminate", f"WITH {_BASE}, {_PAIRS} SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM pairs WHERE containment >= 0.80)")
def decontaminate(spark, d):
    bad = _pairs(spark, d).groupBy("doc_id").agg(F.max("containment").alias("worst")).where("worst >= 0.80")
    return index(spark, d).documents.select("doc_id").join(bad, "doc_id", "left_anti")


@query("contamination_report", f"WITH {_BASE}, {_PAIRS}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY containment DESC, query_id) AS nth FROM pairs WHERE containment >= 0.85) SELECT doc_id, query_id, round(containment, 6) AS containment FROM b WHERE nth = 1 ORDER BY 3 DESC, 1 LIMIT 5")
def contamination_report(spark, d):
    bad = _pairs(spark, d).where("containment >= 0.85").withColumn("containment", R.rounded(F.col("containment")))
    worst = bad.groupBy("doc_id").agg(F.max(F.struct("containment", (-F.col("query_id")).alias("q"))).alias("w"))
    return worst.select("doc_id", (-F.col("w.q")).alias("query_id"), F.col("w.containment").alias("containment")).orderBy(F.desc("containment"), "doc_id").limit(5)


@query("distinct_evidence", "SELECT min(item_id) AS item_id, text FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000, text FROM benchmark WHERE item_id % 2 = 0) WHERE trim(text) <> '' GROUP BY text")
def distinct_evidence(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", "text")
    both = rows.unionByName(rows.where("item_id % 2 = 0").withColumn("item_id", F.col("item_id") + 1000))
    return both.where(T.strip(F.col("text")) != "").groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text")


@query("dataset_union_validate", "SELECT side, count(*) AS n, count(DISTINCT item_id) AS n_ids, count_if(trim(text) = '')::BIGINT AS n_blank FROM (SELECT 'base' AS side, item_id, text FROM benchmark UNION ALL SELECT 'extra', item_id + 1000, text FROM benchmark) GROUP BY 1")
def dataset_union_validate(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", "text")
    both = rows.withColumn("side", F.lit("base")).unionByName(rows.withColumn("item_id", F.col("item_id") + 1000).withColumn("side", F.lit("extra")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("n_ids"), F.count_if(T.strip(F.col("text")) == "").alias("n_blank"))


@query("dataset_violations", f"""WITH {_BASE}, k AS (SELECT item_id % 30 AS id, item_id FROM benchmark), dup AS (SELECT id, 'duplicate id' AS violation, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1)
SELECT id, violation, n FROM dup UNION ALL SELECT query_id, 'evidence not in corpus', 1 FROM ans WHERE NOT answerable""")
def dataset_violations(spark, d):
    rows = table(spark, d, "benchmark").select((F.col("item_id") % 30).alias("id"))
    dup = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("violation"), "n")
    missing = answerable(spark, d).where(~F.col("answerable")).select(F.col("query_id").alias("id"), F.lit("evidence not in corpus").alias("violation"), F.lit(1).cast("long").alias("n"))
    return dup.unionByName(missing)


@query("first_relevant_rank", f"WITH {_BASE}, {_REL.format(ranked='ranked')} SELECT query_id, answerable, first_rank FROM fr")
def first_relevant_rank(spark, d):
    return ranks_of(spark, d, index(spark, d).search(batch(spark, d), 5))


@query("hit_mrr", f"WITH {_BASE}, {_REL.format(ranked='ranked')} SELECT {_HIT} FROM fr")
def hit_mrr(spark, d):
    return R.hit_mrr(first_relevant_rank(spark, d))


@query("random_baseline", "SELECT k, round(least(k / n, 1.0), 4) AS hit FROM (SELECT count(*) AS n FROM documents), (VALUES (1), (3), (5)) t(k)")
def random_baseline(spark, d):
    n = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("k")).select("k", F.round(F.least(F.col("k") / F.col("n"), F.lit(1.0)), 4).alias("hit"))


def _strategy_sql(name: str, ranked: str, tag: str) -> str:
    return _REL.format(ranked=ranked).replace("hits AS", f"hits_{tag} AS").replace("FROM hits", f"FROM hits_{tag}").replace("fr AS", f"fr_{tag} AS") + f", s_{tag} AS (SELECT '{name}' AS strategy, * FROM fr_{tag})"


@query("strategy_ab", f"WITH {_SHORT}, {_TFIDF}, {_HYBRID}, {_strategy_sql('bm25', 'ranked', 'a')}, {_strategy_sql('dense', 'dense', 'b')}, {_strategy_sql('hybrid', 'hy', 'c')} SELECT strategy, {_HIT} FROM (SELECT * FROM s_a UNION ALL SELECT * FROM s_b UNION ALL SELECT * FROM s_c) GROUP BY 1")
def strategy_ab(spark, d):
    sparse, dense = _pools(spark, d, short=True)
    lists = {"bm25": sparse, "dense": dense, "hybrid": R.hybrid(sparse, dense, 5)}
    rows = None
    for name, hits in lists.items():
        one = ranks_of(spark, d, hits.select("query_id", "doc_id", "rank")).withColumn("strategy", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return R.hit_mrr(rows, "strategy")


#: Weights of the sparse and the dense side.
SWEEP = ((1.0, 1.0), (1.5, 1.0), (2.0, 1.0), (3.0, 1.0), (1.0, 1.5), (1.0, 2.0), (1.0, 0.5), (1.0, 0.0))
_SWEEP = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(SWEEP))


@query("weight_sweep", f"""WITH {_SHORT}, {_TFIDF}, {_LISTS}, sw AS (SELECT * FROM (VALUES {_SWEEP}) t(cfg, wa, wb)),
f AS (SELECT cfg, query_id, doc_id, round(sum(CASE WHEN list_id = 'bm25' THEN wa ELSE wb END / (60 + rank)), 6) AS score FROM lists, sw WHERE CASE WHEN list_id = 'bm25' THEN wa ELSE wb END > 0 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY cfg, query_id ORDER BY score DESC, doc_id) AS rank FROM f),
h AS (SELECT cfg, query_id, min(rank) AS first_rank FROM r JOIN d USING (doc_id) JOIN ev USING (query_id) WHERE rank <= 5 AND len(list_intersect(list_distinct(etok), tokens)) / len(list_distinct(etok)) >= 0.85 GROUP BY 1, 2),
fr AS (SELECT cfg, query_id, answerable, CASE WHEN answerable THEN first_rank END AS first_rank FROM sw CROSS JOIN ans LEFT JOIN h USING (cfg, query_id)) SELECT cfg, {_HIT} FROM fr GROUP BY 1""")
def weight_sweep(spark, d):
    sweep = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(SWEEP)], "cfg int, wa double, wb double")
    rows = _lists(spark, d, short=True).crossJoin(F.broadcast(sweep)).withColumn("w", F.when(F.col("list_id") == "bm25", F.col("wa")).otherwise(F.col("wb"))).where("w > 0")
    fused = rows.groupBy("cfg", "query_id", "doc_id").agg(R.rounded(F.sum(F.col("w") / (60 + F.col("rank")))).alias("score"))
    hits = R.top(fused, 5, keys=("cfg", "query_id"))
    idx, ev = index(spark, d), evidence(spark, d)
    rel = tokens_of(idx, hits).join(ev, "query_id").where(T.token_containment(F.col("tokens"), F.col("etok")) >= 0.85)
    first = rel.groupBy("cfg", "query_id").agg(F.min("rank").alias("first_rank"))
    grid = answerable(spark, d).crossJoin(F.broadcast(sweep.select("cfg"))).join(first, ["cfg", "query_id"], "left")
    return R.hit_mrr(grid.withColumn("first_rank", F.when(F.col("answerable"), F.col("first_rank"))), "cfg")


_DELTA = "CASE WHEN b IS NULL AND a IS NULL THEN 'same' WHEN b IS NULL THEN 'improved' WHEN a IS NULL THEN 'regressed' WHEN a < b THEN 'improved' WHEN a > b THEN 'regressed' ELSE 'same' END AS change"


@query("rank_delta", f"WITH {_SHORT}, {_TFIDF}, {_strategy_sql('bm25', 'ranked', 'a')}, {_strategy_sql('dense', 'dense', 'b')}, j AS (SELECT query_id, fr_a.first_rank AS a, fr_b.first_rank AS b FROM fr_a JOIN fr_b USING (query_id)) SELECT query_id, a AS new_rank, b AS old_rank, {_DELTA} FROM j")
def rank_delta(spark, d):
    sparse, dense = _pools(spark, d, short=True)
    a = ranks_of(spark, d, sparse).select("query_id", F.col("first_rank").alias("a"))
    b = ranks_of(spark, d, dense).select("query_id", F.col("first_rank").alias("b"))
    return a.join(b, "query_id").select("query_id", F.col("a").alias("new_rank"), F.col("b").alias("old_rank"), F.expr(_DELTA.removesuffix(" AS change")).alias("change"))


_RW = ((0, 0.3), (1, 0.5), (2, 0.8))


@query("rewrite_ab", f"""WITH {_SHORT}, {_PRF}, ws AS (SELECT * FROM (VALUES (0, 0.3::DOUBLE), (1, 0.5::DOUBLE), (2, 0.8::DOUBLE)) t(cfg, weight)),
ex AS (SELECT cfg, query_id, unnest({_TOK.format('term')}) AS term, ws.weight AS qtf FROM prf, ws),
qt2 AS (SELECT cfg, query_id, term, sum(qtf) AS qtf FROM (SELECT cfg, query_id, term, qtf FROM qt, ws UNION ALL SELECT cfg, query_id, term, qtf FROM ex) GROUP BY 1, 2, 3),
bm2 AS (SELECT cfg, query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN qt2 USING (term) JOIN idf USING (term), st GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY cfg, query_id ORDER BY score DESC, doc_id) AS rank FROM bm2 WHERE score > 0),
h AS (SELECT cfg, query_id, min(rank) AS first_rank FROM r JOIN d USING (doc_id) JOIN ev USING (query_id) WHERE rank <= 20 AND len(list_intersect(list_distinct(etok), tokens)) / len(list_distinct(etok)) >= 0.85 GROUP BY 1, 2),
fr AS (SELECT cfg, query_id, answerable, CASE WHEN answerable THEN first_rank END AS first_rank FROM ws CROSS JOIN ans LEFT JOIN h USING (cfg, query_id)) SELECT cfg, {_HIT} FROM fr GROUP BY 1""")
def rewrite_ab(spark, d):
    idx, b, ev = index(spark, d), batch(spark, d, short=True), evidence(spark, d)
    terms = R.feedback_terms(idx, b).select("query_id", "term")
    # one batch for all weights: the query of a weight has a key of its own
    key = lambda c: F.concat_ws("|", F.lit(str(c)), F.col("query_id").cast("string")).alias("query_id")
    parts = [R.expanded(b, terms, w).select(key(c), "term", "qtf") for c, w in _RW]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    hits = idx.search(both, 20).select(F.split("query_id", "[|]")[0].cast("int").alias("cfg"), F.split("query_id", "[|]")[1].cast("long").alias("query_id"), "doc_id", "rank")
    rel = tokens_of(idx, hits).join(ev, "query_id").where(T.token_containment(F.col("tokens"), F.col("etok")) >= 0.85)
    first = rel.groupBy("cfg", "query_id").agg(F.min("rank").alias("first_rank"))
    grid = answerable(spark, d).crossJoin(F.broadcast(spark.createDataFrame([(c,) for c, _ in _RW], "cfg int"))).join(first, ["cfg", "query_id"], "left")
    return R.hit_mrr(grid.withColumn("first_rank", F.when(F.col("answerable"), F.col("first_rank"))), "cfg")


@query("build_context", f"WITH {_BASE} SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM ranked JOIN d USING (doc_id) WHERE rank <= 4 GROUP BY 1")
def build_context(spark, d):
    idx = index(spark, d)
    rows = R.with_documents(idx, idx.search(batch(spark, d), 4), "text")
    parts = F.array_sort(F.collect_list(F.struct("rank", F.col("text").alias("t"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("context"))


#: The last turns of a session that a question is asked after.
HISTORY = 10
_QA = "SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"


@query("prompt_messages", f"""WITH {_BASE}, ctx AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM ranked JOIN d USING (doc_id) WHERE rank <= 4 AND query_id % 5 <> 0 GROUP BY 1),
qa AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM ({_QA})),
hist AS (SELECT conv_id AS query_id, count(*) AS n, string_agg(concat('user: ', question, chr(10), 'assistant: ', answer, chr(10)), '' ORDER BY turn) AS said FROM qa WHERE back <= {HISTORY} GROUP BY 1)
SELECT b.item_id AS query_id, 2 + 2 * coalesce(n, 0) AS n_messages, concat('system: ', CASE WHEN item_id % 3 = 1 THEN 'Talk.' ELSE 'Answer by the sources.' END, chr(10), said, 'user: ', CASE WHEN item_id % 3 = 1 THEN b.text ELSE concat('【参考资料】', chr(10), coalesce(context, '（未检索到知识库相关内容）'), chr(10), chr(10), '【用户问题】', chr(10), b.text) END) AS prompt
FROM benchmark b LEFT JOIN ctx ON ctx.query_id = b.item_id LEFT JOIN hist ON hist.query_id = b.item_id""")
def prompt_messages(spark, d):
    """Each passage asked after the session of its number, with the texts found for it; every fifth finds nothing, every third is a chat."""
    idx = index(spark, d)
    rows = R.with_documents(idx, idx.search(batch(spark, d), 4).where("query_id % 5 <> 0"), "text")
    parts = F.array_sort(F.collect_list(F.struct("rank", F.col("text").alias("t"))))
    found = rows.groupBy("query_id").agg(F.transform(parts, lambda p: p["t"]).alias("sources"))
    pairs = E.recent(E.question_answers(table(spark, d, "conversations")), HISTORY).groupBy(F.col("conv_id").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("history"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.when(F.col("item_id") % 3 == 1, "chat").otherwise("rag").alias("mode"))
    all_ = asked.join(found, "query_id", "left").join(pairs, "query_id", "left")
    made = all_.select("query_id", messages(F.col("question"), F.col("history"), F.col("sources"), F.col("mode"), "Answer by the sources.", "Talk.").alias("m"))
    return made.select("query_id", F.size("m").alias("n_messages"), F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("prompt"))


def _like_in_length(pairs: list[tuple[str, str]]) -> list[float]:
    """In place of a model: texts of about the query's length are best. For queries of odd length it leaves a score out, which is a fault."""
    scores = [-float(abs(len(t) - len(q))) for q, t in pairs]
    return scores[: len(scores) - len(pairs[0][0]) % 2]


@query("model_rerank", f"""WITH {_BASE}, p AS (SELECT r.query_id, doc_id, rank, score, -abs(len(text) - len(evidence))::DOUBLE AS s, len(evidence) % 2 = 0 AND count(*) OVER (PARTITION BY r.query_id) > 1 AS ok FROM ranked r JOIN d USING (doc_id) JOIN ev USING (query_id) WHERE rank <= 20),
o AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) ELSE rank END AS place FROM p)
SELECT query_id, doc_id, place AS rank, CASE WHEN ok THEN s ELSE score END AS score, ok AS reranked FROM o WHERE place <= 4""")
def model_rerank(spark, d):
    idx = index(spark, d)
    pool = R.with_documents(idx, idx.search(batch(spark, d), 20), "text").join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return R.model_rerank(pool, _like_in_length).where("rank <= 4").select("query_id", "doc_id", "rank", "score", "reranked")
