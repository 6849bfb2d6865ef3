"""Corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, surrogates for personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents; the last returns the sampled documents with
their mixing figures.  Near duplicates and contamination are decided row by row, by id and text together, also where ids
are null or repeated.

Defined results of all stages: an empty table gives an empty table; texts are read whole, whatever their length; rows that
repeat are decided alike (near_duplicates keeps one of them); columns beside doc_id, text, lang, source and n_chars go through
unread under any name, but for the last stage, which returns columns of its own.  Nulls and empty texts: language_id drops
them, as they have no letter; the other stages keep them (near_duplicates and decontamination: a text without a word is like
no other; personal_data: unchanged; mixing: no tokens, weight 1).  A null id is like any other id.  Ties: each stage's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import decontaminate, jaccard, langid, mixing, pii
from tarnwell.llm.common import few, free_name, row_key, stash, table

#: A text of LEAST_LENGTH characters that no language parses this much better than the next isn't told apart; its label is
#: replaced where the best language is this much better.
LEAST_LENGTH, LEAST_SCORE, SURE_SCORE = 200, 0.05, 0.2
#: Near duplicates: words of a shingle, and the least similarity as a fraction.
WIDTH, NUM, DEN = 5, 80, 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; a missing lang is filled in, and one that the text surely contradicts is replaced.

    Texts without a letter go, and texts of LEAST_LENGTH characters or more that are in no known language: the best one parses them
    hardly better than the next (so ties go, but only of texts long enough to tell). Without any labelled document nothing is known, and all with a letter stay.
    """
    names = docs.columns
    places = {c: f"c{i}" for i, c in enumerate(names)}  # columns of any name, apart from those that predict adds
    rows = docs.toDF(*places.values())
    id_, text, lang = (places[c] for c in ("doc_id", "text", "lang"))
    samples = langid.learn(rows, F.lit(True), id_, text, lang)
    if not samples:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(rows, samples, id_, text, keep=tuple(c for c in rows.columns if c != id_))
    long = F.length(text) >= LEAST_LENGTH
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & ((F.col("score") >= LEAST_SCORE) | ~long))
    label = F.when(long & (F.col("score") >= SURE_SCORE), F.col("lang_pred")).otherwise(F.coalesce(lang, "lang_pred"))
    return kept.withColumn(lang, label).select(*(F.col(p).alias(c) for c, p in places.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the least id, if any has one (ties: the least key). Rows without a word all stay."""
    found = jaccard.join(docs, WIDTH, NUM, DEN).where("n_shingles > 0")
    rows = found.groupBy("label", "key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    least = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")).alias("least"))
    kept = stash(least.select(F.col("least.key").alias("key"), F.col("least.n").alias("n")), "kept")
    key = free_name(docs, "row_key")
    # what goes is less than what stays: texts needn't move where its keys are few
    repeated = kept.where("n > 1").select(F.col("key").alias(key))
    gone = stash(rows.select("key").distinct().join(kept.where("n = 1"), "key", "left_anti").select(F.col("key").alias(key)), "gone")
    keyed = docs.withColumn(key, row_key())
    single = keyed.join(few(gone), key, "left_anti").select(*docs.columns)
    if not repeated.limit(1).count():
        return single
    row = F.struct(*docs.columns)
    # maps and variants have no order of their own
    least = F.min_by(row, F.to_json(row)) if any(x in docs.schema.simpleString() for x in ("map<", "variant")) else F.min(row)
    one = keyed.join(few(repeated), key).groupBy(key).agg(least.alias("row")).select("row.*")
    return single.unionByName(one).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no benchmark passage covers to a twentieth or more (a twentieth goes)."""
    index = decontaminate.Index(docs, table(spark, sf_dir, "benchmark"))
    key = free_name(docs, "row_key")
    bad = stash(index.rated().where("contaminated").select(F.col("key").alias(key)).distinct(), "bad")
    return docs.withColumn(key, row_key()).join(few(bad), key, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the text."""
    found = pii.replace(docs, found_col=free_name(docs, "pii_found"))
    return found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights, with their figures. Equal ids are sampled alike."""
    found = mixing.mix(docs.select("doc_id", "text", "lang", "source", "n_chars")).where("mix_sampled")
    return found.select("doc_id", "text", "lang", "source", "n_chars", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixture),
]

#: SQL can't express cross-parsing by suffix automata or keyed surrogates in reasonable length; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
