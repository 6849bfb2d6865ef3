"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Documents fall into cells of source, language and topic.  The tokens of the cells are raked: each margin in turn is
scaled to its targets, SWEEPS times.  A document's weight is the raked over the found tokens of its cell; its probability is
its weight over the largest weight, so that sampled tokens have the target margins; it is sampled if a hash of its id,
as a number below 1, is less.

Every category of a margin is raked.  Up to CELLS cells are raked on one small partition without a shuffle; beyond, the
sums of a margin are grouped by key and joined back to the cells, with the same result.  No row is left out of a sum.

Targets of a margin are given as shares by category, or as an exponent: each category's tokens to that power (1 leaves
the margin as it is, 0 makes all equal).  A category without a target keeps its found share.  Shares are scaled to sum
to one.

Defined results: null source, language and topic are categories of their own; null and empty texts have no tokens, and a cell
without tokens has weight 1; a null id is hashed as an empty string; repeated rows are decided alike; an empty table
gives an empty table; other columns are kept by ``mix`` as they are, but for those of the names that it adds, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Cells that are raked on one partition, and categories of a margin that are broadcast.
CELLS, CATEGORIES = 10_000, 100_000
SWEEPS = 12
WORD = r"[^\x20\x09-\x0D]+"
#: Exponents of the targets: sources are evened out, languages less so, topics stay.
TARGETS: dict[str, float | dict[str, float]] = {"mix_source": 0.5, "mix_lang": 0.7, "mix_topic": 1.0}


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """A topic for tables that have none: the form of the text."""
    bars = F.coalesce(F.regexp_count(text, F.lit(r"\|")), F.lit(0))
    return F.when((bars > 0) & (bars * 5 >= tokens), "table").when(tokens < 100, "short").when(tokens < 400, "medium").otherwise("long")


def uniform(id_: Column, seed: str) -> Column:
    """A number from 0 to 1 that follows from the id: the first 13 hexadecimal digits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.lit(seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _share(k: str, rule: float | dict[str, float], here: Column, whole: Column) -> Column:
    """Target share of a category with ``here`` of ``whole`` tokens, before shares are scaled to sum to one."""
    if isinstance(rule, dict):
        given = F.create_map(*(F.lit(x) for pair in rule.items() for x in pair)) if rule else None
        return F.coalesce(given[F.col(k)], here / whole) if rule else here / whole
    return F.when(here > 0, F.pow(here, F.lit(float(rule)))).otherwise(0.0)


def rake(cells: DataFrame, targets: dict[str, float | dict[str, float]], sweeps: int = SWEEPS) -> DataFrame:
    """cells with ``raked``: their tokens, scaled in turn to the targets of each margin. cells: one partition."""
    total = F.sum("tokens").over(Window.partitionBy())
    rows = cells
    for k, rule in targets.items():
        here = F.sum("tokens").over(Window.partitionBy(k))
        rows = rows.withColumn("here", here.cast("double")).withColumn("all", total.cast("double"))
        share = _share(k, rule, F.col("here"), F.col("all"))
        first = F.row_number().over(Window.partitionBy(k).orderBy(*targets)) == 1
        rows = rows.withColumn("share", share).withColumn("once", F.when(first, F.col("share")).otherwise(0.0))
        rows = rows.withColumn(f"{k}_target", F.col("share") / F.sum("once").over(Window.partitionBy()) * F.col("all")).drop("here", "all", "share", "once")
    rows = rows.withColumn("raked", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        for k in targets:
            now = F.sum("raked").over(Window.partitionBy(k))
            rows = rows.withColumn("now", now).withColumn("raked", F.when(F.col("now") > 0, F.col("raked") * F.col(f"{k}_target") / F.col("now")).otherwise(0.0)).drop("now")
    return rows


def rake_joined(cells: DataFrame, targets: dict[str, float | dict[str, float]], sweeps: int = SWEEPS) -> DataFrame:
    """As rake, for any number of cells: sums by key that combine before the shuffle, joined back."""
    total = F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 0))
    goals = {}
    for k, rule in targets.items():
        found = cells.groupBy(k).agg(F.sum("tokens").cast("double").alias("here"))
        shares = stash(found.select(k, _share(k, rule, F.col("here"), total).alias("share")), "shares")
        n, whole = shares.agg(F.count(F.lit(1)), F.sum("share")).first()
        goals[k] = shares.select(k, (F.col("share") / F.lit(whole) * total).alias("target")), n <= CATEGORIES
    rows = cells.withColumn("raked", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        for k, (goal, few) in goals.items():
            sums = rows.groupBy(k).agg(F.sum("raked").alias("now")).join(goal, k)
            scaled = F.when(F.col("now") > 0, F.col("raked") * F.col("target") / F.col("now")).otherwise(0.0)
            rows = stash(rows.join(F.broadcast(sums) if few else sums, k).withColumn("raked", scaled).select(*cells.columns, "raked"), "raked")
    return rows


def mix(documents: DataFrame, targets: dict[str, float | dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, seed: str = "mix", sweeps: int = SWEEPS) -> DataFrame:
    """The documents with mix_source, mix_lang, mix_topic, mix_tokens, mix_weight, mix_probability and mix_sampled."""
    targets = TARGETS if targets is None else targets
    documents = documents.drop("mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_sampled")
    text, none = F.col(text_col), F.lit("")
    rows = documents.withColumn("mix_tokens", n_tokens(text))
    rows = (
        rows.withColumn("mix_source", F.coalesce(F.col(source_col).cast("string"), none)).withColumn("mix_lang", F.coalesce(F.col(lang_col).cast("string"), none))
        .withColumn("mix_topic", F.coalesce(topic if topic is not None else form_topic(text, F.col("mix_tokens")), none))
    )
    names = ["mix_source", "mix_lang", "mix_topic"]
    cells = stash(rows.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    few = cells.limit(CELLS + 1).count() <= CELLS
    raked = rake(cells.coalesce(1), targets, sweeps) if few else rake_joined(cells, targets, sweeps)
    weighed = raked.withColumn("mix_weight", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(1.0))
    weighed = weighed if few else stash(weighed, "weights")
    most = F.max("mix_weight").over(Window.partitionBy()) if few else F.lit(weighed.agg(F.max("mix_weight")).first()[0])
    factors = stash(weighed.select(*names, F.round("mix_weight", 9).alias("mix_weight"), F.round(F.col("mix_weight") / most, 9).alias("mix_probability")), "factors")
    joined = rows.join(F.broadcast(factors) if few else factors, names, "left")
    return joined.withColumn("mix_sampled", uniform(F.col(id_col), seed) < F.col("mix_probability")).select(*documents.columns, *names, "mix_tokens", "mix_weight", "mix_probability", "mix_sampled")
