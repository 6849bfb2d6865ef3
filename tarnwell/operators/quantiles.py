"""Exact quantiles of groups of any size: selection by refining histograms of order-preserving keys.

A double becomes a long of the same order.  Each round counts the rows of a group by the next BITS bits of the key, for the bins that
hold a wanted rank only, with the least and the greatest key of each bin; where they are equal, the value is found.  After that only rows of the bins in question are
kept, so rounds get cheaper, and there are at most 64 / BITS of them.  Counts are combined before the shuffle: no group is
sorted, none is gathered as a list, and a group with a third of all rows is as cheap as any other.

Quantiles interpolate linearly between the two neighbouring ranks, like ``percentile``.  Defined results: null values don't count, and a group of
them alone has n = 0 and null quantiles; NaN is above all numbers, -0.0 is 0.0; null keys form a group; repeated rows count as often as they
stand; an empty table has no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.sources.shared import stash

BITS = 12
#: Wanted ranks up to which they are broadcast, which is counted.
FEW = 500_000
_MAX = (1 << 63) - 1


def ordered(value: Column) -> Column:
    """A long for each double, in the same order."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + 0.0).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_MAX))).otherwise(bits)


def restored(key: Column) -> Column:
    """The double of such a long."""
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(_MAX))).otherwise(key)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def selected(rows: DataFrame, targets: DataFrame, bits: int = BITS) -> DataFrame:
    """g, rank, key: the row of each rank (from 0) in its group. rows: g, key; targets: g, rank."""
    active = targets.select("g", "rank", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("below"))
    found, before = None, 64
    while before > 0:
        shift = max(0, before - bits)
        bins = rows.groupBy("g", F.shiftright("key", shift).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
        above = F.lit(0).cast("long") if before == 64 else F.shiftright("bin", before - shift)
        summed = bins.withColumn("above", above).withColumn("to", F.sum("n").over(Window.partitionBy("g", "above").orderBy("bin")))
        asked = active.select("g", F.col("bin").alias("above"), "rank", "below")
        at = F.col("rank") - F.col("below")
        hit = summed.join(asked, ["g", "above"]).where((at >= F.col("to") - F.col("n")) & (at < F.col("to")))
        hit = stash(hit.select("g", "rank", "bin", (F.col("below") + F.col("to") - F.col("n")).alias("below"), "least", (F.col("least") == F.col("most")).alias("known")), "ranks")
        done = hit.where("known").select("g", "rank", F.col("least").alias("key"))
        found = done if found is None else found.unionByName(done)
        active, before = hit.where("not known").drop("least", "known"), shift
        if not active.limit(1).count():
            break
        wanted = active.select("g", F.col("bin").alias("own")).distinct()
        rows = rows.withColumn("own", F.shiftright("key", shift)).join(_small(wanted), ["g", "own"], "left_semi").drop("own")
        rows = stash(rows, "survivors")
    return found


def quantiles(rows: DataFrame, keys: list[str], value: str, qs: list[float], bits: int = BITS) -> DataFrame:
    """keys, n, q (an array, one entry for each of qs)."""
    slim = stash(rows.select(F.struct(*keys).alias("g"), F.when(F.col(value).isNotNull(), ordered(F.col(value))).alias("key")), "keys")
    sizes = stash(slim.groupBy("g").agg(F.count("key").alias("n")), "sizes")
    place = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("n") - 1)).alias("pos")) for i, q in enumerate(qs))))
    wanted = sizes.where("n > 0").select("g", place.alias("p")).select("g", "p.i", "p.pos", F.floor("p.pos").alias("lo"), F.ceil("p.pos").alias("hi"))
    ranks = wanted.select("g", F.explode(F.array("lo", "hi")).alias("rank")).distinct()
    values = selected(slim.where("key is not null"), ranks, bits).select("g", "rank", restored(F.col("key")).alias("v"))
    low = wanted.join(values.select("g", F.col("rank").alias("lo"), F.col("v").alias("a")), ["g", "lo"])
    both = low.join(values.select("g", F.col("rank").alias("hi"), F.col("v").alias("b")), ["g", "hi"])
    one = F.when(F.col("lo") == F.col("hi"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.col("lo")))
    row = both.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", one.alias("v")))).alias("x"))
    out = sizes.join(row, "g", "left").select("g.*", "n", F.transform("x", lambda x: x["v"]).alias("q"))
    return out.select(*keys, "n", F.coalesce("q", F.array_repeat(F.lit(None).cast("double"), len(qs))).alias("q"))


def summary(rows: DataFrame, keys: list[str], value: str, digits: int = 2) -> DataFrame:
    """keys, count, mean, p50, p95, p99, min, max; all but the count are null for an empty sample."""
    r = lambda c: F.round(c, digits)
    v = F.col(value)
    rest = rows.groupBy(F.struct(*keys).alias("g")).agg(r(F.avg(v)).alias("mean"), r(F.min(v)).alias("min"), r(F.max(v)).alias("max"))
    q = quantiles(rows, keys, value, [0.5, 0.95, 0.99]).withColumn("g", F.struct(*keys))
    return q.join(rest, "g").select(*keys, F.col("n").alias("count"), "mean", *(r(F.col("q")[i]).alias(c) for i, c in enumerate(("p50", "p95", "p99"))), "min", "max")
