"""Sessions, request logs and streams of events, in batch form; statistics of their results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.operators.quantiles import quantiles


def seconds(ts: str = "ts") -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def rate_limit(rows: DataFrame, limit: int, window: int = 60, key: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """The rows with bucket, nth, allowed, remaining and retry_after: fixed windows of the clock."""
    bucket = F.floor(seconds(ts) / window)
    nth = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(ts, id_col))
    out = rows.withColumn("bucket", bucket).withColumn("nth", nth).withColumn("allowed", F.col("nth") <= limit)
    wait = (F.col("bucket") + 1) * window - seconds(ts)
    return out.withColumn("remaining", F.greatest(limit - F.col("nth"), F.lit(0))).withColumn("retry_after", F.when(F.col("allowed"), 0).otherwise(F.greatest(wait, F.lit(1))))


def cache_fold(rows: DataFrame, ttl: int, key: str = "key", at: str = "at", id_col: str = "event_id", found: str = "n_found") -> DataFrame:
    """event_id, outcome (hit, miss): a written entry lives ttl seconds and isn't refreshed by hits; empty results aren't kept.

    A stream of each key's requests in order, as the state is one time of writing: no request waits in memory, so a key may have
    any number of them.
    """
    kind = rows.schema[key].dataType.simpleString()
    ordered = rows.select(F.col(key).alias("key"), F.col(at).cast("long").alias("at"), F.col(id_col).cast("long").alias("event_id"), (F.col(found) > 0).alias("some"))
    ordered = ordered.repartition("key").sortWithinPartitions("key", "at", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, written, begun = None, None, False
        for batch in batches:
            outcomes = []
            for k, t, some in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "some"))):
                if not begun or k != now:
                    now, written, begun = k, None, True
                hit = written is not None and t is not None and t - written < ttl
                if not hit:
                    written = t if some else None
                outcomes.append("hit" if hit else "miss")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(outcomes, pa.string())], names=[key, "event_id", "outcome"])

    return ordered.mapInArrow(run, f"`{key}` {kind}, event_id long, outcome string")


def summarize(values: Column, digits: int = 2) -> list[Column]:
    """Columns of a latency summary; all but the count are null for an empty sample."""
    q = F.percentile(values, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    r = lambda c: F.round(c, digits)
    return [F.count(values).alias("count"), r(F.avg(values)).alias("mean"), r(q[0]).alias("p50"), r(q[1]).alias("p95"), r(q[2]).alias("p99"), r(F.min(values)).alias("min"), r(F.max(values)).alias("max")]


def load_summary(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, requests, success, errors, error_rate, duration_s, rps, done_rate, p50, p95, p99, error_types of a load test's requests.

    rows: keys, ts, value (a latency), kind (type of error, null for success), done (the end was seen).  error_types is ``kind=count``, by kind, null without errors;
    the rate is null where all requests have one time; a group has as many kinds of error as there are, few.
    """
    n, failed = F.count(F.lit(1)), F.count_if(F.col("kind").isNotNull())
    micros = F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    seconds_ = F.nullif(micros, F.lit(0)) / 1e6
    main = rows.groupBy(*keys).agg(
        n.alias("requests"), (n - failed).alias("success"), failed.alias("errors"), F.round(failed / n, 4).alias("error_rate"), F.round(micros / 1e6, 3).alias("duration_s"), F.round(n / seconds_, 6).alias("rps"),
        F.round(F.count_if("done") / n, 4).alias("done_rate"),
    )
    kinds = rows.where("kind is not null").groupBy(*keys, "kind").agg(F.concat_ws("=", "kind", F.count(F.lit(1)).cast("string")).alias("told"))
    types = kinds.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "told"))), lambda x: x["told"]), ",").alias("error_types"))
    q = quantiles(rows, keys, value, [0.5, 0.95, 0.99]).select(*keys, *(F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("p50", "p95", "p99"))))
    return main.join(q, keys).join(types, keys, "left")


def recent(turns: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n turns of each session."""
    return turns.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("back") <= n).drop("back")


def question_answers(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: a user's turn and the assistant's next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return rows.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("question"), "answer")


def backoff(attempt: Column, base: float = 0.5, most: float = 8.0) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


#: Events that may follow each event of a stream.
FOLLOWS = {
    None: ("meta",), "meta": ("sources", "trace", "delta", "done", "error"), "sources": ("trace", "delta", "done", "error"), "trace": ("delta", "done", "error"),
    "delta": ("delta", "done", "error"), "done": (), "error": (),
}


def legal(previous: Column, event: Column) -> Column:
    out = F.when(previous.isNull(), event.isin(*FOLLOWS[None]))
    for k, v in FOLLOWS.items():
        if k is not None:
            out = out.when(previous == k, event.isin(*v) if v else F.lit(False))
    return out.otherwise(False)


def heartbeats(rows: DataFrame, every: int, key: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """key, event_id, n_beats: heartbeats that fill the silence before each event."""
    gap = seconds(ts) - F.lag(seconds(ts)).over(Window.partitionBy(key).orderBy(ts, id_col))
    return rows.select(key, id_col, F.floor(F.coalesce(gap, F.lit(0)) / every).alias("n_beats")).where("n_beats > 0")


def bootstrap(diffs: DataFrame, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """point, lo, hi, p of a paired bootstrap. diffs: id, diff (one row a question, a small table).

    The draw of place i in a round is a hash of (round, i, seed), so results repeat. Rounds are spread over tasks.
    """
    n = Window.partitionBy()
    numbered = diffs.select("diff", (F.row_number().over(n.orderBy("id")) - 1).alias("i"), F.count(F.lit(1)).over(n).alias("n"))
    draws = diffs.sparkSession.range(rounds).select(F.col("id").alias("round")).join(F.broadcast(numbered.select(F.col("i").alias("place"), "n")))
    drawn = draws.withColumn("i", F.pmod(F.xxhash64("round", "place", F.lit(seed)), F.col("n")).cast("int"))
    means = drawn.join(F.broadcast(numbered.select("i", "diff")), "i").groupBy("round").agg(F.avg("diff").alias("m"))
    ordered = F.array_sort(F.collect_list("m"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    stats = means.agg(ordered.alias("ms"), share(F.col("m") > 0).alias("pos"), share(F.col("m") < 0).alias("neg"))
    point = diffs.agg(F.avg("diff").alias("point"))
    pick = lambda q: F.element_at("ms", int(q * rounds) + 1)
    return stats.crossJoin(point).select(F.round("point", 6).alias("point"), F.round(pick(0.025), 6).alias("lo"), F.round(pick(0.975), 6).alias("hi"), F.least(2 * F.least("pos", "neg"), F.lit(1.0)).alias("p"))


def sign_test(diffs: DataFrame) -> DataFrame:
    """up, down, p: exact two-sided binomial test of the signs. diffs: diff."""
    counts = diffs.agg(F.count_if(F.col("diff") > 0).alias("up"), F.count_if(F.col("diff") < 0).alias("down"))
    n, least = F.col("up") + F.col("down"), F.least("up", "down")
    # in logarithms, as 0.5^n is no double beyond about 1,000 signs
    start = F.struct((n * F.log(F.lit(0.5))).alias("log"), F.pow(F.lit(0.5), n).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1) / i)
        return F.struct(log.alias("log"), (acc["total"] + F.exp(log)).alias("total"))

    steps = F.when(least >= 1, F.sequence(F.lit(1).cast("long"), least)).otherwise(F.array().cast("array<long>"))
    p = F.when(n == 0, 1.0).otherwise(F.least(2 * F.aggregate(steps, start, step, lambda acc: acc["total"]), F.lit(1.0)))
    return counts.select("up", "down", F.round(p, 6).alias("p"))
