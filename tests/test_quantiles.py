"""Exact quantiles against numpy, with ties, extremes and odd rows."""

import math
import random

import numpy as np
import pytest

from tarnwell.operators import quantiles as Q


@pytest.mark.parametrize("bits", [12, 3, 40])
def test_equals_numpy(spark, bits):
    rng = random.Random(6)
    groups = {
        "ties": [1.0] * 40 + [2.0] * 41, "one": [7.5], "two": [1.0, 2.0], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(60)], "near": [1 + i * 2.0**-52 for i in range(50)],
        "signs": [-0.0, 0.0, -1.5, 1.5, -2.5], None: [rng.gauss(0, 1) for _ in range(333)], "hundred": [float(i) for i in range(1, 101)],
    }
    rows = [(g, v, 1) for g, values in groups.items() for v in values] + [("ties", None, 1), ("none", None, 1), ("none", None, 1)]
    rng.shuffle(rows)
    qs = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {r.g: r for r in Q.quantiles(spark.createDataFrame(rows, "g string, v double, n int"), ["g"], "v", qs, bits).collect()}
    assert set(got) == {*groups, "none"} and got["none"].n == 0 and got["none"].q == [None] * 6
    for g, values in groups.items():
        assert got[g].n == len(values)
        assert got[g].q == pytest.approx(np.quantile(values, qs).tolist(), rel=1e-12, abs=0)
    assert [round(x, 2) for x in got["hundred"].q[2:5]] == [50.5, 95.05, 99.01]


def test_keys_keep_the_order(spark):
    values = [-math.inf, -1e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e308, math.inf, math.nan]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", "v", Q.ordered(Q.F.col("v")).alias("k")).withColumn("back", Q.restored(Q.F.col("k")))
    got = rows.orderBy("k").collect()
    assert [r.i for r in got] == list(range(len(values))) and all(r.back == r.v or r.v != r.v for r in got)
    assert Q.quantiles(spark.createDataFrame([(1, math.nan), (1, 2.0), (1, 3.0)], "g int, v double"), ["g"], "v", [0.5]).first().q == [3.0]


def test_summary_of_empty_samples(spark):
    rows = spark.createDataFrame([(1, 2, None), (1, 2, None), (3, None, 4.0)], "a int, b int, v double")
    got = {(r.a, r.b): r for r in Q.summary(rows, ["a", "b"], "v").collect()}
    assert got[(1, 2)].asDict() == {"a": 1, "b": 2, "count": 0, "mean": None, "p50": None, "p95": None, "p99": None, "min": None, "max": None}
    assert got[(3, None)].p99 == 4.0 and got[(3, None)]["count"] == 1
    assert Q.summary(rows.limit(0), ["a"], "v").count() == 0
