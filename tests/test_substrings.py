"""The substring join against ``in``, over shards, long needles and odd rows."""

import random

import pytest

from tarnwell.operators.substrings import ANCHOR, automaton, found_in, substring_join


def pairs(spark, texts, needles, **how):
    t = spark.createDataFrame(texts, "text_id long, text string").repartition(3)
    n = spark.createDataFrame(needles, "needle_id long, needle string")
    return sorted(((r.text_id is None, r.text_id or 0, r.needle_id) for r in substring_join(t, n, **how).collect()))


@pytest.mark.parametrize("shard", [2_000_000, 40])
def test_brute_force(spark, shard):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 120))) for i in range(60)]
    needles = [(i, word(rng.randrange(1, 5))) for i in range(40)] + [(100 + i, t[5:5 + ANCHOR + 10 * i]) for i, (_, t) in enumerate(texts[:6])] + [(200, "a"), (201, "a")]
    expected = sorted((False, i, j) for i, t in texts for j, n in needles if n and n in t)
    assert pairs(spark, texts, needles, shard_chars=shard) == expected and len(expected) > 200


def test_odd_rows(spark):
    texts = [(1, "xyz"), (1, "xyz"), (None, "y"), (2, None), (3, ""), (4, "long " * 100_000 + "end")]
    needles = [(1, "y"), (2, ""), (3, None), (4, "end"), (5, "long " * 1000), (6, "long " * 200_000)]
    assert pairs(spark, texts, needles) == [(False, 1, 1), (False, 1, 1), (False, 4, 4), (False, 4, 5), (True, 0, 1)]
    assert pairs(spark, texts, []) == pairs(spark, [], needles) == []


def test_a_long_needle_is_compared_whole():
    needles = ["a" * ANCHOR + "b", "a" * ANCHOR, "a" * ANCHOR + "c"]
    assert found_in("a" * 200 + "b", automaton(needles), needles) == {0, 1}
