"""Substring join: which of many needles stand in which texts, by an Aho-Corasick automaton, in one pass over each text.

Distinct needles are dealt by hash into shards of at most about SHARD_CHARS characters of automaton, by their measured number; a shard is
sent to the tasks, each worker builds its automaton once, and every text goes through it once.  The automaton has each needle's
first ANCHOR characters; a hit of a longer needle is confirmed by comparing it whole at that place.  So the pairs are exact, and
no text meets a needle that doesn't begin in it.

Defined results: a null or empty needle is found nowhere, a null text has none; each pair of a row and a needle stands once, however often it is
found; repeated rows and needles have their pairs each; comparison is by characters, case and blanks included; no needles or no texts, no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.sources.shared import stash

#: Characters of a needle in the automaton; characters of a shard's automaton (some 60 bytes each).
ANCHOR, SHARD_CHARS = 48, 2_000_000

_built: dict[int, tuple] = {}


def automaton(needles: list[str]) -> ahocorasick.Automaton:
    """Anchors with the places of their needles."""
    by: dict[str, list[int]] = {}
    for i, needle in enumerate(needles):
        by.setdefault(needle[:ANCHOR], []).append(i)
    found = ahocorasick.Automaton()
    for anchor, own in by.items():
        found.add_word(anchor, (len(anchor), own))
    found.make_automaton()
    return found


def found_in(text: str, machine: ahocorasick.Automaton, needles: list[str]) -> set[int]:
    out: set[int] = set()
    for end, (size, own) in machine.iter(text):
        for i in own:
            if i not in out and (len(needles[i]) == size or text.startswith(needles[i], end - size + 1)):
                out.add(i)
    return out


def substring_join(texts: DataFrame, needles: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """text_id, needle_id of every needle in every text. texts: text_id, text; needles: needle_id, needle."""
    spark = texts.sparkSession
    wanted = needles.where(F.col("needle") != "").select("needle_id", "needle")
    distinct = stash(wanted.groupBy("needle").agg(F.min(F.lit(0)).alias("x")).select("needle"), "needles")
    size = distinct.agg(F.coalesce(F.sum(F.least(F.length("needle"), F.lit(ANCHOR))), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_chars))
    texts = texts.where(F.col("text").isNotNull()).select("text_id", "text")
    text_type = texts.schema["text_id"].dataType.simpleString()

    def scanned(shard: int) -> DataFrame:
        own = distinct if shards == 1 else distinct.where(F.pmod(F.xxhash64("needle"), F.lit(shards)) == shard)
        sent = spark.sparkContext.broadcast(own.toArrow().column("needle").to_pylist())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = sent.value
            if id(words) not in _built:  # a worker's next task has the same list
                _built.clear()
                _built[id(words)] = (words, automaton(words))
            machine = _built[id(words)][1]
            for batch in batches:
                rows, hits = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    own = found_in(text, machine, words) if words else ()
                    rows += [i] * len(own)
                    hits += [words[j] for j in own]
                yield pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], names=["text_id", "needle"])

        return texts.mapInArrow(run, f"text_id {text_type}, needle string")

    pairs = reduce(DataFrame.unionByName, map(scanned, range(shards)))
    return pairs.join(wanted, "needle").select("text_id", "needle_id")
