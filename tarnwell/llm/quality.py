"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Features of a text: its words and pairs of words, and the same of the words' shapes (letters, capitals, digits and each
symbol, runs taken once), hashed to 2**BITS places, and the pairs of a word with itself, with log(1 + count) as value and unit
length; one more for the logarithm of the number of words, one constant.

Learning takes a bounded sample: the MOST_ROWS labelled documents with the least hashes of their ids.  Their sparse
features (not texts) come to the driver, where the regression makes EPOCHS passes over them in a fixed order.  Of documents
with one id the greatest text is taken, of labels the greatest label.

Defined results: null and empty texts are texts without words and get a score like any other; rows without a label
aren't learnt from; without any labelled row all scores are 0.5; repeated rows get the same score; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import blocks, joined_hashes, mixed, run_starts, small_batches, span_hashes, text_bytes, word_spans

BITS = 18
MOST_ROWS = 3000
EPOCHS = 4
_CONSTANT, _SIZES, _REPEATED, _PLACES = 0, 1, 63, 64  # the first places are not hashed to

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a"):ord("z") + 1] = _SHAPE[128:] = ord("a")
_SHAPE[ord("A"):ord("Z") + 1] = ord("A")
_SHAPE[ord("0"):ord("9") + 1] = ord("0")


def _places(hashes: np.ndarray, kind: int) -> np.ndarray:
    x = mixed(hashes ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - BITS)
    return np.maximum(x.astype(np.int64), _PLACES)


def sparse(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of every feature, sorted by row and place, and the words of each row."""
    rows = len(starts) - 1
    begin, end, row = word_spans(data, starts)
    n_words = np.bincount(row, minlength=rows)
    words = span_hashes(data, begin, end)
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[begin] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    shapes = span_hashes(shape[keep], at[begin], at[end]) if len(begin) else words
    keys = []
    for k, hashes in enumerate((words, shapes)):
        keys.append((row << BITS) + _places(hashes, 2 * k + 1))
        pairs = joined_hashes(hashes, 2)
        inside = row[1:] == row[:-1]
        keys.append((row[1:][inside] << BITS) + _places(pairs[inside], 2 * k + 2))
    keys.append((row[1:][(row[1:] == row[:-1]) & (words[1:] == words[:-1])] << BITS) + _REPEATED)
    keys = np.sort(np.concatenate(keys))
    first = run_starts(keys)
    value = np.log1p(np.diff(np.append(first, len(keys))))
    keys = keys[first]
    owner, place = keys >> BITS, keys & ((1 << BITS) - 1)
    value = value / np.sqrt(np.maximum(np.bincount(owner, value * value, rows), 1e-12))[owner]
    return owner, place, value, n_words


def size_place(n_words: np.ndarray) -> np.ndarray:
    return _SIZES + np.minimum((2 * np.log2(n_words + 1)).astype(np.int64), _REPEATED - 2)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0,
          l1: float = 0.002, l2: float = 0.01) -> np.ndarray:
    """Weights by FTRL-proximal updates, one example after another."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for place, value, label in examples:
            zi, ni = z[place], n[place]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            n[place] = more = ni + g * g
            z[place] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
    return weights(z, n).astype(np.float32)


def learn(documents: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learnt from a bounded sample of the labelled rows for which ``allowed`` holds."""
    picks = (
        labels.where(allowed & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("label"))
        .withColumn("h", F.xxhash64(F.col("i").cast("string"), F.lit("quality"))).orderBy("h", "i").limit(MOST_ROWS)
    )
    chosen = {r.i: (r.h, r.label) for r in picks.collect()}
    if not chosen:
        return np.zeros(1 << BITS, np.float32)
    texts = documents.where(F.col(id_col).isin(list(chosen))).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(text_col).cast("string")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in blocks(offsets):
                owner, place, value, n_words = sparse(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                cut = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(n_words.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cut), pa.array(value.astype(np.float32))),
                ], names=["i", "n", "place", "value"])

    found = texts.mapInArrow(run, StructType([texts.schema["i"], StructField("n", LongType())]).simpleString()[7:-1].replace(":", " ") + ", place array<int>, value array<float>").toArrow()
    rows = {}
    for i, n, place, value in zip(found["i"].to_pylist(), found["n"].to_pylist(), found["place"], found["value"]):
        extra = np.array([_CONSTANT, size_place(np.array([n]))[0]])
        rows[i] = (np.concatenate((extra, place.values.to_numpy(zero_copy_only=False))), np.concatenate(([1.0, 1.0], value.values.to_numpy(zero_copy_only=False))))
    return train([(*rows[i], label) for i, (_, label) in sorted(chosen.items(), key=lambda x: (x[1][0], x[0])) if i in rows])


def score(documents: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of each row. One pass, no shuffle; the weights have 2**BITS places however large the input."""
    spark = documents.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(weights)
    rows = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in blocks(offsets):
                owner, place, value, n_words = sparse(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                total = np.bincount(owner, value * w[place], j - i) + w[_CONSTANT] + w[size_place(n_words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[id_col, "score"])

    return rows.mapInArrow(run, StructType([rows.schema[id_col], StructField("score", DoubleType())]))
