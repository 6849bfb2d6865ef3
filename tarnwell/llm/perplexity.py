"""Quality rules: counts of a text, and an n-gram language model with a band of perplexities for each language.

The model has n-grams of ORDER bytes (no words: bytes need no segmentation, and their number follows the languages rather
than every name and number of the corpus) with modified Kneser-Ney smoothing: three discounts an order, continuation
counts below the highest order, interpolation with the lower order, back-off where a context or an n-gram wasn't seen.
Spark counts the n-grams of all documents that pass the base rules, in two folds by a hash of the text, so that copies are
in one fold; each fold is judged by the model of the other, so no text raises its own probability.  The n-grams of a
fold get their bits by joins with the other fold's counts, on the whole, without a limit on their number.

The result is a table of 64-bit keys (hash of fold, language, n-gram) and bits, sorted by key.  Up to FEW keys, which is
counted, it is sent to the executors as two sorted arrays and searched; beyond, the documents' n-grams are joined to it by
key.  Both give the same bits.

Each text that passes the base rules gets its mean bits a byte, rounded to four digits.  In each language the exact
quartiles of these give a band, median - LOWER * (median - first quartile) to median + UPPER * (third quartile - median),
each side at least LEAST_SIDE bits; documents outside are rejected.  Short texts vary more, so for a text of w n-grams the
sides are wider by a factor of 1 + sqrt(SHORT / w).

Defined results: null text has no words; documents that the base rules reject have null bits and perplexity; a null
language is a language of its own; a language with texts in one fold only is judged by equal probabilities; repeated rows
get the same result and count as often as they stand; a text of fewer than ORDER bytes has no n-gram (the base rules reject
it); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, joined_hashes, mixed, run_starts, small_batches, span_hashes, stash, text_bytes, word_spans

ORDER = 4
FOLDS = 2
LOWER, UPPER, LEAST_SIDE, SHORT = 6.0, 3.5, 0.05, 250.0
MIN_WORDS, MOST_REPEATED = 50, 50
#: Keys of the model that are sent to every executor, and rows of a table by language that are broadcast.
FEW, FEW_LANGUAGES = 4_000_000, 10_000
#: n-grams that a task holds before it sends its counts on.
_HELD = 2_000_000
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams inside the texts, and the row of each."""
    n = len(data) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = data.astype(np.int64)
    packed = wide[:n]
    for k in range(1, ORDER):
        packed = (packed << 8) | wide[k:n + k]
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = row[:n] == row[ORDER - 1:]
    return packed[inside], row[:n][inside]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = run_starts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def base_counts(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The countable features of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = len(starts) - 1
    begin, end, row = word_spans(data, starts)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[data])))
    words = span_hashes(data, begin, end)
    covered = np.zeros(len(words) + 2, bool)
    windows = joined_hashes(words, 3)
    inside = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    keys = mixed(windows[inside] + row[inside].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = run_starts(ranked)
    many = np.repeat(np.diff(np.append(first, len(ranked))) > 1, np.diff(np.append(first, len(ranked)))) if len(first) else np.zeros(0, bool)
    at = inside[order[many]]
    for k in range(3):
        covered[at + k] = True
    dup = np.zeros(rows, np.int64)
    whole = data.tobytes()
    for i in range(rows):
        lines = whole[starts[i]:starts[i + 1]].split(b"\n")
        if len(lines) > 1:
            real = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
            dup[i] = len(real) - len(set(real))
    return {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": np.bincount(row, points[end] - points[begin], rows).astype(np.int64),
        "n_symbols": symbols[starts[1:]] - symbols[starts[:-1]],
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(row, covered[:len(row)], rows).astype(np.int64),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def failing(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def _fold(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    whole = data.tobytes()
    return np.array([xxhash.xxh64_intdigest(whole[a:b]) >> 32 for a, b in zip(starts[:-1], starts[1:])], np.int64) % FOLDS


def _model_keys(fold: np.ndarray, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams; lang: a number that names the language."""
    return mixed(mixed(lang.astype(np.uint64) * np.uint64(FOLDS) + fold.astype(np.uint64)) ^ gram.astype(np.uint64)).astype(np.int64)


def _named(languages: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode()) & 0x3FFFFFFFFFFFFFFF for x in languages], np.uint64)


def _inputs(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    small_batches(documents.sparkSession)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("t"))


def count_grams(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """fold, lang, gram, n: how often each n-gram stands in the documents of a fold and language that pass the base rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
            names = pa.array(list(codes), pa.string())
            return pa.RecordBatch.from_arrays([pa.array((keys >> 8 * ORDER) % FOLDS), names.take(pa.array((keys >> 8 * ORDER) // FOLDS)), pa.array(keys & ((1 << 8 * ORDER) - 1)), pa.array(counts)], names=["fold", "lang", "gram", "n"])

        for batch in batches:
            lang = np.array([codes.setdefault(x, len(codes)) for x in batch.column(1).to_pylist()], np.int64)
            data, offsets = text_bytes(batch.column(2))
            for i, j in blocks(offsets):
                part, starts = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                passed = ~failing(base_counts(part, starts))
                packed, row = _grams(part, starts)
                taken = passed[row]
                packed, row = packed[taken], row[taken]
                keys = np.sort(((lang[i:j] * FOLDS + _fold(part, starts))[row] << 8 * ORDER) | packed)
                first = run_starts(keys)
                held.append((keys[first], np.diff(np.append(first, len(keys)))))
                size += len(first)
            if size > _HELD:
                merged = _summed(*(np.concatenate(x) for x in zip(*held)))
                held[:], size = [merged], len(merged[0])
                if size > _HELD // 2:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return _inputs(documents, id_col, text_col, lang_col).mapInArrow(run, "fold long, lang string, gram long, n long").groupBy("fold", "lang", "gram").agg(F.sum("n").alias("n"))


def _few(df: DataFrame, most: int) -> DataFrame:
    """The table, with a broadcast hint if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _discounts(orders: dict[int, DataFrame]) -> DataFrame:
    """k, fold, lang, d1, d2, d3: the discounts of each order."""
    n1, n2, n3, n4 = (F.sum((F.col("n") == c).cast("double")) for c in (1, 2, 3, 4))
    found = None
    for k, grams in orders.items():
        one = grams.groupBy("fold", "lang").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4")).withColumn("k", F.lit(k))
        found = one if found is None else found.unionByName(one)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(i: int):
        value = F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))
        return F.least(F.greatest(F.coalesce(value, F.lit(0.5 * i)), F.lit(0.01)), F.lit(i - 0.01)).alias(f"d{i}")

    return stash(found.select("k", "fold", "lang", *(discount(i) for i in (1, 2, 3))), "discounts")


def smoothed(counts: DataFrame) -> DataFrame:
    """fold, lang, gram, bits: of each n-gram of a fold, -log2 of the probability that the other folds' model gives its last byte."""
    orders = {ORDER: stash(_others(counts), "order")}
    wanted = {ORDER: counts.select("fold", "lang", "gram")}
    for k in range(ORDER - 1, 0, -1):
        low = F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")
        orders[k] = stash(orders[k + 1].groupBy("fold", "lang", low).agg(F.count(F.lit(1)).alias("n")), "order")
        wanted[k] = wanted[k + 1].select("fold", "lang", low).distinct()
    discounts = _few(_discounts(orders), FEW_LANGUAGES)
    here, lower = ["fold", "lang"], None
    for k in range(1, ORDER + 1):
        grams = orders[k].join(discounts.where(F.col("k") == k).drop("k"), here)
        grams = grams.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        grams = grams.select(*here, "gram", F.shiftright("gram", 8).alias("ctx"), "n", "d")
        contexts = grams.groupBy(*here, "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
        asked = wanted[k].withColumn("ctx", F.shiftright("gram", 8)).join(grams.drop("ctx"), [*here, "gram"], "left").join(contexts, [*here, "ctx"], "left")
        if k == 1:
            asked = asked.withColumn("p_low", F.lit(1 / 256))
        else:
            asked = asked.withColumn("low", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(lower, [*here, "low"])
        own = F.coalesce(F.col("n") - F.col("d"), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("p_low")).otherwise((own + F.col("freed") * F.col("p_low")) / F.col("total"))
        lower = stash(asked.select(*here, F.col("gram").alias("low"), p.alias("p_low")), "probabilities")
    return lower.select(*here, F.col("low").alias("gram"), (-F.log2("p_low")).alias("bits"))


def _others(counts: DataFrame) -> DataFrame:
    """fold, lang, gram, n: what a fold is judged by, the sums over the other folds."""
    spread = counts.withColumn("fold", F.explode(F.array_remove(F.array(*(F.lit(i).cast("long") for i in range(FOLDS))), F.col("fold"))))
    return spread.groupBy("fold", "lang", "gram").agg(F.sum("n").alias("n"))


def keyed(model: DataFrame) -> DataFrame:
    """key, bits of the n-grams, sorted by key in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, gram = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            names = batch.column(1).dictionary_encode()
            lang = _named(names.dictionary.to_pylist())[names.indices.to_numpy(zero_copy_only=False)] if batch.num_rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_model_keys(fold, lang, gram)), batch.column(3)], names=["key", "bits"])

    return model.select("fold", "lang", "gram", "bits").mapInArrow(run, "key long, bits double")


_PROFILE = "doc_id long, lang string, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, n_grams long"
_PROFILE_NAMES = ["doc_id", "lang", *COUNTS, "base_failed", "n_grams"]


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Columns of _PROFILE of a block of rows, then the model's key of each n-gram of rows that pass, and its row."""
    for batch in batches:
        lang = _named(batch.column(1).to_pylist())
        data, offsets = text_bytes(batch.column(2))
        for i, j in blocks(offsets):
            part, starts = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            counts = base_counts(part, starts)
            failed = failing(counts)
            packed, row = _grams(part, starts)
            taken = ~failed[row]
            packed, row = packed[taken], row[taken]
            columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(counts[k].astype(np.int64)) for k in COUNTS), pa.array(failed), pa.array(np.bincount(row, minlength=j - i))]
            yield columns, _model_keys(_fold(part, starts)[row], lang[i:j][row], packed), row


def scored(documents: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, base_failed, number of n-grams and mean bits of each text. model: key, bits."""
    rows = _inputs(documents, id_col, text_col, lang_col)
    bits = F.round(F.col("bits"), 4)
    if model.limit(FEW + 1).count() > FEW:
        return _joined(rows, model).withColumn("bits", bits)
    found = model.sort("key").toArrow()
    sent = documents.sparkSession.sparkContext.broadcast((found["key"].to_numpy(), found["bits"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = sent.value
        for columns, asked, row in _profiles(batches):
            different, back = np.unique(asked, return_inverse=True)
            total = np.bincount(row, values[np.searchsorted(keys, different)][back], len(columns[0])) if len(asked) else np.zeros(len(columns[0]))
            n = columns[-1].to_numpy()
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total / np.maximum(n, 1), mask=n == 0)], names=[*_PROFILE_NAMES, "bits"])

    return rows.mapInArrow(run, f"{_PROFILE}, bits double").withColumn("bits", bits)


def _joined(rows: DataFrame, model: DataFrame) -> DataFrame:
    """As scored, for a model of any size: the n-grams of each text are joined to it by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for columns, asked, row in _profiles(batches):
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays([pa.array(base + np.arange(n)), *columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["row", *_PROFILE_NAMES, "key", "times"])
            order = np.lexsort((asked, row))
            first = np.flatnonzero(np.concatenate(([True], (asked[order][1:] != asked[order][:-1]) | (row[order][1:] != row[order][:-1])))) if len(order) else order
            times = np.diff(np.append(first, len(order)))
            none = [pa.nulls(len(first), c.type) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(base + row[order][first]), *none, pa.array(asked[order][first]), pa.array(times)], names=["row", *_PROFILE_NAMES, "key", "times"])
            base += n

    told = stash(rows.mapInArrow(run, f"row long, {_PROFILE}, key long, times long"), "profiles")
    sums = told.where("key is not null").select("row", "key", "times").join(model, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("bits")).alias("sum"))
    return told.where("key is null").drop("key", "times").join(sums, "row", "left").withColumn("bits", F.col("sum") / F.col("n_grams")).drop("row", "sum")


def bands(scores: DataFrame) -> DataFrame:
    """lang, middle, below, above: the band of bits of each language, from all documents that have bits; exact quartiles."""
    each = scores.where(F.col("bits").isNotNull()).groupBy("lang", "bits").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("bits"))
    placed = each.select("lang", "bits", upto.alias("upto"), F.sum("n").over(Window.partitionBy("lang")).alias("all"))
    q = [F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bits"))).alias(f"q{k}") for k in (1, 2, 3)]
    return placed.groupBy("lang").agg(*q).select(
        "lang", F.col("q2").alias("middle"), F.greatest(LOWER * (F.col("q2") - F.col("q1")), F.lit(LEAST_SIDE)).alias("below"),
        F.greatest(UPPER * (F.col("q3") - F.col("q2")), F.lit(LEAST_SIDE)).alias("above"),
    )


def assess(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, base_failed, kept, bits and perplexity of each document."""
    counts = stash(count_grams(documents, id_col, text_col, lang_col), "grams")
    model = stash(keyed(smoothed(counts)), "model")
    scores = stash(scored(documents, model, id_col, text_col, lang_col), "scores")
    joined = scores.join(_few(stash(bands(scores), "bands"), FEW_LANGUAGES), "lang", "left")
    wide = 1 + F.sqrt(F.lit(SHORT) / F.greatest(F.col("n_grams"), F.lit(1)))
    inside = F.col("bits").between(F.col("middle") - F.col("below") * wide, F.col("middle") + F.col("above") * wide)
    return joined.select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        "lang", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "n_grams",
    )
