"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text.  A text is parsed greedily into phrases, each the
longest match that the automaton accepts; with n bytes learnt and m bytes parsed into c phrases, c * log2(n) / m
estimates the cross entropy in bits a byte.  The language that needs fewest normalised phrases wins; ties go to the
first in alphabetical order.

Text is lower-cased, runs of other characters than letters and marks become one blank; the symbols are its bytes in
UTF-8, so every letter of every script is told apart.  A text is parsed whole, as one sequence of phrases.  To advance
many places in step, one table lookup a byte, it is cut into blocks that are parsed as if a phrase began there; then each
block is parsed again from the state that the block before ends in, until both parses are in one state, from where on
they are the same.  Texts that repeat themselves may never get in step; after a few rounds they are parsed in order, so the
time is linear in the length of any text.  The result depends neither on the size of the blocks nor on the rounds.

Learning takes a bounded sample of rows: SLOTS labelled documents a language, chosen by hashes of their ids, whole texts;
documents of more than LONG characters only where a slot has no other.  More than MOST_LANGUAGES labels raise an error.

Defined results: null text, empty text and text without a letter get ``und`` and score 0; without labelled rows all get
``und``; a repeated row gets the same result; other columns are ignored.  The score is 1 - best / second best
(1 if one language is known), so 0 is a tie.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import small_batches

UNKNOWN = "und"
SLOTS = 16
LONG = 8_000
MOST_LANGUAGES = 256
BLOCK = 1024
#: Rounds in which blocks are brought in step side by side; what is in doubt afterwards is parsed in order.
ROUNDS = 8
_BATCH_CHARS = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark, 0 for others."""
    kinds = {"L": 2, "M": 1}
    return np.fromiter((kinds.get(unicodedata.category(chr(point))[0], 0) for point in range(0x110000)), np.uint8, 0x110000)


def normalised(text: str) -> np.ndarray:
    """Lower-case letters and single blanks, as bytes of UTF-8; empty if there is no letter."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = letters()[raw]
    if not (kind == 2).any():
        return np.zeros(0, np.uint8)
    out = np.where(kind > 0, raw, np.uint32(32))
    keep = kind > 0
    keep[1:] |= kind[:-1] > 0
    return np.frombuffer(out[keep].tobytes().decode("utf-32-le").encode(), np.uint8)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    links, lengths, last = [-1], [0], 0
    for s in symbols:
        new = len(nexts)
        nexts.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        p = last
        while p != -1 and s not in nexts[p]:
            nexts[p][s] = new
            p = links[p]
        if p != -1:
            q = nexts[p][s]
            if lengths[p] + 1 == lengths[q]:
                links[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                while p != -1 and nexts[p].get(s) == q:
                    nexts[p][s] = copy
                    p = links[p]
                links[q] = links[new] = copy
        last = new
    return nexts


class Parser:
    """Automata of all languages as one table: state x symbol -> next state, with a flag where a phrase ends."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        learnt = [normalised(samples[k]) for k in self.languages]
        alphabet = np.unique(np.concatenate([*learnt, np.array([32], np.uint8)]))
        self.symbol = np.full(256, len(alphabet), np.int64)  # one more symbol stands for bytes that weren't learnt
        self.symbol[alphabet] = np.arange(len(alphabet))
        self.width = len(alphabet) + 1
        self.bits = np.array([np.log2(max(2, len(x))) for x in learnt])
        tables, self.starts, base = [], [], 0
        for x in learnt:
            nexts = suffix_automaton(self.symbol[x].tolist())
            start = np.zeros(self.width, np.int64)
            for s, q in nexts[0].items():
                start[s] = q
            t = np.tile((start + base) * self.width * 2 + 1, (len(nexts), 1))  # no transition: a phrase ends, the letter begins the next
            rows = np.repeat(np.arange(len(nexts)), [len(n) for n in nexts])
            cols = np.fromiter((s for n in nexts for s in n), np.int64, len(rows))
            t[rows, cols] = (np.fromiter((q for n in nexts for q in n.values()), np.int64, len(rows)) + base) * self.width * 2
            tables.append(t.astype(np.int32) if t.max() < 2**31 else t)
            self.starts.append(base)
            base += len(nexts)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (bytes, none empty) in each language."""
        k, sizes = len(self.languages), np.array([len(x) for x in texts])
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        lengths = np.minimum(BLOCK, sizes[owner] - place * BLOCK)
        steps = np.zeros((min(BLOCK, int(lengths.max())), len(owner)), np.int64)  # byte t of every block, side by side
        ends = np.cumsum(lengths)
        steps[np.arange(ends[-1]) - np.repeat(ends - lengths, lengths), np.repeat(np.arange(len(owner)), lengths)] = self.symbol[np.concatenate(texts)]
        root = np.array(self.starts, np.int64) * self.width
        order = np.argsort(-lengths, kind="stable")  # blocks that end first are last
        alive = np.searchsorted(-lengths[order], -np.arange(len(steps)), "left")
        state, end = np.repeat(root[:, None], len(owner), 1), np.empty((k, len(owner)), np.int64)
        count = np.zeros((k, len(owner)), np.int32)
        steps = np.ascontiguousarray(steps[:, order])
        for t in range(len(steps)):
            n = alive[t]
            if n < state.shape[1]:
                end[:, n:state.shape[1]] = state[:, n:]
                state = np.ascontiguousarray(state[:, :n])
            got = self.table.take(state + steps[t, :n])
            count[:, :n] += got & 1
            state = np.right_shift(got, 1, out=state, casting="unsafe")
        end[:, :state.shape[1]] = state
        column = np.empty(len(owner), np.int64)
        column[order] = np.arange(len(owner))
        first, last, extra = end[:, column], end[:, column], np.zeros((k, len(owner)), np.int32)
        lang, block = (x.ravel() for x in np.meshgrid(np.arange(k), np.flatnonzero(place > 0), indexing="ij"))
        rounds = 0
        while len(block) and rounds < ROUNDS:  # from where the block before ends, next to the parse from the root, until they meet
            rounds += 1
            real, other, more, at = last[lang, block - 1], root[lang], np.zeros(len(block), np.int32), np.arange(len(block))
            for t in range(len(steps)):
                at = at[(real[at] != other[at]) & (t < lengths[block[at]])]
                if not len(at):
                    break
                s = steps[t, column[block[at]]]
                a, b = self.table.take(real[at] + s), self.table.take(other[at] + s)
                more[at] += (a & 1) - (b & 1)
                real[at], other[at] = a >> 1, b >> 1
            extra[lang, block] = more
            met = real == other
            real[met] = first[lang[met], block[met]]
            moved = real != last[lang, block]
            last[lang, block] = real
            moved[block + 1 >= len(owner)] = False
            lang, block = lang[moved], block[moved] + 1
            inner = place[block] > 0
            lang, block = lang[inner], block[inner]
        table = memoryview(self.table)
        open_ = {}  # texts that repeat themselves may never get in step; they are parsed in order from the first block in doubt
        for g, b in zip(lang.tolist(), block.tolist()):
            open_[g, owner[b]] = min(b, open_.get((g, owner[b]), b))
        for (g, i), b in open_.items():
            real = int(last[g, b - 1])
            while b < len(owner) and owner[b] == i:
                n = 0
                for s in steps[:lengths[b], column[b]].tolist():
                    got = table[real + s]
                    n += got & 1
                    real = got >> 1
                extra[g, b] = n - count[g, column[b]]
                b += 1
        total = count[:, column] + extra
        return np.add.reduceat(total, np.cumsum(blocks) - blocks, axis=1) + 1  # the last phrase has no end

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score and bits a byte of each text."""
        symbols = [normalised(text) if text else np.zeros(0, np.uint8) for text in texts]
        sizes = np.array([len(x) for x in symbols])
        full = np.flatnonzero(sizes)
        if not len(full) or not self.languages:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        bits = np.zeros((len(self.languages), len(texts)))
        bits[:, full] = self.phrases([symbols[i] for i in full]) * self.bits[:, None] / sizes[full]
        best = bits.argmin(0)
        least = bits.min(0)
        second = np.partition(bits, 1, 0)[1] if len(self.languages) > 1 else np.full(len(texts), np.inf)
        score = np.where(np.isinf(second), 1.0, 1.0 - least / np.maximum(second, 1e-12))
        return [(self.languages[b], float(s), float(x)) if n else (UNKNOWN, 0.0, 0.0) for b, s, x, n in zip(best, score, least, sizes)]


def learn(documents: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Bounded sample of labelled text for each language; allowed: which rows may be learnt from.

    The sample takes, for each language and each of SLOTS hash slots, the document with the least hash of its id, one of
    at most LONG characters first: sums per key that combine before the shuffle, so a language with most of the rows is no
    hot group.  Of documents with one id and language the greatest text is taken.
    """
    slot = F.xxhash64(F.col(id_col).cast("string"), F.lit("langid"))
    rows = documents.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & F.col(id_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), slot.alias("h"), F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")
    )
    picks = (
        rows.groupBy("lang", F.pmod("h", F.lit(SLOTS)).alias("slot")).agg(F.min(F.struct((F.length("t") > LONG).alias("long"), "h", "i")).alias("least"))
        .select("lang", "slot", F.col("least.i").alias("i")).orderBy("lang", "slot").limit(MOST_LANGUAGES * SLOTS + 1).collect()
    )
    if len({r.lang for r in picks}) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels of languages")
    if not picks:
        return {}
    held = rows.where(F.col("i").isin([r.i for r in picks])).groupBy("lang", "i").agg(F.max("t").alias("t")).collect()
    texts = {(r.lang, r.i): r.t for r in held}
    found: dict[str, list[str]] = {}
    for r in picks:
        found.setdefault(r.lang, []).append(texts[r.lang, r.i])
    return {k: " ".join(v) for k, v in found.items()}


_parsers: dict[int, Parser] = {}


def predict(documents: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred, score and bits of each row, after its id and the columns named in keep. One pass, no shuffle."""
    spark = documents.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(samples)
    rows = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("text_in"), *(F.col(c) for c in keep))
    kept = [f for f in rows.schema if f.name != "text_in"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(sorted(sent.value.items())))
        if (parser := _parsers.get(key)) is None:
            _parsers.clear()
            parser = _parsers[key] = Parser(sent.value)
        for batch in batches:
            at, texts = 0, batch.column(1).to_pylist()
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= _BATCH_CHARS):
                    size += len(texts[end] or "")
                    end += 1
                done = parser.predict(texts[at:end])
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.float64()), pa.array([d[2] for d in done], pa.float64())],
                    names=[f.name for f in kept] + ["lang_pred", "score", "bits"],
                )
                at = end

    return rows.mapInArrow(run, StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits", DoubleType())]))
