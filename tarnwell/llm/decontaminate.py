"""Benchmark decontamination by a distributed positional inverted index; DataFrame functions only.

1.  Documents are read as words once: the index's forward table has each document's number of words and their hashes
    in order (small numbers that repeat, so the table is a fraction of the texts).
2.  How often each word of the benchmark stands in all documents is counted from it.  In every window of an item
    (``size`` consecutive words; a shorter item is one window) the two rarest words are its anchors; a window with a word
    that no document has cannot occur.
3.  The positional index holds the postings (word, document, position) of the anchors, over all documents.
4.  A posting at position p of an anchor at place q of its item puts the item's start at p - q.  Starts on which both
    anchors of a window agree are candidates: the offset-adjusted lists are intersected from the rarest words on.
5.  Candidates are compared word by word with the texts of the documents that have any: exact phrase matches.
    ``proximity`` returns the documents in which the anchors of a window stand within a given distance, in any order.

Words are matched with A-Z lower-cased.  The index folds case with lower() and holds 32-bit hashes; both only add candidates.

The vocabulary, anchors and items are broadcast if they are at most BROADCAST_TERMS words of the benchmark, which is
counted; keys of documents with candidates if they are at most BROADCAST_KEYS; beyond that they are joined by shuffles.

Defined results: null text has no words; a document without words isn't contaminated; items that are null, have a null
id or no word are left out; items with equal ids count once; repeated documents get the same result; ties between equally rare
words go to the least hash, then to the first place; empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, stash

SIZE = 13
RATIO = 20
BROADCAST_TERMS = 2_000_000
BROADCAST_KEYS = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words once A-Z are lower-cased, and the same words in the text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Separators one by one: the regular expression engine then tests a letter by one look into a table.
RAW_WORD = "[^" + "".join(f"\\x{c:02X}" for c in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))) + "]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0))


def term(word: Column) -> Column:
    return F.hash(F.lower(word))


class Index:
    """Items, anchors and postings for one benchmark over one collection of documents."""

    def __init__(self, documents: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text"):
        self.size = size
        self.documents = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", row_key())
        self.items = stash(
            benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col).cast("string")).alias("words"))
            .where(F.size("words") > 0).dropDuplicates(["item", "words"])
            .select(F.xxhash64("item", "words").alias("row"), "item", "words", F.size("words").alias("n")),
            "items",
        )
        total = self.items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.small = (lambda df: F.broadcast(df)) if total <= BROADCAST_TERMS else (lambda df: df)
        hashed = F.transform(raw_words(F.coalesce("text", F.lit(""))), term).alias("terms")
        self.forward = stash(self.documents.select("key", "doc_id", hashed), "forward")
        vocabulary = stash(self.items.select(F.explode("words").alias("word")).select(term(F.col("word")).alias("term")).distinct(), "vocabulary")
        found = self.forward.select(F.explode("terms").alias("term"))
        self.counts = stash(found.join(self.small(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_corpus")), "counts")
        self.anchors = stash(self._anchors(), "anchors")
        self.postings = stash(self._postings(self.anchors.select("term").distinct()), "postings")

    def _postings(self, terms: DataFrame) -> DataFrame:
        """term, key, pos of all occurrences of the terms in all documents."""
        return self.forward.select("key", F.posexplode("terms").alias("pos", "term")).join(self.small(terms), "term")

    def _anchors(self) -> DataFrame:
        """row, win, place, term: the two rarest words of each window that can occur; win is the window's place."""
        placed = self.items.select("row", "n", F.posexplode("words").alias("place", "word")).withColumn("term", term(F.col("word")))
        rated = placed.join(self.small(self.counts), "term", "left").select("row", "n", F.struct(F.coalesce("n_corpus", F.lit(0)).alias("rare"), "term", "place").alias("t"))
        whole = rated.groupBy("row", "n").agg(F.array_sort(F.collect_list(F.struct("t.place", "t"))).alias("ts"))
        spans = whole.select(
            "row", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - self.size, F.lit(0)))).alias("win"), "ts"
        ).select("row", "win", F.array_sort(F.transform(F.slice("ts", F.col("win") + 1, self.size), lambda x: x["t"])).alias("rarest"))
        return spans.where(F.col("rarest")[0]["rare"] > 0).select("row", "win", F.explode(F.slice("rarest", 1, 2)).alias("a")).select("row", "win", "a.place", "a.term")

    def candidates(self) -> DataFrame:
        """key, row, start: where an item may start in a document, as the anchors of some window agree."""
        places = self.anchors.select("row", "place", "term").distinct()
        wins = self.anchors.groupBy("row", "win").agg(F.collect_set("place").alias("need")).groupBy("row").agg(F.collect_set("need").alias("needs"))
        met = self.postings.join(self.small(places), "term").groupBy("key", "row", (F.col("pos") - F.col("place")).alias("start")).agg(F.collect_set("place").alias("have"))
        return met.join(self.small(wins), "row").where(F.exists("needs", lambda need: F.size(F.array_except(need, F.col("have"))) == 0)).select("key", "row", "start")

    def matches(self) -> DataFrame:
        """key, item, begin, end: every exact occurrence of a window, as places of the document's words."""
        found = stash(self.candidates().join(self.small(self.items.select("row", "n")), "row").groupBy("key").agg(F.collect_set(F.struct("row", "start", "n")).alias("found")), "found")
        keys = found.select("key")
        few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        held = self.documents.select("key", "text").join(F.broadcast(keys) if few else keys, "key", "left_semi").dropDuplicates(["key"])
        texts = held.join(found, "key").select("key", "found", words(F.col("text")).alias("words"))

        def part(c: Column) -> Column:
            first = F.greatest(c["start"], F.lit(0))
            return F.struct(c["row"].alias("row"), c["start"].alias("start"), first.alias("first"), F.slice(F.col("words"), first + 1, F.greatest(c["start"] + c["n"] - first, F.lit(0))).alias("part"))

        aligned = texts.select("key", F.explode(F.transform("found", part)).alias("c")).select("key", "c.*").join(self.small(self.items), "row")
        length = F.least(F.col("n"), F.lit(self.size))

        def same(win: Column) -> Column:
            at = F.col("start") + win - F.col("first")
            return (at >= 0) & (at + length <= F.size("part")) & (F.slice(F.col("part"), F.greatest(at, F.lit(0)) + 1, length) == F.slice(F.col("words"), win + 1, length))

        wins = F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - self.size, F.lit(0))), same)
        return aligned.select("key", "item", "start", length.alias("length"), F.explode(wins).alias("win")).select(
            "key", "item", (F.col("start") + F.col("win")).alias("begin"), (F.col("start") + F.col("win") + F.col("length")).alias("end")
        )

    def proximity(self, within: int) -> DataFrame:
        """doc_id, item, win: both anchors of a window within so many words of each other, in any order."""
        a = self.anchors.withColumn("k", F.row_number().over(Window.partitionBy("row", "win").orderBy("place")))
        one, two = (a.where(F.col("k") == k).select("row", "win", F.col("term").alias(f"term{k}"), F.col("place").alias(f"place{k}")) for k in (1, 2))
        pairs = one.join(two, ["row", "win"], "left")
        first = self.postings.select("key", F.col("pos").alias("pos1"), F.col("term").alias("term1")).join(self.small(pairs), "term1")
        step = F.floor(F.col("pos1") / F.lit(within + 1))
        near = first.withColumn("cell", F.explode(F.array(step - 1, step, step + 1)))
        second = self.postings.select(F.col("key"), F.col("pos").alias("pos2"), F.col("term").alias("term2"), F.floor(F.col("pos") / F.lit(within + 1)).alias("cell"))
        met = near.where(F.col("term2").isNotNull()).join(second, ["key", "term2", "cell"]).where((F.abs(F.col("pos1") - F.col("pos2")) <= within) & (F.col("pos1") != F.col("pos2")))
        alone = first.where(F.col("term2").isNull())
        hits = met.select("key", "row", "win").unionByName(alone.select("key", "row", "win")).distinct()
        return hits.join(self.small(self.items.select("row", "item")), "row").join(self.forward.select("key", "doc_id").distinct(), "key").select("doc_id", "item", "win").distinct()

    def report(self, ratio: int = RATIO) -> DataFrame:
        """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
        return self.rated(ratio).drop("key")

    def rated(self, ratio: int = RATIO) -> DataFrame:
        """The report with each row's key (``common.row_key``)."""
        spans = F.array_sort(F.collect_set(F.struct("begin", "end")))
        start = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("reach"))

        def step(acc: Column, s: Column) -> Column:
            return F.struct((acc["hit"] + F.greatest(s["end"] - F.greatest(s["begin"], acc["reach"]), F.lit(0))).alias("hit"), F.greatest(acc["reach"], s["end"]).alias("reach"))

        hits = self.matches().groupBy("key").agg(F.aggregate(spans, start, step, lambda acc: acc["hit"]).alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
        counted = self.forward.select("key", "doc_id", F.size("terms").cast("long").alias("n_words"))
        none = F.array().cast("array<string>")
        return counted.join(hits, "key", "left").select(
            "key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
            ((F.coalesce("n_hit", F.lit(0)) > 0) & (F.coalesce("n_hit", F.lit(0)) * ratio >= F.col("n_words"))).alias("contaminated"),
        )


def report(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, ratio: int = RATIO) -> DataFrame:
    return Index(documents, benchmark, size).report(ratio)
