"""Segmented text index: immutable segments of blocked postings, tombstones, and a manifest that is swapped in one step.

    index = SegmentedIndex.create(spark, path, documents)   # doc_id, text, optionally source
    index.add(more); index.delete(ids); index.merge(); index.vacuum()
    SegmentedIndex.open(spark, path)                         # None if there is none, or it is damaged or of another format

A segment has the documents, their postings and the document frequency of each term; it is never changed.  Postings are
blocks: the documents of a term are dealt by hash into blocks of about BLOCK_DOCS, so that no term has to be in one task or
file, and a search joins and reads blocks, not single postings.  Blocks are partitioned by a bucket of the term's hash, which
prunes the scan to the buckets of the terms asked for.  A ranking multiplies, in each block, the weights of queries by terms with the
terms' values by documents, and hands on the k best documents of each query, so no posting becomes a row for each query.
Texts are dealt by block before they are tokenised, a few blocks a task, so postings are made without a shuffle.

Deleting, or adding a document whose id is there, writes a tombstone: the dead ids by segment, and what they take away from the
frequencies, so that statistics always equal those of an index built anew of the live documents.  A manifest names format,
configuration, segments, tombstones and totals.  A change writes its tables first, then the manifest of the next generation by a rename that
fails if another writer was first: a change that fails, or a writer that loses, leaves the index as it was.

Defined results: blank and null texts are left out; an id may stand only once in what is added, else that is an error and nothing is changed;
null ids are an error; adding nothing changes nothing; deleting ids that aren't there changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.text import strip, tokenize
from tarnwell.operators.dense import SLACK, first_of_ties
from tarnwell.operators.retrieval import BM25, TextIndex, rounded, top
from tarnwell.sources.shared import Conflict, Folder, stash  # noqa: F401

FORMAT = 2
#: Documents of a block of postings (a term's block has at most about as many), and buckets of terms.
BLOCK_DOCS, BUCKETS = 1024, 16
#: Blocks that a task makes or ranks, so that its memory doesn't grow with the collection.
TASK_BLOCKS = 8
#: Dead documents up to which their ids are broadcast; the manifest has their number.
FEW_DEAD = 2_000_000
#: Terms asked for up to which they are broadcast, which is counted.
FEW_TERMS = 500_000
#: Numbers of a matrix of terms by documents, or of queries by documents, held at once.
CELLS = 4_000_000
#: Segments of about one size that are merged into one.
FAN = 8


@dataclass(frozen=True)
class Segment:
    name: str
    n_docs: int
    n_dead: int = 0


@dataclass(frozen=True)
class Manifest:
    generation: int
    config: BM25
    id_type: str
    source: bool
    segments: tuple[Segment, ...] = ()
    tombstones: tuple[str, ...] = ()
    n: int = 0  # live documents, their tokens and characters
    tokens: int = 0
    chars: int = 0
    buckets: int = BUCKETS
    block_docs: int = field(default=BLOCK_DOCS)

    def dumped(self) -> str:
        body = json.dumps(asdict(self) | {"format": FORMAT}, sort_keys=True)
        return json.dumps({"check": hashlib.sha256(body.encode()).hexdigest(), "body": body})

    @classmethod
    def loaded(cls, text: str) -> Manifest | None:
        """None if the text is damaged or of another format."""
        try:
            outer = json.loads(text)
            if hashlib.sha256(outer["body"].encode()).hexdigest() != outer["check"]:
                return None
            found = json.loads(outer["body"])
            if found.pop("format") != FORMAT:
                return None
            found |= {"config": BM25(**found["config"]), "segments": tuple(Segment(**s) for s in found["segments"]), "tombstones": tuple(found["tombstones"])}
            return cls(**found)
        except (ValueError, KeyError, TypeError):
            return None


def _columns(lists: pa.ChunkedArray, *names: str) -> tuple[np.ndarray, list[pa.Array]]:
    """The row of each struct of a column of lists, and the structs' fields."""
    column = lists.combine_chunks()
    flat = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), [pc.struct_field(flat, n) for n in names]


def _postings_of_block(rows: pa.Table) -> pa.Table:
    """block, term, docs, df, tokens of a block's documents (block, doc_id, tokens)."""
    column, ids = rows["tokens"].combine_chunks(), rows["doc_id"].combine_chunks()
    dl = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    coded = column.flatten().dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), dl)
    key, tf = np.unique(key, return_counts=True)
    term, doc = np.divmod(key, max(len(ids), 1))
    ends = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
    docs = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(dl[doc], pa.int32()), pa.array(tf, pa.int64())], names=["doc_id", "dl", "tf"])
    docs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), docs)
    tokens = np.diff(np.concatenate(([0], np.cumsum(tf)))[ends])
    block = pa.array(np.full(len(docs), rows["block"][0].as_py()), pa.int32())
    return pa.table([block, coded.dictionary, docs, pa.array(np.diff(ends), pa.int64()), pa.array(tokens, pa.int64())], names=["block", "term", "docs", "df", "tokens"])


def _best_of_block(k: int, config: BM25 | None, avgdl: float):
    """query_id, doc_id, score: a block's best documents of every query, and what may tie with the last of them after rounding.

    With a configuration values are those of BM25 and marked documents are dead; without, they are frequencies divided by the mark, and
    documents without one are dead.
    """

    def run(rows: pa.Table) -> pa.Table:
        _, (marked, marks) = _columns(rows["marks"], "doc_id", "x")
        rows = rows.filter(pc.is_valid(rows["asks"]))
        at, (ids, dl, tf) = _columns(rows["docs"], "doc_id", "dl", "tf")
        ask, (queries, w) = _columns(rows["asks"], "query_id", "w")
        ids, queries = ids.dictionary_encode(), queries.dictionary_encode()
        docs, names = ids.dictionary, queries.dictionary
        doc, who = ids.indices.to_numpy(), queries.indices.to_numpy()
        tf, w = tf.to_numpy().astype(np.float64), w.to_numpy()
        place = pc.fill_null(pc.index_in(docs, value_set=marked), -1).to_numpy(zero_copy_only=False) if len(marked) else np.full(len(docs), -1)
        if config:
            value = tf * (config.k1 + 1) / (tf + config.k1 * (1 - config.b + config.b * dl.to_numpy() / avgdl))
            live = place < 0
        else:
            live = place >= 0
            norm = np.ones(len(docs))
            norm[live] = marks.to_numpy()[place[live]]
            value = tf / norm[doc]
        order = np.argsort(who, kind="stable")
        who, ask, w = who[order], ask[order], w[order]
        out_q, out_d, out_s = [], [], []
        step, deep = max(1, CELLS // max(len(docs), 1)), rows.num_rows
        for q in range(0, len(names), step):
            n = min(step, len(names) - q)
            a, b = np.searchsorted(who, (q, q + n))
            s = np.zeros((n, len(docs)))
            for r in range(0, deep, step):
                m = min(step, deep - r)
                x, y = np.searchsorted(at, (r, r + m))
                held = np.zeros((m, len(docs)))
                np.add.at(held, (at[x:y] - r, doc[x:y]), value[x:y])
                for u in range(a, b, max(1, CELLS)):
                    some = slice(u, min(b, u + CELLS))
                    inside = (ask[some] >= r) & (ask[some] < r + m)
                    weight = np.zeros((n, m))
                    np.add.at(weight, (who[some][inside] - q, ask[some][inside] - r), w[some][inside])
                    s += weight @ held
            s[:, ~live] = 0.0
            keep = s > 0
            if len(docs) > k:
                keep &= s >= np.partition(s, len(docs) - k, axis=1)[:, [len(docs) - k]] - SLACK
            for i in np.flatnonzero(keep.sum(1) > 4 * k):
                keep[i] &= first_of_ties(s[i], docs, keep[i], k)
            i, j = np.nonzero(keep)
            out_q.append(i + q)
            out_d.append(j)
            out_s.append(s[i, j])
        i, j, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_d, out_s))
        return pa.table([names.take(pa.array(i)), docs.take(pa.array(j)), pa.array(s, pa.float64())], names=["query_id", "doc_id", "score"])

    return run


class SegmentedIndex(TextIndex):
    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest, self.config = spark, path.rstrip("/"), manifest, manifest.config
        self.folder = Folder(spark, path)

    # -- life -----------------------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, documents: DataFrame, config: BM25 = BM25(), id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, block_docs: int = BLOCK_DOCS) -> SegmentedIndex:
        """An index of these documents only. One that is at the path stays readable until the new one is whole, and by those that have it open until ``vacuum``."""
        generations = Folder(spark, path).names("manifest")
        last = max((int(g.partition(".")[0]) for g in generations if g[0] != "."), default=-1)
        empty = Manifest(last, config, documents.schema[id_col].dataType.simpleString(), "source" in documents.columns, buckets=buckets, block_docs=block_docs)
        index = cls(spark, path, empty)
        rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(["source"] if empty.source else []))
        return index._commit(index._with(rows, ()))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SegmentedIndex | None:
        folder = Folder(spark, path)
        generations = [g for g in folder.names("manifest") if g[0] != "."]
        manifest = Manifest.loaded(folder.read(f"manifest/{generations[-1]}")) if generations else None
        if manifest is None:
            return None
        tables = [f"segments/{s.name}/{t}" for s in manifest.segments for t in ("documents", "blocks", "terms")] + [f"tombstones/{t}/{x}" for t in manifest.tombstones for x in ("ids", "terms")]
        return cls(spark, path, manifest) if all(folder.exists(f"{t}/_SUCCESS") for t in tables) else None

    def add(self, documents: DataFrame) -> SegmentedIndex:
        """Also these documents; of an id that is there already the new text counts. Segments that are there stay untouched."""
        return self._commit(self._with(documents.select("doc_id", "text", *(["source"] if self.manifest.source else [])), self.manifest.segments))

    def delete(self, ids: DataFrame) -> SegmentedIndex:
        """Without the documents of these ids (doc_id)."""
        return self._commit(self._buried(self.manifest, ids.select("doc_id").distinct()))

    def merge(self, fan: int = FAN) -> SegmentedIndex:
        """Merge segments of about one size, wherever ``fan`` or more are: their live postings move, no text is tokenised again."""
        tiers: dict[int, list[Segment]] = {}
        for s in self.manifest.segments:
            tier, size = 0, max(s.n_docs - s.n_dead, 1)
            while size >= fan:
                tier, size = tier + 1, size // fan
            tiers.setdefault(tier, []).append(s)
        joined = [s for group in tiers.values() if len(group) >= fan for s in group]
        if not joined:
            return self
        name = uuid.uuid4().hex
        own = SegmentedIndex(self.spark, self.path, replace(self.manifest, segments=tuple(joined)))
        own.documents.write.parquet(f"{self.path}/segments/{name}/documents")
        n = sum(s.n_docs - s.n_dead for s in joined)
        rows = self._dealt(own.postings(), n).groupBy("block", "term")
        self._write_blocks(name, rows.agg(F.collect_list(F.struct("doc_id", "dl", "tf")).alias("docs"), F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tokens")), n)
        rest = tuple(s for s in self.manifest.segments if s not in joined)
        alive = {s.name for s in rest if s.n_dead}
        return self._commit(replace(self.manifest, segments=(*rest, Segment(name, n)), tombstones=self.manifest.tombstones if alive else ()))

    def vacuum(self) -> int:
        """Delete what the newest manifest doesn't name; number of folders and manifests deleted."""
        m, gone = self.manifest, []
        gone += [f"segments/{x}" for x in self.folder.names("segments") if x not in {s.name for s in m.segments}]
        gone += [f"tombstones/{x}" for x in self.folder.names("tombstones") if x not in m.tombstones]
        gone += [f"manifest/{x}" for x in self.folder.names("manifest") if not x.startswith(f"{m.generation:010d}")]
        gone += [f"norms/{x}" for x in self.folder.names("norms") if x != str(m.generation)]
        for name in gone:
            self.folder.delete(name)
        return len(gone)

    def clear(self) -> None:
        self.folder.delete()

    def _commit(self, manifest: Manifest) -> SegmentedIndex:
        if manifest is self.manifest:
            return self
        after = replace(manifest, generation=self.manifest.generation + 1)
        self.folder.put_once(f"manifest/{after.generation:010d}.json", after.dumped())
        return SegmentedIndex(self.spark, self.path, after)

    # -- writing --------------------------------------------------------------------------------------------------------

    def _with(self, documents: DataFrame, segments: tuple[Segment, ...]) -> Manifest:
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        documents.where(strip(F.col("text")) != "").write.parquet(f"{at}/documents")
        rows = self.spark.read.parquet(f"{at}/documents")
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
        if size.none or rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            self.folder.delete(f"segments/{name}")
            raise ValueError("a document needs an id of its own")
        if not size.n and segments:
            self.folder.delete(f"segments/{name}")
            return self.manifest
        # texts are dealt by block and tokenised where all of a block's are, so no token is shuffled
        texts = self._dealt(rows, size.n).select("block", "doc_id", tokenize(F.col("text"), self.config.ngram).alias("tokens"))
        schema = f"block int, term string, docs array<struct<doc_id:{self.manifest.id_type},dl:int,tf:bigint>>, df bigint, tokens bigint"
        n_tokens = self._write_blocks(name, texts.groupBy("block").applyInArrow(_postings_of_block, schema), size.n)
        before = self._buried(replace(self.manifest, segments=segments), rows.select("doc_id")) if segments else replace(self.manifest, segments=(), tombstones=(), n=0, tokens=0, chars=0)
        return replace(before, segments=(*before.segments, Segment(name, size.n)), n=before.n + size.n, tokens=before.tokens + n_tokens, chars=before.chars + size.chars)

    def _tasks(self, blocks: int) -> int:
        return max(1, min(blocks, max(self.spark.sparkContext.defaultParallelism, -(-blocks // TASK_BLOCKS))))

    def _dealt(self, rows: DataFrame, n_docs: int) -> DataFrame:
        """The rows (doc_id, ..) with their block, all of a block's in one of so many tasks that each has a few, and none more than its share."""
        blocks = self._blocks_of(n_docs)
        # blocks are numbered without gaps, so dealing by number is even; by hash some tasks get twice the blocks of others, and more the more there are
        return rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).repartitionById(self._tasks(blocks), "block")

    def _write_blocks(self, name: str, rows: DataFrame, n_docs: int) -> int:
        """The tables of blocks (block, term, docs, df, tokens) and of frequencies; how many tokens they are."""
        at = f"{self.path}/segments/{name}"
        rows.withColumn("bucket", self.bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{at}/blocks")
        # with their sums in columns of their own, postings aren't read again
        schema = "term string, df bigint, tokens bigint"
        saved = self.spark.read.schema(schema).parquet(f"{at}/blocks") if n_docs else self.spark.createDataFrame([], schema)
        saved.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")).write.parquet(f"{at}/terms")
        return self.spark.read.parquet(f"{at}/terms").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    def _buried(self, manifest: Manifest, ids: DataFrame) -> Manifest:
        """The manifest with tombstones for the live documents that have one of these ids."""
        own = SegmentedIndex(self.spark, self.path, manifest)
        name = uuid.uuid4().hex
        at = f"{self.path}/tombstones/{name}"
        dead = own._rows().join(ids, "doc_id", "left_semi")
        tokens = tokenize(F.col("text"), self.config.ngram)
        dead.select("segment", "doc_id", F.length("text").alias("chars"), F.size(tokens).alias("dl")).write.parquet(f"{at}/ids")
        sums = self.spark.read.parquet(f"{at}/ids").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("tokens"), F.sum("chars").alias("chars")).collect()
        if not sums:
            self.folder.delete(f"tombstones/{name}")
            return manifest
        terms = dead.select("segment", F.explode(F.array_distinct(tokens)).alias("term"))
        terms.groupBy("segment", "term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{at}/terms")
        by = {r.segment: r for r in sums}
        segments = tuple(replace(s, n_dead=s.n_dead + by[s.name].n) if s.name in by else s for s in manifest.segments)
        # a segment without live documents goes
        segments = tuple(s for s in segments if s.n_dead < s.n_docs)
        total = lambda c: sum(getattr(r, c) for r in sums)
        return replace(manifest, segments=segments, tombstones=(*manifest.tombstones, name), n=manifest.n - total("n"), tokens=manifest.tokens - total("tokens"), chars=manifest.chars - total("chars"))

    # -- reading --------------------------------------------------------------------------------------------------------

    def bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.manifest.buckets)).cast("int")

    def _segments(self, table: str, schema: str) -> DataFrame:
        """A table of all segments, with their names."""
        names = [s.name for s in self.manifest.segments]
        if not names:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/segments/{n}/{table}").withColumn("segment", F.lit(n)) for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _tombstones(self, table: str) -> DataFrame | None:
        """Tombstones of the manifest's segments; None if there are none."""
        if not any(s.n_dead for s in self.manifest.segments):
            return None
        rows = self.spark.read.parquet(*(f"{self.path}/tombstones/{t}/{table}" for t in self.manifest.tombstones))
        return rows.where(F.col("segment").isin([s.name for s in self.manifest.segments if s.n_dead]))

    def _live(self, rows: DataFrame) -> DataFrame:
        """The rows (segment, doc_id, ..) of live documents."""
        dead = self._tombstones("ids")
        if dead is None:
            return rows
        dead = dead.select("segment", "doc_id")
        n = sum(s.n_dead for s in self.manifest.segments)
        return rows.join(F.broadcast(dead) if n <= FEW_DEAD else dead, ["segment", "doc_id"], "left_anti")

    def _rows(self) -> DataFrame:
        source = ", source string" if self.manifest.source else ""
        return self._live(self._segments("documents", f"doc_id {self.manifest.id_type}, text string{source}"))

    @property
    def documents(self) -> DataFrame:
        return self._rows().drop("segment")

    @property
    def tokens(self) -> DataFrame:
        return self.documents.withColumn("tokens", tokenize(F.col("text"), self.config.ngram)).withColumn("dl", F.size("tokens")).drop("text")

    def stats(self) -> DataFrame:
        """One row: n, avgdl, avg_chars; from the manifest."""
        m = self.manifest
        row = (m.n, m.tokens / m.n if m.n and m.tokens else 1.0, m.chars / m.n if m.n else None)
        return self.spark.createDataFrame([row], "n long, avgdl double, avg_chars double").withColumn("avg_chars", F.round("avg_chars", 1))

    def blocks(self, terms: DataFrame | None = None) -> DataFrame:
        """segment, block, term, docs: blocks of postings, also of dead documents; of the given terms only (with their columns) if there are any."""
        rows = self._segments("blocks", f"block int, term string, docs array<struct<doc_id:{self.manifest.id_type},dl:int,tf:bigint>>, bucket int")
        if terms is None:
            return rows.drop("bucket")
        # the comparison lets Spark prune partitions by the terms that it has broadcast
        asked = stash(terms.withColumn("bucket", self.bucket(F.col("term"))), "asked")
        few = asked.count() <= FEW_TERMS
        asked = asked.where(F.col("term") > "")
        return rows.join(F.broadcast(asked) if few else asked, ["bucket", "term"]).drop("bucket")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """doc_id, dl, term, tf of live documents."""
        blocks = self.blocks(None if terms is None else terms.select("term").distinct())
        return self._live(blocks.select("segment", "term", F.inline("docs"))).select("doc_id", "dl", "term", "tf")

    def frequencies(self, postings: DataFrame | None = None) -> DataFrame:
        rows = self._segments("terms", "term string, df long").select("term", "df")
        dead = self._tombstones("terms")
        if dead is not None:
            rows = rows.unionByName(dead.select("term", (-F.col("df")).alias("df")))
        if len(self.manifest.segments) < 2 and dead is None:
            return rows
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def term_stats(self, postings: DataFrame | None = None) -> DataFrame:
        n, d = F.lit(self.manifest.n), self.config.delta
        return self.frequencies().select("term", "df", F.log(1 + (n - F.col("df") + d) / (F.col("df") + d)).alias("idf"))

    def tfidf_idf(self, postings: DataFrame | None = None) -> DataFrame:
        return self.frequencies().select("term", self._tfidf_weight().alias("w"))

    def _tfidf_weight(self) -> Column:
        return 1 + F.lit(float(max(self.manifest.n, 1))) / (1 + F.col("df"))

    def scores(self, batch: DataFrame) -> DataFrame:
        """query_id, doc_id, score, as in the index above.

        The blocks of the asked terms are dealt by block, where all postings of a document meet: what is shuffled doesn't grow with the
        number of queries.  They are joined with the weights and opened there, and summed in place.
        """
        c = self.config
        avgdl = F.lit(self.manifest.tokens / self.manifest.n if self.manifest.n and self.manifest.tokens else 1.0)
        weighted = batch.select("query_id", "term", "qtf").join(self.term_stats().select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
        weighted = stash(weighted, "weights")
        few = weighted.count() <= FEW_TERMS
        found = self._at_home(self.blocks(weighted.select("term").distinct()))
        rows = found.join(F.broadcast(weighted) if few else weighted, "term").select("segment", "home", "query_id", "w", F.inline("docs"))
        part = F.col("w") * F.col("tf") * (c.k1 + 1) / (F.col("tf") + c.k1 * (1 - c.b + c.b * F.col("dl") / avgdl))
        found = rows.groupBy("home", "segment", "query_id", "doc_id").agg(rounded(F.sum(part)).alias("score"))
        return self._live(found).select("query_id", "doc_id", "score")

    def search(self, batch: DataFrame, k: int = 4) -> DataFrame:
        """query_id, doc_id, score, rank."""
        m = self.manifest
        weighted = batch.select("query_id", "term", "qtf").join(self.term_stats().select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
        dead, marks = self._tombstones("ids"), None
        if dead is not None:
            of = F.create_map(*(F.lit(x) for s in m.segments for x in (s.name, self._blocks_of(s.n_docs))))
            block = F.pmod(F.xxhash64("doc_id"), of[F.col("segment")]).cast("int")
            marks = dead.select("segment", block.alias("block"), "doc_id", F.lit(0.0).alias("x"))
        found = self._ranked(weighted, marks, k, self.config)
        return top(found.where("score > 0"), k).select("query_id", "doc_id", "score", "rank")

    def tfidf_search(self, batch: DataFrame, k: int = 4) -> DataFrame:
        """query_id, doc_id, score, rank by cosine; unseen query terms weigh 1.0 in the query's norm only."""
        weighted = stash(batch.join(self.tfidf_idf(), "term", "left").select("query_id", "term", (F.col("qtf") * F.coalesce("w", F.lit(1.0))).alias("qw"), "w"), "weights")
        q_norm = weighted.groupBy("query_id").agg(F.sqrt(F.sum(F.pow("qw", 2))).alias("q_norm"))
        seen = weighted.where(F.col("w").isNotNull()).join(q_norm, "query_id").select("query_id", "term", (F.col("qw") * F.col("w") / F.col("q_norm")).alias("w"))
        found = self._ranked(seen, self._norms().select("segment", "block", "doc_id", F.col("norm").alias("x")), k, None)
        return top(found, k).select("query_id", "doc_id", "score", "rank")

    def _blocks_of(self, n_docs: int) -> int:
        return max(1, -(-n_docs // self.manifest.block_docs))

    def _at_home(self, rows: DataFrame) -> DataFrame:
        """The rows (segment, block, ..) with home, a number for each block of all segments, dealt evenly by it."""
        first, n = {}, 0
        for s in self.manifest.segments:
            first[s.name], n = n, n + self._blocks_of(s.n_docs)
        start = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))[F.col("segment")] if first else F.lit(0)
        return rows.withColumn("home", (start + F.col("block")).cast("int")).repartitionById(self._tasks(n), "home")

    def _ranked(self, weighted: DataFrame, marks: DataFrame | None, k: int, config: BM25 | None) -> DataFrame:
        """query_id, doc_id, score (rounded): the best documents of each block. weighted: query_id, term, w; marks: segment, block, doc_id, x."""
        m = self.manifest
        kind = f"array<struct<doc_id:{m.id_type},x:double>>"
        weighted = stash(weighted, "weights")
        few = weighted.count() <= FEW_TERMS
        asks = weighted.groupBy("term").agg(F.collect_list(F.struct("query_id", "w")).alias("asks"))
        found = self.blocks(weighted.select("term").distinct()).select("segment", "block", "term", "docs", F.lit(None).cast(kind).alias("marks"))
        if marks is not None:
            by_block = marks.groupBy("segment", "block").agg(F.collect_list(F.struct("doc_id", "x")).cast(kind).alias("marks"))
            none = F.lit(None).cast(found.schema["docs"].dataType)
            found = found.unionByName(by_block.select("segment", "block", F.lit(None).cast("string").alias("term"), none.alias("docs"), "marks"))
        dealt = self._at_home(found).join(F.broadcast(asks) if few else asks, "term", "left")
        schema = f"query_id {weighted.schema['query_id'].dataType.simpleString()}, doc_id {m.id_type}, score double"
        avgdl = m.tokens / m.n if m.n and m.tokens else 1.0
        best = dealt.select("home", "docs", "asks", "marks").groupBy("home").applyInArrow(_best_of_block(k, config, avgdl), schema)
        return best.withColumn("score", rounded(F.col("score")))

    def tfidf_norms(self) -> DataFrame:
        """doc_id, norm; they follow from the whole index, so they are a table of each generation, written when first asked for."""
        return self._norms().select("doc_id", "norm")

    def _norms(self) -> DataFrame:
        """segment, block, doc_id, norm. Squares are summed where blocks are read, before anything is shuffled; only blocks of rare terms meet their weights by a shuffle."""
        at = f"norms/{self.manifest.generation}"
        if not self.folder.exists(f"{at}/_SUCCESS"):
            weights = stash(self.frequencies().select("term", "df", self._tfidf_weight().alias("w")), "idf")
            least = self._common_from(weights)
            common = F.broadcast(weights.where(F.col("df") >= least).select("term", "w"))
            rows = self.blocks().join(common, "term")
            if least > 1:
                rows = rows.unionByName(self.blocks().join(common.select("term"), "term", "left_anti").join(weights.where(F.col("df") < least).select("term", "w"), "term"))
            rows = rows.select("segment", "block", "w", F.inline("docs")).groupBy("segment", "block", "doc_id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("w"), 2))).alias("norm"))
            self._live(rows).select("segment", "block", "doc_id", "norm").write.mode("overwrite").parquet(f"{self.path}/{at}")
        return self.spark.read.parquet(f"{self.path}/{at}")

    def _common_from(self, terms: DataFrame) -> int:
        """The least power of two that at most FEW_TERMS terms have as frequency or more."""
        counts = {r.b: r.n for r in terms.groupBy(F.length(F.bin("df")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        bits, n = max(counts, default=0) + 1, 0
        while bits > 1 and n + counts.get(bits - 1, 0) <= FEW_TERMS:
            bits, n = bits - 1, n + counts.get(bits - 1, 0)
        return 1 << (bits - 1)
