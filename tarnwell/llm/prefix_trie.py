"""Prefix tries of conversations: succinct level-order tries (LOUDS) per prefix shard, upper levels merged apart.

A node is a distinct sequence of first turns (role, text).  Its key is a polynomial hash of its turns' 128-bit hashes, in two words, so that a
conversation's keys are running sums, which need no whole conversation in one place: turns are sorted by range, a task sums its own part,
and what the parts before it hold of a conversation is added afterwards (one row for each part that a conversation goes on in).

Equal keys are summed by Spark into a table of nodes, combined before the shuffle.  A node is heavy if more turns stand in and under it than a shard
should hold; heavy nodes form the upper levels.  Every other subtree hangs under a heavy node or the root; these subtrees are dealt by hash
into prefix shards of about SHARD nodes, each far below what a task can hold.  For a shard numpy orders the nodes by levels,
builds the LOUDS bitvector and the label arrays, and sums leaves and savings in reverse breadth-first order with ``add.at``.  Upper levels get
their sums from the shards' tops: each top and heavy node adds its figures to the heavy nodes on the path of its smallest member.

Defined results: null role and text are empty; a null conv_id is no conversation; null turns stand first, ties are ordered by role, then by
the hash of the text; repeated rows are repeated turns; an empty table gives no nodes, not even a root; conversations without
rows don't exist, those that rebuilding leaves without turns are members of the root; a negative id belongs to the family that the remainder of SQL
(towards zero) gives; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, stash

#: Turns in and under a node beyond which it belongs to the upper levels: the LEAST_SHARDS-th part of all, within these bounds; nodes of a shard.
LEAST_SHARD, MOST_SHARD, LEAST_SHARDS, SHARD = 500, 50_000, 64, 20_000
#: Shared openings have less than this many turns, and every FAMILY conversations have one.
OPENINGS, FAMILY = 6, 100
#: Conversations of which the ids are joined to one text: ids that agree but for so many low bits.
BLOCK_BITS = 13
_B = (np.uint64(0x9E3779B97F4A7C15 | 3), np.uint64(0xD1B54A32D192ED03))
_B_INV = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _B)


def _raised(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponent mod 2**64, by squaring."""
    out, square, e = np.ones(len(exponents), np.uint64), base, exponents.astype(np.int64)
    while e.any():
        out[e & 1 == 1] *= np.uint64(square)
        square, e = square * square % (1 << 64), e >> 1
    return out


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), s1, s2, p1, p2 (sums of hashes up to the turn and before it), n_chars."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    hashes = [F.xxhash64(F.lit(seed), F.length("role"), "role", "text").alias(name) for seed, name in ((1, "h1"), (2, "h2"))]
    slim = stash(turns.select("conv_id", "turn", "role", *hashes, F.length("text").cast("long").alias("n_chars")), "turns")
    # turns that are alike in everything are told apart by their place, so that no conversation stays in one part
    keyed = slim.select("*", F.col("_metadata.row_index").alias("at"))
    order = ["conv_id", "turn", "role", "h1", "h2", "at"]
    parts = keyed.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, pos, sums = None, 0, [np.zeros(1, np.uint64)] * 2  # of the last conversation so far in this part
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            run_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
            going = conv is not None and ids[0] == conv
            place = np.arange(n) - first[run_of] + 1
            place[run_of == 0] += pos if going else 0
            columns = [batch.column(0), pa.array(place)]
            for k in range(2):
                h = batch.column(3 + k).to_numpy().view(np.uint64)
                # within a part a turn counts by its place there; the place in the conversation follows when the parts are put together
                term = h * _raised(int(_B[k]), place)
                total = np.concatenate(([np.uint64(0)], np.cumsum(term, dtype=np.uint64)))
                start = total[first]
                if going:
                    start[:1] -= sums[k]
                up = total[1:] - start[run_of]
                columns += [pa.array(up.view(np.int64)), pa.array((up - term).view(np.int64))]
                sums[k] = up[-1:]
            conv, pos = ids[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([columns[0], columns[1], columns[2], columns[4], columns[3], columns[5], batch.column(5)], names=["conv_id", "pos", "s1", "s2", "p1", "p2", "n_chars"])

    slim_rows = parts.select("conv_id", "turn", "role", "h1", "h2", "n_chars")
    schema = "conv_id long, pos long, s1 long, s2 long, p1 long, p2 long, n_chars long"
    local = stash(slim_rows.mapInArrow(run, schema).withColumn("part", F.spark_partition_id()), "sums")
    ends = local.groupBy("conv_id", "part").agg(F.max("pos").alias("n"), F.max_by(F.struct("s1", "s2"), "pos").alias("s"))
    over = ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"), F.array_sort(F.collect_list(F.struct("part", "n", "s"))).alias("ends")).where("parts > 1")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, c1, c2 = 0, 0, 0
                for x in pieces:
                    out.append((conv_id, x["part"], n, c1, c2))
                    c1 = (c1 + (x["s"]["s1"] % (1 << 64)) * pow(int(_B[0]), n, 1 << 64)) % (1 << 64)
                    c2 = (c2 + (x["s"]["s2"] % (1 << 64)) * pow(int(_B[1]), n, 1 << 64)) % (1 << 64)
                    n += x["n"]
            columns = list(zip(*out)) or [()] * 5
            signed = [np.array(c, np.uint64).view(np.int64) for c in columns[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), *map(pa.array, signed)], names=["conv_id", "part", "n0", "c1", "c2"])

    before = few(stash(over.select("conv_id", "ends").mapInArrow(carry, "conv_id long, part int, n0 long, c1 long, c2 long"), "carries"))
    joined = local.join(before, ["conv_id", "part"], "left").drop("part")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c).fill_null(0).to_numpy()  # noqa: B023, E731
            n0 = get("n0")
            out = [batch.column("conv_id"), pa.array(get("pos") + n0)]
            for c in ("s1", "s2", "p1", "p2"):
                k = int(c[1]) - 1
                out.append(pa.array((get(f"c{c[1]}").view(np.uint64) + get(c).view(np.uint64) * _raised(int(_B[k]), n0)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*out, batch.column("n_chars")], names=["conv_id", "pos", "s1", "s2", "p1", "p2", "n_chars"])

    return stash(joined.mapInArrow(put_together, schema), "numbered")


def opening(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % OPENINGS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, k1, k2, q1, q2, n_chars, size): keys of the node and its parent for every turn of a rebuilt conversation of ``size`` turns; (conv_id, depth, k1, k2): where each one ends."""
    head = F.array_sort(F.collect_list(F.when(F.col("pos") < OPENINGS, F.struct("pos", "s1", "s2", "p1", "p2", "n_chars"))))
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), head.alias("head"))
    own = stash(own.withColumn("h", opening(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY), "openings")
    base = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("lent"))
    zero = F.lit(0).cast("long")
    plan = own.join(base, "base", "left").withColumn("lent", F.slice(F.coalesce("lent", F.expr("slice(head, 1, 0)")), F.lit(1), F.col("h").cast("int")))
    last = lambda a, c: F.when(F.size(a) > 0, F.element_at(a, -1)[c]).otherwise(zero)
    left = F.slice("head", F.lit(1), F.col("h").cast("int"))
    plan = plan.withColumn("left", left).withColumn("m", F.size("lent").cast("long")).select(
        "conv_id", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), zero)).alias("size"), "lent", *(last("lent", f"s{k}").alias(f"a{k}") for k in (1, 2)), *(last("left", f"s{k}").alias(f"l{k}") for k in (1, 2))
    )
    plan = stash(plan, "plans")
    shifted = turns.join(plan.drop("lent"), "conv_id").where(F.col("pos") > F.col("h"))
    schema = "conv_id long, depth long, k1 long, k2 long, q1 long, q2 long, n_chars long, size long"

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy()  # noqa: B023, E731
            back = get("h") - get("m")  # own turns move up by so many places
            out = [batch.column("conv_id"), pa.array(get("pos") - back)]
            for c in ("s1", "s2", "p1", "p2"):
                k = int(c[1]) - 1
                rest = get(c).view(np.uint64) - get(f"l{c[1]}").view(np.uint64)
                out.append(pa.array((get(f"a{c[1]}").view(np.uint64) + rest * _raised(int(_B_INV[k]), back)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*out, batch.column("n_chars"), batch.column("size")], names=["conv_id", "depth", "k1", "k2", "q1", "q2", "n_chars", "size"])

    tails = shifted.mapInArrow(moved, schema)
    heads = plan.select("conv_id", "size", F.explode("lent").alias("x")).select(
        "conv_id", F.col("x.pos").alias("depth"), F.col("x.s1").alias("k1"), F.col("x.s2").alias("k2"), F.col("x.p1").alias("q1"), F.col("x.p2").alias("q2"), F.col("x.n_chars").alias("n_chars"), "size"
    )
    rows = stash(tails.unionByName(heads), "rebuilt")
    ended = rows.where("depth = size").select("conv_id", "depth", "k1", "k2")
    return rows, stash(ended.unionByName(plan.where("size = 0").select("conv_id", F.col("size").alias("depth"), zero.alias("k1"), zero.alias("k2"))), "ends")


# -- tries ------------------------------------------------------------------------------------------------------------


class Louds:
    """Level-order unary degree sequence: of each node, in breadth-first order, a one for each child, then a zero.

    Before them stands ``10`` for a top above node 0, so that node i is the i-th one.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.ones = np.flatnonzero(bits)
        self.zeros = np.flatnonzero(bits == 0)

    @classmethod
    def of_degrees(cls, degree: np.ndarray) -> Louds:
        bits = np.ones(2 + int(degree.sum()) + len(degree), np.uint8)
        bits[1] = 0
        bits[1 + np.cumsum(degree + 1)] = 0
        return cls(bits)

    def __len__(self) -> int:
        return len(self.ones)

    def parents(self) -> np.ndarray:
        """Parent of each node: zeros before its one, less the top's; -1 for node 0."""
        return np.searchsorted(self.zeros, self.ones) - 1

    def degrees(self) -> np.ndarray:
        return np.diff(self.zeros) - 1

    def children(self, i: int) -> tuple[int, int]:
        """First child of node i, and one past the last."""
        begin, end = self.zeros[i] + 1, self.zeros[i + 1]
        return int(begin - i - 1), int(end - i - 1)

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, data: bytes, n_nodes: int) -> Louds:
        return cls(np.unpackbits(np.frombuffer(data, np.uint8))[:2 * n_nodes + 1])


def level_order(level: np.ndarray, own: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Breadth-first order of a forest: places of the nodes, their parents (0 is a top above all), where each level starts.

    own, above: keys (n, 2) of the nodes and of their parents; a parent that isn't there is the top.
    """
    n = len(level)
    both = np.concatenate((own, above))
    by = np.lexsort((both[:, 1], both[:, 0]))
    new = np.concatenate(([True], (both[by[1:]] != both[by[:-1]]).any(1))) if n else np.zeros(0, bool)
    rank = np.empty(2 * n, np.int64)
    rank[by] = np.cumsum(new) - 1
    where = np.full(2 * n, -1)
    where[rank[:n]] = np.arange(n)
    parent = where[rank[n:]]
    deep = np.argsort(level, kind="stable")
    starts = np.searchsorted(level[deep], np.arange(1, int(level.max(initial=0)) + 2))
    number, order, above_of = np.zeros(n, np.int64), [], []
    done = 1
    for a, b in zip(starts, starts[1:]):
        at = deep[a:b]
        up = np.where(parent[at] < 0, 0, number[parent[at]])
        sort = np.lexsort((own[at, 1], own[at, 0], up))
        at, up = at[sort], up[sort]
        number[at] = np.arange(done, done + len(at))
        done += len(at)
        order.append(at)
        above_of.append(up)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *order]), np.concatenate([none, *above_of]), starts


TRIE = (
    "shard long, n_nodes long, louds binary, k1 array<long>, k2 array<long>, conv_id array<long>, depth array<long>, parent_conv_id array<long>, n_convs array<long>, n_children array<long>, "
    "n_leaves array<long>, saved_tokens array<long>, top array<boolean>"
)


def trie_of(shard: pa.Table) -> pa.Table:
    """One row, the trie of a prefix shard: bitvector and arrays by node, in breadth-first order without the top."""
    get = lambda c: shard.column(c).to_numpy()
    own, above = np.stack((get("k1"), get("k2")), 1), np.stack((get("q1"), get("q2")), 1)
    order, parent, starts = level_order(get("depth") - get("over"), own, above)
    n = len(order)
    degree = np.bincount(parent, minlength=n + 1)
    louds = Louds.of_degrees(degree)
    parents = louds.parents()[1:]
    leaves = np.concatenate(([0], (degree[1:] == 0).astype(np.int64)))
    convs, chars = get("n_convs")[order], get("n_chars")[order]
    saved = np.concatenate(([0], (convs - 1) * chars))
    for a, b in zip(starts[-2::-1], starts[:0:-1]):  # levels from the lowest up: a level's sums are whole before they go up
        for sums in (leaves, saved):
            np.add.at(sums, parents[a:b], sums[a + 1:b + 1])
    ids = get("conv_id")[order]
    inner = parents > 0
    up = pa.array(np.where(inner, ids[np.maximum(parents - 1, 0)], 0), mask=~inner)
    arrays = {
        "shard": shard.column("shard")[:1].to_numpy(), "n_nodes": [n + 1], "louds": [louds.packed()], "k1": [own[order, 0]], "k2": [own[order, 1]], "conv_id": [ids], "depth": [get("depth")[order]], "parent_conv_id": [up],
        "n_convs": [convs], "n_children": [degree[1:]], "n_leaves": [leaves[1:]], "saved_tokens": [saved[1:]], "top": [~inner],
    }
    out = []
    for name, values in arrays.items():
        if name in ("shard", "n_nodes", "louds"):
            out.append(pa.array(values, {"shard": pa.int64(), "n_nodes": pa.int64(), "louds": pa.binary()}[name]))
        else:
            flat = values[0] if isinstance(values[0], pa.Array) else pa.array(values[0], pa.bool_() if name == "top" else pa.int64())
            out.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
    return pa.Table.from_arrays(out, names=list(arrays))


def find(trie: dict, keys: list[tuple[int, int]]) -> int:
    """Node of a stored trie (a row of TRIE) that has this path of keys below its top, or -1: a binary search among the children of each node."""
    louds, node = Louds.unpacked(trie["louds"], trie["n_nodes"]), 0
    for key in keys:
        lo, hi = louds.children(node)
        labels = list(zip(trie["k1"][lo - 1:hi - 1], trie["k2"][lo - 1:hi - 1]))
        at = int(np.searchsorted([x[0] for x in labels], key[0])) if labels else 0
        while at < len(labels) and labels[at][0] == key[0] and labels[at] != key:
            at += 1
        if at == len(labels) or labels[at] != key:
            return -1
        node = lo + at
    return node


class Tries:
    """The tries of a table of conversations (conv_id, turn, role, text), after rebuilding; tables in the shared folder.

    ``tries``: rows of TRIE, one for each shard; ``upper``: the heavy nodes and the root with their figures; ``ends``: conv_id and the key of the
    node at which it ends.
    """

    def __init__(self, conversations: DataFrame, most: int = 0, shard: int = SHARD):
        rows, self.ends = rebuilt(numbered(conversations))
        total = rows.count()
        most = most or min(MOST_SHARD, max(LEAST_SHARD, total // LEAST_SHARDS))
        nodes = rows.groupBy("k1", "k2", "depth").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("size") - F.col("depth") + 1).alias("under"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("n_chars").alias("n_chars")
        )
        nodes = stash(nodes, "nodes")
        heavy = stash(nodes.where(F.col("under") > most), "heavy")
        keys = ["k1", "k2", "depth"]
        on_heavy = rows.join(few(heavy.select(*keys)), keys, "left_semi").select("conv_id", *keys)
        over = stash(on_heavy.groupBy("conv_id").agg(F.max("depth").alias("over")), "over")
        tops = rows.join(few(over), "conv_id", "left").withColumn("over", F.coalesce("over", F.lit(0).cast("long"))).where("depth = over + 1")
        n_shards = max(LEAST_SHARDS, -(-total // shard))
        dealt = tops.select("conv_id", "over", F.pmod(F.xxhash64("k1", "k2"), F.lit(n_shards)).alias("shard"))
        light = stash(nodes.where(F.col("under") <= most).join(dealt, "conv_id"), "light")
        self._parents = light.where("depth = over + 1").select(*keys, "q1", "q2")
        self.tries = stash(light.groupBy("shard").applyInArrow(trie_of, TRIE), "tries")
        self.upper = self._upper(heavy, on_heavy)

    def nodes(self) -> DataFrame:
        """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, k1, k2 of every node."""
        below = self._below()
        above = self.upper.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up"))
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "k1", "k2"]
        tops = below.where("top").join(few(self._parents), ["k1", "k2", "depth"]).join(few(above), ["q1", "q2", "depth"])
        tops = tops.withColumn("parent_conv_id", F.col("up"))
        return below.where("not top").select(*names).unionByName(tops.select(*names)).unionByName(self.upper.select(*names))

    def _below(self) -> DataFrame:
        names = ["k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "top"]
        return self.tries.select(F.explode(F.arrays_zip(*names)).alias("x")).select("x.*")

    def _upper(self, heavy: DataFrame, on_heavy: DataFrame) -> DataFrame:
        keys = ["k1", "k2", "depth"]
        figures = stash(self._below().where("top").select(*keys, "conv_id", "n_leaves", "saved_tokens"), "tops")
        up = self._parents.unionByName(heavy.select(*keys, "q1", "q2"))
        children = up.groupBy("q1", "q2", (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"q1": "k1", "q2": "k2"})
        zero = F.lit(0).cast("long")
        heavy = stash(heavy.join(children, keys, "left").withColumn("n_children", F.coalesce("n_children", zero)), "upper")
        own = heavy.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
        items = figures.select("conv_id", "depth", "n_leaves", "saved_tokens").unionByName(own)
        # items of a smallest member count for the heavy nodes on its path that stand at or above them
        path = on_heavy.join(items.select("conv_id").distinct(), "conv_id", "left_semi")
        both = path.select("conv_id", *keys, zero.alias("n_leaves"), zero.alias("saved_tokens"), F.lit(1).alias("node")).unionByName(
            items.groupBy("conv_id", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).select("conv_id", zero.alias("k1"), zero.alias("k2"), "depth", "n_leaves", "saved_tokens", F.lit(0).alias("node"))
        )
        w = Window.partitionBy("conv_id").orderBy(F.desc("depth"), "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = both.select("node", *keys, F.sum("n_leaves").over(w).alias("n_leaves"), F.sum("saved_tokens").over(w).alias("saved_tokens")).where("node = 1")
        rolled = summed.groupBy(*keys).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        parents = heavy.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "k1", "k2"]
        inner = heavy.join(rolled, keys).join(parents, ["q1", "q2", "depth"], "left")
        root = self.ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
        first = children.where("depth = 0").select("n_children")
        total = items.agg(F.coalesce(F.sum("n_leaves"), F.lit(1).cast("long")).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"))
        one = lambda df, c: F.coalesce(df.agg(F.max(c)).scalar(), zero)
        root = root.select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", one(first, "n_children").alias("n_children"), one(total, "n_leaves").alias("n_leaves"), one(total, "saved_tokens").alias("saved_tokens"), zero.alias("k1"), zero.alias("k2"))
        # a heavy node's parent is heavy, or the root
        inner = inner.withColumn("parent_conv_id", F.when(F.col("depth") == 1, root.agg(F.max("conv_id")).scalar()).otherwise(F.col("parent_conv_id")))
        return stash(inner.select(*names).unionByName(root.select(*names)), "upper-levels")

    def end_digests(self) -> DataFrame:
        """k1, k2, depth, ends_sha256 of the nodes at which conversations end: SHA-256 of their ids, ascending, joined by commas.

        Ids that agree but for their low bits are one text, so that a group is bounded; only the digest of several texts is sequential, read as a stream.
        """
        keys = ["k1", "k2", "depth"]
        ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
        texts = self.ends.groupBy(*keys, F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(ids, ",").alias("ids"))
        texts = stash(texts, "end-ids")
        several = stash(texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").drop("blocks"), "several")
        single = texts.join(few(several), keys, "left_anti").select(*keys, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
        rest = texts.join(few(several), keys, "left_semi").repartition(*keys).sortWithinPartitions(*keys, "block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state = None, None
            for batch in batches:
                done = []
                for k1, k2, depth, ids in zip(*(batch.column(c).to_pylist() for c in (*keys, "ids"))):
                    if now != (k1, k2, depth):
                        if now:
                            done.append((*now, state.hexdigest()))
                        now, state = (k1, k2, depth), hashlib.sha256()
                    else:
                        state.update(b",")
                    state.update(ids.encode())
                if done:
                    yield _digests(done)
            if now:
                yield _digests([(*now, state.hexdigest())])

        return single.unionByName(rest.mapInArrow(run, "k1 long, k2 long, depth long, ends_sha256 string"))


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["k1", "k2", "depth", "ends_sha256"])
