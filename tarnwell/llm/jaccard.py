"""Similarity join on word shingles by signature trees: exact links, and the components that they make.

1.  Each text becomes its set of hashed shingles.  Texts with the same set are one node, named by a hash of the set.
2.  Sets that can link.  A set of n members links at similarity t only if at most (1 - t) n of its members stand in no other
    set.  Tokens are dealt by ranges of their hashes, as packed arrays; a token that a chunk of texts has several times is
    known to be shared and sent once, so a token of a third of all texts is a few rows.  Only one text of each set takes part, as
    the tokens of a text that has copies in other tasks would all seem shared.  The first pass counts over a
    share of all tokens chosen by hash (PROBE times 1 - t), the second over all tokens of what is left.  Either can
    only leave out sets that link with nothing.
3.  Groups.  Two linked sets of which the larger has n members share one of their n - ceil(t n) + 1 first tokens in any
    order of all tokens; the order here is by a sketch of frequencies, rarest first, so that passages which many texts
    share come last (the sketch only changes how large groups get, not what links).  Sets that share a first token
    are in one group, so no link is between groups.
4.  Signature trees.  A group's sets are cut into leaves of at most about LEAF sets, sets with the same least token
    together, and ordered by likeness; nodes hold the OR of their members' token bitmaps and the range of their sizes.
    Bitmaps have bits in proportion to the group's sets.  Traversing two trees together drops pairs of nodes,
    then of sets, whose maximum possible overlap is too small, and pairs that are connected already; what remains is
    compared exactly.  For a group of several leaves, each leaf is linked first, then one set of each component that the
    leaves found (again in leaves, until that no longer helps).  Groups that are one component by then are
    done; in the others pairs of leaves are traversed over their tops, then, in tiles of TILE by TILE leaves, over their sets'
    bitmaps.  Of two components' sets that may link, the CANDIDATES pairs with most in common in a tile are compared; all pairs
    are only where none of these links and nothing else connects the two.
5.  Links make components; every text gets the least id of its component.

Equal sets are never expanded into pairs, and a near copy is compared until it is connected.

Defined results: null text, empty text and text without words have an empty set and link with nothing; fewer words than
the width make one shingle of the whole sequence; null ids are kept and link like others, with a null component unless a
linked text has an id; repeated rows are texts with the same set; ties need no rule, as the least id is unique; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, blocks, few, joined_hashes, lowered, mixed, row_key, run_starts, small_batches, span_hashes, stash, text_bytes, word_spans
from .components import components, spanning

#: Sets of a leaf, sets of a lowest node, children of a node.
LEAF, BLOCK, FANOUT = 512, 16, 8
#: Leaves of a side of a tile, and pairs of sets compared at first for two components that meet in it.
TILE, CANDIDATES = 8, 8
#: Pairs of components that a tile holds before it hands them on.
_HELD = 100_000
#: Bits of a bitmap for each member of a set: enough that nodes over unlike families have few bits in common.
BITS = 16
#: Share of all tokens that the first pass looks at, as a multiple of 1 - t.
PROBE = 2.5
#: Tokens that a task holds before it deals them out, and tokens of one range of hashes.
CHUNK, PART = 2_000_000, 1_000_000
#: Counters of the sketch of frequencies.
SKETCH = 1 << 19
_MOST_BITS = 1 << 17
_SHARED = np.uint16(65535)


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted in each text, and the offsets of the texts."""
    data = lowered(data)
    begin, end, row = word_spans(data, starts)
    words = span_hashes(data, begin, end)
    rows = len(starts) - 1
    runs = joined_hashes(words, width)
    at = np.searchsorted(row, np.arange(rows + 1))
    inside = row[:len(runs)] == row[width - 1:]
    owner, found = row[:len(runs)][inside], runs[inside]
    short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < width))
    if len(short):
        whole = np.concatenate([joined_hashes(words[at[i]:at[i + 1]], int(at[i + 1] - at[i])) for i in short])
        owner, found = np.concatenate((owner, short)), np.concatenate((found, whole))
    if len(short):
        order = np.argsort(owner, kind="stable")
        owner, found = owner[order], found[order]
    cuts = np.searchsorted(owner, np.arange(rows + 1)).tolist()
    for i, j in zip(cuts[:-1], cuts[1:]):
        found[i:j].sort()
    if len(found):
        keep = np.concatenate(([True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])))
        owner, found = owner[keep], found[keep]
    return found, np.searchsorted(owner, np.arange(rows + 1))


def separate(members: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return [members[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def set_names(members: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set, as a signed 64-bit number."""
    return mixed(_sums(mixed(members), offsets) + np.diff(offsets).astype(np.uint64)).astype(np.int64)


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows [i, j) of a column of texts, with the members and offsets of their sets."""
    data, offsets = text_bytes(column)
    for i, j in blocks(offsets):
        yield (i, j, *shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], width))


def describe(documents: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, key, node, lead, n_shingles of each text: key names the row, node its set; lead is the set's least token."""
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), row_key(id_col, text_col).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, members, cuts in sets_of(batch.column(1), width):
                lead = np.zeros(j - i, np.int64)
                lead[np.diff(cuts) > 0] = members[cuts[:-1][np.diff(cuts) > 0]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(set_names(members, cuts)), pa.array(lead), pa.array(np.diff(cuts))],
                                                 names=["id", "key", "node", "lead", "n_shingles"])

    return rows.mapInArrow(run, "id long, key long, node long, lead long, n_shingles long")


# ---- sets that can link ---------------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], width: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names of different sets, their tokens below the share, and the place of the set of each; CHUNK tokens or so at once."""
    least = np.uint64(min(share, 1.0) * 2**32)
    seen: dict[int, int] = {}
    tokens, owners, size = [], [], 0

    def whole():
        return np.fromiter(seen, np.int64, len(seen)), np.concatenate(tokens), np.concatenate(owners)

    for batch in batches:
        for _, _, members, cuts in sets_of(batch.column(0), width):
            names, sizes = set_names(members, cuts).tolist(), np.diff(cuts)
            place = np.full(len(names), -1)
            for k, name in enumerate(names):
                if sizes[k] and name not in seen:
                    place[k] = seen[name] = len(seen)
            owner = np.repeat(place, sizes)
            taken = (owner >= 0) & ((mixed(members ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) < least)
            tokens.append(members[taken])
            owners.append(owner[taken])
            size += int(taken.sum())
            if size >= CHUNK or len(seen) >= 60_000:
                yield whole()
                seen, tokens, owners, size = {}, [], [], 0
    if seen:
        yield whole()


def _deal(width: int, share: float, parts: int):
    """chunk, part, tokens, who: a chunk's tokens by range of hashes; nodes: the names of its sets, in a row of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for names, tokens, owner in _chunks(batches, width, share):
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            first = run_starts(tokens)
            many = np.diff(np.append(first, len(tokens))) > 1
            who = np.where(many, _SHARED, owner[first].astype(np.uint16))
            tokens = tokens[first]
            cuts = np.searchsorted(((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cuts))
            low = tokens.astype(np.uint32)
            rows = [(chunk, int(p), low[cuts[p]:cuts[p + 1]].tobytes(), who[cuts[p]:cuts[p + 1]].tobytes(), None) for p in full]
            rows.append((chunk, parts + chunk % 9973, None, None, names.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["chunk", "part", "tokens", "who", "nodes"])
            chunk += 1

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each key of sorted batches."""
    last, held = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
            now = row[key].as_py()
            if held and now != last:
                yield last, held
                held = []
            last = now
            held.append(row)
    if held:
        yield last, held


def _numbers(value: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _alone(parts: int):
    """For each chunk, the places of its sets that have a token which stands in no other set, once a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _runs(batches, "part"):
            if part >= parts:
                out = [(r["chunk"].as_py(), None, r["nodes"].as_py()) for r in rows]
            else:
                tokens, who = (np.concatenate([_numbers(r[c], k) for r in rows]) for c, k in (("tokens", np.uint32), ("who", np.uint16)))
                source = np.repeat(np.arange(len(rows)), [len(_numbers(r["who"], np.uint16)) for r in rows])
                order = np.argsort(tokens)
                first = run_starts(tokens[order])
                one = order[first[np.diff(np.append(first, len(tokens))) == 1]]
                one = np.sort(one[who[one] != _SHARED])
                cuts = np.searchsorted(source[one], np.arange(len(rows) + 1))
                out = [(r["chunk"].as_py(), who[one[a:b]].tobytes(), None) for r, a, b in zip(rows, cuts[:-1], cuts[1:]) if b > a]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "alone", "nodes"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, alone: a chunk's sets with tokens of their own, and how many."""
    for _, rows in _runs(batches, "chunk"):
        names = next(_numbers(r["nodes"], np.int64) for r in rows if r["nodes"].is_valid)
        count = np.zeros(len(names), np.int64)
        for r in rows:
            if r["alone"].is_valid:
                count += np.bincount(_numbers(r["alone"], np.uint16), minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[count > 0]), pa.array(count[count > 0])], names=["node", "alone"])


def own_tokens(texts: DataFrame, width: int, share: float, total: int) -> DataFrame:
    """node, alone: how many tokens (of the share) of a set surely stand in no other set. texts: one column."""
    parts = max(1, -(-int(total * min(share, 1.0)) // PART))
    dealt = texts.mapInArrow(_deal(width, share, parts), "chunk long, part long, tokens binary, who binary, nodes binary")
    alone = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_alone(parts), "chunk long, alone binary, nodes binary")
    counted = alone.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_counted, "node long, alone long")
    return counted.groupBy("node").agg(F.sum("alone").alias("alone"))


def may_have_links(sets: DataFrame, alone: DataFrame, num: int, den: int) -> DataFrame:
    """The sets (node, n, ...) that can link."""
    return sets.join(alone, "node", "left").where(F.coalesce("alone", F.lit(0)) * den <= (den - num) * F.col("n")).drop("alone")


# ---- groups ---------------------------------------------------------------------------------------------------------


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (mixed(tokens ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(SKETCH)).astype(np.int64)


def frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """SKETCH counters of how many sets have a token; tokens that share a counter add up. texts: one column."""
    slices = 16
    size = SKETCH // slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, members, _ in sets_of(batch.column(0), width):
                count += np.bincount(_slot(members), minlength=SKETCH)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([count[k * size:(k + 1) * size].tobytes() for k in range(slices)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + _numbers(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    found = texts.mapInArrow(run, "slice int, counts binary").repartition("slice").mapInArrow(add, "slice int, counts binary")
    out = np.zeros(SKETCH, np.int64)
    for k, counts in found.collect():
        out[k * size:(k + 1) * size] = np.frombuffer(counts, np.int64)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges that connect the nodes of each key, without a cycle; then the keys and their least nodes."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = run_starts(key)
    least = np.repeat(node[first], np.diff(np.append(first, len(key))))
    return *spanning(least, node), key[first], node[first]


def first_tokens(texts: DataFrame, counts: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """Rows (token null, a, b): sets that share a first token here; (token, a): a token with its least set here."""
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            a, b, token, least = _stars(*(np.concatenate(x) for x in zip(*held)))
            none, more = pa.nulls(len(a), pa.int64()), pa.nulls(len(token), pa.int64())
            join = lambda x, y: pa.concat_arrays([x, y])
            return pa.RecordBatch.from_arrays([join(none, pa.array(token)), join(pa.array(a), pa.array(least)), join(pa.array(b), more)], names=["token", "a", "b"])

        for batch in batches:
            for _, _, members, cuts in sets_of(batch.column(0), width):
                n = np.diff(cuts)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((members, sent.value[_slot(members)], owner))
                place = np.arange(len(members)) - np.repeat(cuts[:-1], n)
                taken = place < np.repeat(n - (n * num + den - 1) // den + 1, n)
                held.append((members[order[taken]].astype(np.int64), set_names(members, cuts)[owner[taken]]))
                size += int(taken.sum())
                if size >= CHUNK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, "token long, a long, b long")


def _joined_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: edges that connect each token's nodes; batches are sorted by token."""
    last: tuple[int, int] | None = None  # the last token so far and one of its nodes
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            key, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if last is not None:
                key, node = np.concatenate(([last[0]], key)), np.concatenate(([last[1]], node))
            x, y, keys, least = _stars(key, node)
            last = int(key[-1]), int(least[np.searchsorted(keys, key[-1])])
            a, b = np.concatenate((a, x)), np.concatenate((b, y))
            if len(a) > CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in spanning(a, b)], names=["a", "b"])
                a, b = a[:0], b[:0]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in spanning(a, b)], names=["a", "b"])


def candidate_edges(texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """a, b: edges whose components are the groups. texts: one column."""
    found = stash(first_tokens(texts, frequencies(texts, width), width, num, den), "tokens")
    tokens = found.where("token is not null").select("token", "a").repartition("token").sortWithinPartitions("token", "a")
    return found.where("token is null").select("a", "b").unionByName(tokens.mapInArrow(_joined_stars, "a long, b long"))


# ---- signature trees ----------------------------------------------------------------------------------------------


class Node:
    """Sets below it: OR of their bitmaps, least and greatest size, most members that share a bit in a set, one label or None."""

    __slots__ = ("bits", "low", "high", "slack", "label", "children", "item")

    def __init__(self, bits, low, high, slack, label=None, children=(), item=None):
        self.bits, self.low, self.high, self.slack, self.label, self.children, self.item = bits, low, high, slack, label, children, item

    @classmethod
    def over(cls, children: list[Node]) -> Node:
        labels = {c.label for c in children}
        return cls(np.bitwise_or.reduce([c.bits for c in children]), min(c.low for c in children), max(c.high for c in children), max(c.slack for c in children),
                   labels.pop() if len(labels) == 1 else None, children)


def tree(level: list[Node]) -> Node:
    """Lowest nodes in their order, FANOUT children a node."""
    while len(level) > 1:
        level = [Node.over(level[i:i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return level[0]


def may_link(a: Node, b: Node, num: int, den: int) -> bool:
    """Whether a set below a and one below b can reach the similarity: sizes, then the maximum possible overlap."""
    if a.high * den < b.low * num or b.high * den < a.low * num:
        return False
    overlap = int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.slack, b.slack)
    return overlap * (num + den) >= num * (a.low + b.low)


def traverse(a: Node, b: Node, num: int, den: int, dropped: Callable[[Node, Node], None] | None = None) -> Iterator[tuple[Node, Node]]:
    """Pairs of lowest nodes below a and b that may link and have not one label. Each unordered pair once if a is b."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x.label is not None and x.label == y.label:
            continue
        if not may_link(x, y, num, den):
            if dropped:
                dropped(x, y)
        elif x is y and x.children:
            for i, p in enumerate(x.children):
                stack.extend((p, q) for q in x.children[i:])
        elif not x.children and not y.children:
            yield x, y
        elif len(y.children) > len(x.children) or not x.children:
            stack.extend((x, q) for q in y.children)
        else:
            stack.extend((p, y) for p in x.children)


def n_bits(size: float) -> int:
    """Bits of the bitmaps of sets of about this size: BITS a member, rounded up to a power of two."""
    return min(_MOST_BITS, 1 << max(8, int(BITS * size - 1).bit_length()))


class Sets:
    """Sets in order of likeness: names, sizes, bitmaps, the members that share a bit in each, and labels."""

    def __init__(self, names: np.ndarray, sizes: np.ndarray, bits: np.ndarray, slack: np.ndarray, labels: np.ndarray):
        self.names, self.sizes, self.bits, self.slack, self.labels = names, sizes, bits, slack, labels
        self.root: Node | None = None

    @classmethod
    def of(cls, names: list[int], sets: list[np.ndarray], width: int, labels: list[int] | None = None) -> Sets:
        bits = np.zeros((len(sets), width // 8), np.uint8)
        for i in range(0, len(sets), BLOCK):
            some = sets[i:i + BLOCK]
            flags = np.zeros((len(some), width), np.uint8)
            flags[np.repeat(np.arange(len(some)), [len(x) for x in some]), (np.concatenate(some) & np.uint64(width - 1)).astype(np.int64)] = 1
            bits[i:i + len(some)] = np.packbits(flags, axis=1)
        sizes, bits = np.array([len(x) for x in sets], np.int64), bits.view(np.uint64)
        return cls(np.array(names, np.int64), sizes, bits, sizes - np.bitwise_count(bits).sum(1, dtype=np.int64), np.array(names if labels is None else labels, np.int64))

    def tree(self) -> Node:
        """Lowest nodes are blocks of BLOCK sets."""
        if self.root is not None:
            return self.root
        level = []
        for i in range(0, len(self.names), BLOCK):
            part = slice(i, min(len(self.names), i + BLOCK))
            size, label = self.sizes[part], self.labels[part]
            level.append(Node(np.bitwise_or.reduce(self.bits[part]), int(size.min()), int(size.max()), int(self.slack[part].max()), int(label[0]) if len(label) > 1 and (label == label[0]).all() else None, (), (part.start, part.stop)))
        self.root = tree(level)
        return self.root

    def close(self, other: Sets, num: int, den: int) -> Iterator[tuple[int, int]]:
        """Places of the sets here and there that may link, by traversing both trees together."""
        for i, j, _ in self.near(other, num, den):
            yield from zip(i.tolist(), j.tolist())

    def near(self, other: Sets, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same in arrays, with the greatest possible share of common members."""
        root = self.tree()
        for x, y in traverse(root, root if other is self else other.tree(), num, den):
            (a, b), (c, d) = x.item, y.item
            size, there = self.sizes[a:b, None], other.sizes[None, c:d]
            overlap = np.bitwise_count(self.bits[a:b, None] & other.bits[None, c:d]).sum(2, dtype=np.int64) + np.minimum(self.slack[a:b, None], other.slack[None, c:d])
            near = (size * den >= there * num) & (there * den >= size * num) & (overlap * (num + den) >= num * (size + there)) & (self.labels[a:b, None] != other.labels[None, c:d])
            i, j = np.nonzero(np.triu(near, 1) if x is y else near)
            if len(i):
                yield a + i, c + j, (overlap / (size + there))[i, j]


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int(np.count_nonzero(y[at] == x))
    return both * den >= num * (len(x) + len(y) - both)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def _leaf_sets(batch: pa.Table, width: int) -> tuple[list[int], list[np.ndarray], dict[int, int]]:
    """Names and sets of a leaf in order of likeness, and the label of each name."""
    by_name, labels = {}, {}
    given = batch["label"].to_pylist() if "label" in batch.column_names else batch["node"].to_pylist()
    for i, j, members, cuts in sets_of(batch["t"].combine_chunks(), width):
        for name, label, one in zip(set_names(members, cuts).tolist(), given[i:j], separate(members, cuts)):
            by_name[name], labels[name] = one, label
    names = sorted(by_name, key=lambda x: (*by_name[x][:2].tolist(), len(by_name[x]), x))
    return names, [by_name[x] for x in names], labels


def _leaf_links(width: int, num: int, den: int):
    """Links that span the components inside a leaf (a, b), and one set of each component (a, b null)."""

    def run(batch: pa.Table) -> pa.Table:
        grp = batch["grp"][0].as_py()
        names, sets, _ = _leaf_sets(batch, width)
        forest, rows = Forest(len(names)), []
        own = Sets.of(names, sets, n_bits(np.mean([len(x) for x in sets])))
        for i, j in own.close(own, num, den):  # pairs that are connected already aren't compared
            if forest.root(i) != forest.root(j) and linked(sets[i], sets[j], num, den):
                forest.join(i, j)
                rows.append((grp, names[i], names[j]))
        rows.extend((grp, names[i], None) for i in range(len(names)) if forest.root(i) == i)
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=["grp", "a", "b"])

    return run


_SUMMARY_SCHEMA = "grp long, leaf long, low long, high long, slack long, one long, top binary, names binary, sizes binary, slacks binary, labels binary, bitmaps binary"
_SUMMARY = ("names", "sizes", "slacks", "labels", "bitmaps")


def _summaries(width: int):
    """A leaf's top node, and its sets' names, sizes, labels and bitmaps."""

    def run(batch: pa.Table) -> pa.Table:
        names, sets, labels = _leaf_sets(batch, width)
        own = Sets.of(names, sets, batch["bits"][0].as_py(), [labels[x] for x in names])
        top = own.tree()
        row = (batch["grp"][0].as_py(), batch["leaf"][0].as_py(), top.low, top.high, top.slack, top.label, top.bits.tobytes(), *(x.tobytes() for x in (own.names, own.sizes, own.slack, own.labels, own.bits)))
        return pa.table([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row], names=[x.split()[0] for x in _SUMMARY_SCHEMA.split(", ")])

    return run


def _tiles(num: int, den: int):
    """The tiles that each leaf of a group is needed in, from the top nodes alone: those in which it may link with another leaf."""

    def run(batch: pa.Table) -> pa.Table:
        rows = sorted(batch.to_pylist(), key=lambda r: r["leaf"])
        tops = [Node(np.frombuffer(r["top"], np.uint64), r["low"], r["high"], r["slack"], r["one"], (), (r["leaf"], k // TILE)) for k, r in enumerate(rows)]
        root, out = tree(tops), set()
        for x, y in traverse(root, root, num, den):
            if x is not y:
                tile = sorted((x.item[1], y.item[1]))
                out |= {(*x.item, *tile), (*y.item, *tile)}
        grp = pa.array([rows[0]["grp"]] * len(out), pa.int64())
        return pa.table([grp, *(pa.array([r[k] for r in out], pa.int64()) for k in range(4))], names=["grp", "leaf", "tile", "tile_a", "tile_b"])

    return run


def _close_sets(num: int, den: int, most: int):
    """Sets of a tile's leaves that may link, from their bitmaps: of two labels the ``most`` pairs with most in common (0: all); cut where there were more."""

    def run(batch: pa.Table) -> pa.Table:
        rows, out = batch.to_pylist(), []
        best: dict[tuple[int, int], list] = {}
        over: set[tuple[int, int]] = set()

        def hand_on() -> None:
            out.extend((rows[0]["grp"], a, b, labels in over) for labels, pairs in best.items() for _, a, b in pairs)
            best.clear()
            over.clear()

        leaves = []
        for r in rows:
            names, sizes, slack, labels = (np.frombuffer(r[c], np.int64) for c in _SUMMARY[:4])
            leaves.append((r["tile"], Sets(names, sizes, np.frombuffer(r["bitmaps"], np.uint64).reshape(len(sizes), -1), slack, labels)))
        one = rows[0]["tile_a"] == rows[0]["tile_b"]
        for k, (tile, x) in enumerate(leaves):
            for other, y in leaves[k + 1:]:
                if not one and tile == other:
                    continue
                for i, j, share in x.near(y, num, den):
                    for a, b, p, q, c in zip(x.names[i].tolist(), y.names[j].tolist(), x.labels[i].tolist(), y.labels[j].tolist(), share.tolist()):
                        labels = (p, q) if p < q else (q, p)
                        held = best.setdefault(labels, [])
                        if not most or len(held) < most:
                            heapq.heappush(held, (c, a, b))
                        else:
                            over.add(labels)
                            heapq.heappushpop(held, (c, a, b))
                if len(best) > _HELD:
                    hand_on()
        hand_on()
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["grp", "a", "b", "cut"])

    return run


def _verified(width: int, num: int, den: int):
    """The pairs (grp, a, b, cut, t_a, t_b), with whether their texts link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([one for _, _, members, cuts in sets_of(batch.column(c), width) for one in separate(members, cuts)] for c in (4, 5))
            yes = pa.array([len(p) > 0 and len(q) > 0 and linked(p, q, num, den) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], yes], names=["grp", "a", "b", "cut", "linked"])

    return run


def in_leaves(members: DataFrame, lead: str = "lead") -> DataFrame:
    """members (grp, node, lead, ...) with leaf: sets of a lead together, many leads in one leaf, a frequent lead in several.

    Only groups of more than LEAF sets are cut; they and their frequent leads are few, so members don't meet by group.
    """
    large = few(stash(members.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LEAF), "large"))
    spread = members.join(large, "grp", "left")
    often = spread.where("m is not null").groupBy("grp", lead).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max(1, LEAF // 4))
    deep = F.ceil(F.col("c") / F.lit(LEAF))
    light = F.pmod(F.xxhash64(lead), F.ceil(F.col("m") / F.lit(max(1, LEAF // 2))))
    heavy = F.xxhash64("grp", lead, F.pmod(F.xxhash64("node"), deep))
    leaf = F.when(F.col("m").isNull(), F.lit(0).cast("long")).when(F.col("c").isNotNull(), heavy).otherwise(F.xxhash64("grp", light))
    return spread.join(few(stash(often, "often")), ["grp", lead], "left").withColumn("leaf", leaf).withColumn("several", F.col("m").isNotNull()).drop("m", "c")


def _by_leaf(members: DataFrame, n: int) -> DataFrame:
    """Leaves dealt to a number of tasks that follows from the sets, as small tables may hold much work."""
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // (2 * LEAF)))
    return members.repartition(tasks, "grp", "leaf")


def group_links(held: DataFrame, groups: DataFrame, sets: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """a, b: links that span the components of all groups. held: node, t; groups: node, label; sets: node, n, lead."""
    placed = stash(in_leaves(groups.withColumnRenamed("label", "grp").join(sets.select("node", "n", "lead"), "node")), "leaves")
    n = placed.count()
    texts = stash(held.join(few(placed), "node"), "members")
    found = stash(_by_leaf(texts.select("grp", "leaf", "node", "t"), n).groupBy("grp", "leaf").applyInArrow(_leaf_links(width, num, den), "grp long, a long, b long"), "links")
    links = found.where("b is not null").select("a", "b")
    large = placed.where("several").select("grp").distinct()
    if not large.limit(1).count():
        return links
    large = stash(large, "large")
    reps = found.where("b is null").join(large, "grp").select("grp", F.col("a").alias("node"))
    before = placed.where("several").count()
    while (now := reps.count()) < 0.9 * before:  # one set of each component, until this no longer connects much
        again = stash(in_leaves(reps.withColumn("lead", F.xxhash64(F.col("node"), F.lit(now)))), "reps")
        joined = again.select("grp", "leaf", "node").join(texts.select("node", "t"), "node")
        found = stash(_by_leaf(joined, now).groupBy("grp", "leaf").applyInArrow(_leaf_links(width, num, den), "grp long, a long, b long"), "links")
        links = links.unionByName(found.where("b is not null").select("a", "b"))
        reps, before = found.where("b is null").select("grp", F.col("a").alias("node")), now
    tried = None
    for most in (CANDIDATES, 0):
        known = components(links)
        if tried is not None:  # groups where components that may link have only been compared in part
            side = lambda c: known.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
            left = tried.where("cut and not linked").join(side("a"), "a", "left").join(side("b"), "b", "left")
            large = stash(left.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("grp").distinct(), "large")
            if not large.limit(1).count():
                break
        tried = _tried(texts.where("several").join(few(large), "grp", "left_semi"), known, n, width, num, den, most)
        if tried is None:
            break
        links = links.unionByName(tried.where("linked").select("a", "b"))
    return links


def _tried(texts: DataFrame, known: DataFrame, n: int, width: int, num: int, den: int, most: int) -> DataFrame | None:
    """Pairs of sets (grp, a, b, cut) of different components and leaves that may link, with whether they do; None if every group is one component."""
    labelled = texts.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = labelled.groupBy("grp").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.avg("n").alias("size")).where("x <> y")
    bits = F.least(F.lit(_MOST_BITS), F.greatest(F.lit(256), F.pow(F.lit(2), F.ceil(F.log2(F.col("size") * BITS))))).cast("long")
    members = labelled.join(open_.select("grp", bits.alias("bits")), "grp").select("grp", "leaf", "node", "t", "label", "bits")
    told = stash(_by_leaf(members, n).groupBy("grp", "leaf").applyInArrow(_summaries(width), _SUMMARY_SCHEMA), "summaries")
    if not told.limit(1).count():
        return None
    tiles = stash(told.select("grp", "leaf", "low", "high", "slack", "one", "top").groupBy("grp").applyInArrow(_tiles(num, den), "grp long, leaf long, tile long, tile_a long, tile_b long"), "tiles")
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), tiles.count() // (2 * TILE))
    met = told.select("grp", "leaf", *_SUMMARY).join(few(tiles), ["grp", "leaf"]).repartition(tasks, "grp", "tile_a", "tile_b")
    close = stash(met.groupBy("grp", "tile_a", "tile_b").applyInArrow(_close_sets(num, den, most), "grp long, a long, b long, cut boolean"), "close")
    text = lambda s: texts.select(F.col("node").alias(s), F.col("t").alias(f"t_{s}"))
    both = close.join(text("a"), "a").join(text("b"), "b").select("grp", "a", "b", "cut", "t_a", "t_b")
    return stash(both.mapInArrow(_verified(width, num, den), "grp long, a long, b long, cut boolean, linked boolean"), "tried")


def _texts_of(documents: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, t: the text of one row of each set. sets: node, key, rows; rows that repeat with their id have one key."""
    texts = documents.select(row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("t"))
    several = sets.where("rows > 1").select("key", "node")
    once = texts.join(few(sets.where("rows = 1").select("key", "node")), "key").select("node", "t")
    if not several.limit(1).count():
        return once
    return once.unionByName(texts.join(few(several), "key").select("node", "t").dropDuplicates(["node"]))


def _one_of_each(documents: DataFrame, keys: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """t: the text of one row of each set, and texts without a set."""
    gone = stash(keys.join(sets, "key", "left_anti").select("key").unionByName(sets.where("rows > 1").select("key")).distinct(), "copies")
    if gone.limit(FEW + 1).count() > FEW:
        return _texts_of(documents, sets, id_col, text_col).select("t")
    texts = documents.select(row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("t"))
    once, several = texts.join(F.broadcast(gone), "key", "left_anti").select("t"), sets.where("rows > 1").select("key")
    return once.unionByName(texts.join(few(several), "key").dropDuplicates(["key"]).select("t")) if several.limit(1).count() else once


def join(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component of each row: links are pairs of texts with den * |both| >= num * |either|.

    Also its key (``common.row_key``) and label, the component's least node, which rows without an id have as well.
    """
    small_batches(documents.sparkSession)
    described = stash(describe(documents, width, id_col, text_col), "sets")
    found = described.where("n_shingles > 0")
    keys = found.groupBy("node", "key").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n"), F.max("lead").alias("lead"), F.count(F.lit(1)).alias("rows"))
    sets = keys.groupBy("node").agg(F.min("id").alias("id"), F.min(F.struct("key", "rows")).alias("k"), F.max("n").alias("n"), F.max("lead").alias("lead"))
    sets = stash(sets.select("node", "id", "n", "lead", "k.key", "k.rows"), "nodes")
    share = PROBE * (den - num) / den
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    alone = own_tokens(_one_of_each(documents, keys, sets, id_col, text_col), width, share, total)
    first = stash(may_have_links(sets.select("node", "key", "rows", "n", "lead"), alone, num, den), "possible")
    some = stash(_texts_of(documents, first, id_col, text_col), "texts")
    left = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    second = stash(may_have_links(first, own_tokens(some.select("t"), width, 1.0, left), num, den), "possible")
    held = stash(some.join(few(second.select("node")), "node", "left_semi"), "texts")
    groups = components(stash(candidate_edges(held.select("t"), width, num, den), "candidates"))
    links = group_links(held, groups, second, width, num, den)
    joined = components(stash(links.distinct(), "links"))
    reps = sets.join(joined, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    least = reps.groupBy("label").agg(F.min("id").alias("component"))
    by_node = reps.join(least, "label").select("node", "label", "component")
    return described.join(by_node, "node", "left").select(
        "id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component"), "key", "label"
    )
