"""Centroids, prefix tries and URL rules: brute force, bounds, odd tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import hamerly, prefix_trie, url_filter
from tarnwell.llm.queries import URL_RULES

# -- centroids --------------------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds):
    """Plain exact k-means over (vec_id, components) in Python integers."""
    v = [(i, [max(-(1 << 27), min(1 << 27, int(np.floor(256.0 * float(c))))) for c in x]) for i, x in rows]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in v if i is not None)
    c = [list(x) for _, x in named[:k]]
    near = lambda x: min(range(len(c)), key=lambda j: (far(x, c[j]), j))
    for _ in range(rounds):
        at = [near(x) for _, x in v]
        for j in range(len(c)):
            if own := [x for (_, x), a in zip(v, at) if a == j]:
                c[j] = [sum(p) // len(own) for p in zip(*own)]
    return sorted(((i is None, i or 0), near(x), far(x, c[near(x)])) for i, x in v), c


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 4
    return [(i, [float(x) for x in np.float32(centres[i % 6] + rng.normal(size=dims) * spread)]) for i in range(n)]


@pytest.mark.parametrize("spread, k", [(1.0, 7), (0.05, 4), (0.0, 5)])
def test_centroids_by_brute_force(spark, spread, k):
    """Also where vectors repeat, so that distances tie and centroids stay empty."""
    rows = vectors(150, 5, 3, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    members, centroids, scans = hamerly.cluster(df, k, 4, dims=5)
    expected, c = lloyd(rows, k, 4)
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in members.collect()) == expected
    assert [r.centroid for r in centroids.orderBy("cluster").collect()] == c
    assert scans[0] == 150 and (spread == 1.0 or min(scans) < 150)
    for r in members.collect():
        own = sorted(sum((a - b) ** 2 for a, b in zip(r.v, x)) ** 0.5 for x in c)
        assert r.upper >= own[0] and r.lower <= own[1] + 1e-9


def test_centroids_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "b"), (2, None, None), (3, [1.0], ""), (4, [1.0, None], ""), (5, [nan, 1.0], ""), (6, [inf, 1.0], ""), (None, [-0.001, 5.0], ""), (7, [1e30, -1e30], ""), (8, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    members, centroids, _ = hamerly.cluster(df, 3, 2, dims=2)
    kept = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [-0.001, 5.0]), (7, [1e30, -1e30])]
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in members.collect()) == lloyd(kept, 3, 2)[0]
    assert hamerly.cluster(df.limit(0), 3, 2, dims=2)[0].count() == 0
    assert hamerly.cluster(df.where("vec_id is null"), 3, 2, dims=2)[0].count() == 0
    one = hamerly.cluster(df.where("vec_id = 7"), 3, 2, dims=2)
    assert one[0].first().v == [1 << 27, -(1 << 27)] and one[0].first().distance == 0 and one[1].count() == 1


def test_distances_of_large_components():
    v = np.array([[1 << 27, -(1 << 27)], [3, 4]])
    assert hamerly.distances(v, -v).tolist() == [[2 * (1 << 28) ** 2, ((1 << 27) + 3) ** 2 + ((1 << 27) - 4) ** 2], [((1 << 27) + 3) ** 2 + ((1 << 27) - 4) ** 2, 100]]


# -- tries ------------------------------------------------------------------------------------------------------------


def nodes_of(rows):
    """The contract in Python: every node with its figures."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:])
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


TURNS = "conv_id long, turn long, role string, text string, depth int, k1 string"


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(3)
    tries = prefix_trie.Tries(df, **how)
    digests = {(r.k1, r.k2, r.depth): r.ends_sha256 for r in tries.end_digests().collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = [(r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, digests.get((r.k1, r.k2, r.depth), empty)) for r in tries.nodes().collect()]
    return tries, sorted(got)


def talks(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 20_000), n) + list(range(100, 130)) + list(range(300, 360)):
        kind = rng.random()
        turns = [("user", "same start")] * (kind < 0.6) + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é ü", None, ""])) for _ in range(rng.randrange(0, 7) if kind < 0.95 else 30)]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return list(dict.fromkeys(rows))


@pytest.mark.parametrize("most", [0, 3, 60])
def test_tries_by_brute_force(spark, most):
    """At any size of the upper levels: the sums of shards and of heavy nodes are the same."""
    rows = talks(5)
    rows = list({(r[0], r[1]): r for r in rows}.values())
    tries, got = found(spark, rows, most=most, shard=40)
    assert got == nodes_of(rows)
    assert tries.upper.count() > (5 if most else 0)


def test_tries_odd_rows(spark):
    long = "word " * 100_000
    rows = [(0, None, None, None), (0, None, "user", "x"), (0, 5, "user", "x"), (0, 5, "user", "x"), (None, 0, "user", "x"), (7, 0, "user", long), (7, 1, "user", long), (-250, 0, "a", "b"), (-200, 0, "a", "c"), (99, 3, "", "")]
    assert found(spark, rows)[1] == nodes_of(rows)
    none = spark.createDataFrame([], TURNS)
    tries = prefix_trie.Tries(none)
    assert tries.nodes().count() == 0 and tries.end_digests().count() == 0
    turnless = [(4, 0, "user", "x")]  # its opening is taken from a conversation that isn't there
    assert zlib.crc32(b"4") % 6 > 0 and found(spark, turnless)[1] == nodes_of(turnless)


def test_long_conversation_over_many_parts(spark):
    """A conversation that goes on over all parts, and one of the same turn throughout."""
    rows = [(200, i, "user", f"t{i % 7}") for i in range(900)] + [(201, i, "user", f"t{i % 7}") for i in range(880)] + [(202, 1, "user", "same")] * 300
    assert found(spark, rows, shard=50)[1] == nodes_of(rows)


def test_ids_in_several_blocks(spark):
    rows = [(c * 100, 0, "user", "x") for c in range(300)]
    assert found(spark, rows)[1] == nodes_of(rows)


def test_louds():
    degree = np.array([2, 1, 0, 3, 0, 0, 0])  # 0 -> 1, 2; 1 -> 3; 3 -> 4, 5, 6
    trie = prefix_trie.Louds.of_degrees(degree)
    assert trie.parents().tolist() == [-1, 0, 0, 1, 3, 3, 3] and trie.degrees().tolist() == degree.tolist()
    assert [trie.children(i) for i in (0, 1, 2, 3)] == [(1, 3), (3, 4), (4, 4), (4, 7)]
    again = prefix_trie.Louds.unpacked(trie.packed(), len(degree))
    assert (again.bits == trie.bits).all()


def test_find_in_stored_tries(spark):
    tries, _ = found(spark, [r for r in {(r[0], r[1]): r for r in talks(8, 60)}.values()])
    by_shard = [r.asDict() for r in tries.tries.collect()]
    seen = 0
    for trie in by_shard:
        louds = prefix_trie.Louds.unpacked(trie["louds"], trie["n_nodes"])
        parents = louds.parents()
        for node in range(1, trie["n_nodes"]):
            path, at = [], node
            while at > 0:
                path.insert(0, (trie["k1"][at - 1], trie["k2"][at - 1]))
                at = parents[at]
            assert prefix_trie.find(trie, path) == node and prefix_trie.find(trie, [*path, (1, 2)]) == -1
            seen += 1
    assert seen == sum(t["n_nodes"] - 1 for t in by_shard) > 50


# -- URL rules --------------------------------------------------------------------------------------------------------


def judged(url, rules):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = (None, "allow")
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best[0] is None or (len(rule.encode()), len(h)) > (len(best[0].encode()), best[0].find("/") % (1 << 30))):
            best = (rule, verdict)
    return host, path, *best


URLS = [
    None, "", "no scheme/", "http://", "http://A.Example.NET/en/x?y#z", "https://example.net/en/", "https://example.net/en", "https://badexample.net/en/", "ftp://example.com/de/1", "http://example.com/DE/", "http://a.org/fr/", "http://org/fr/",
    "http://x.net", "http://x.net?a/b", "http://net/", "HTTP://NET#/", "http://user@x.net:80/", "a://b://c.net/", "http://\u00c4.net/", "http://ex\u00e4mple.org/fr/\u00e9", "http://.net/", "http://x..net/", "http://" + "a." * 3000 + "net/" + "p" * 5000, "http://x.com/", "see http://x.net/ too\n",
]


def verdicts(df, rules, **how):
    return sorted(((r.n, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules, **how).collect()))


def test_urls_by_brute_force(spark):
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)] + [(5, URLS[5], "h", 1)], "n long, url string, host string, host_keys int").repartition(3)
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES)
    expected = sorted((i, *judged(u, URL_RULES)) for i, u in [*enumerate(URLS), (5, URLS[5])])
    for how in ({}, {"most_rules": 1}, {"most_bytes": 1}):
        assert verdicts(df, rules, **how) == expected
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(df, rules.limit(0)).collect()} == {"allow"}


def test_many_rules_in_both_ways(spark):
    """Rules made of other urls' hosts and paths, of many lengths; mapped and joined lists agree with each other and with brute force."""
    rng = random.Random(2)
    name = lambda: ".".join(rng.choice(["a", "bb", "c\u00e9"]) for _ in range(rng.randrange(1, 5)))
    part = lambda: "/".join(rng.choice(["x", "yy", "", "\u00fc"]) for _ in range(rng.randrange(0, 5)))
    rules = list({r: (r, rng.choice(["allow", "block"])) for r in (name() + rng.choice(["", "/" + part()]) for _ in range(400))}.values())
    urls = [(i, f"http://{name()}/{part()}") for i in range(400)]
    df, listed = spark.createDataFrame(urls, "n long, url string"), spark.createDataFrame(rules, url_filter.RULES)
    expected = sorted((i, *judged(u, rules)) for i, u in urls)
    assert verdicts(df, listed) == expected and verdicts(df, listed, most_rules=10) == expected
    assert sum(r[3] is not None for r in expected) > 100


def test_rules_that_repeat_or_are_wrong(spark):
    df = spark.createDataFrame([(1, "http://x.net/")], "n long, url string")
    twice = spark.createDataFrame([("NET/", "allow"), ("net/", "block")], url_filter.RULES)
    assert verdicts(df, twice)[0][3:] == ("net/", "block")
    for wrong in (("/x", "block"), (None, "block"), ("net/", "maybe"), ("net/", None)):
        with pytest.raises(Exception, match="a rule needs a host"):
            url_filter.judge(df, spark.createDataFrame([wrong], url_filter.RULES)).collect()


def test_equal_keys_are_told_apart_by_their_strings():
    keys = np.array([7, 7, 9], np.uint64)
    packed = url_filter.DigestArray.packed(keys, np.array([1, 2, 3]), [b"second", b"first", b"x"])
    array = url_filter.DigestArray(np.frombuffer(packed, np.uint8))
    at = int(array.probe(np.array([7], np.uint64))[0])
    assert [int(array.values[array.confirmed(at, 7, s)]) for s in (b"first", b"second")] == [2, 1] and array.confirmed(at, 7, b"third") == -1
    assert array.probe(np.array([8, 9, 10], np.uint64)).tolist() == [-1, 2, -1]


def test_spark_hash_is_xxhash(spark):
    texts = ["", "net", "example.net/en/", "\u00e9" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("k")).collect()
    assert [r.k % (1 << 64) for r in got] == url_filter.hashed([t.encode() for t in texts]).tolist()
