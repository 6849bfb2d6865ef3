"""URL filter over a sorted digest array: 64-bit xxhash keys are memory-mapped, probed by binary search, and confirmed by the stored strings.

A rule is (rule, verdict), the rule as host and path: ``example.net/en/``.  It fits its host and all subdomains, if the
url's path starts with the rule's path (from its first slash on; without a slash the path is empty and fits every path).  Of several fitting
rules the longest wins (ties: the longer host).  Urls that no rule fits get the verdict of the method: what isn't in the list is allowed.

The rules are sorted by Spark into two digest arrays, of hosts and of whole rules.  Where they have at most MOST_RULES
rules and MOST_BYTES bytes, which is counted, they become one file of the shared folder that executors fetch once and each task maps.
JVM expressions take the url apart and hash the host's ends, as many as any rule has labels; numpy probes all keys of a batch at
once.  Hosts that are hit give the path lengths to probe, which are those of the host's own rules.  A longer list stays
a table: the same keys, exploded, are joined with it by shuffle, first hosts, then whole rules; strings are compared there as well.

Defined results: a null url, or one without ``://``, has empty host and path, and no rule fits (but one without host and path, ``""``, isn't
a rule); of a rule that is given several times the verdict block wins; rules with a null, an empty host or another verdict are errors; only A-Z are
lower-cased, in hosts of urls and rules; an empty table gives an empty table; without rules all urls are allowed; repeated rows and null ids
are judged like others; other columns stay as they are, those of the added names are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, shared_dir, text_bytes

ALLOW, BLOCK = "allow", "block"
#: Lists of at most so many rules and bytes are mapped from a file; longer ones are joined.
MOST_RULES, MOST_BYTES = 2_000_000, 128 << 20
#: Fixed value: seed of Spark's xxhash64.
SEED = 42
RULES = "rule string, verdict string"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is no ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UP, _LOW)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def listed(rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict, labels: the rules taken apart, each once."""
    rule, verdict = F.col("rule").cast("string"), F.col("verdict").cast("string")
    slash = F.instr(rule, "/")
    host = F.translate(F.when(slash > 0, F.substring(rule, F.lit(1), slash - 1)).otherwise(rule), _UP, _LOW)
    path = F.when(slash > 0, F.substring(rule, slash, F.length(rule))).otherwise("")
    good = rule.isNotNull() & (host != "") & verdict.isin(ALLOW, BLOCK)
    rows = rules.select(F.when(F.coalesce(good, F.lit(False)), host).otherwise(F.raise_error(F.lit("a rule needs a host and a verdict, allow or block"))).alias("host"), path.alias("path"), verdict.alias("verdict"))
    once = rows.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return once.withColumn("rule", F.concat("host", "path")).withColumn("labels", F.size(F.split("host", "[.]")))


class DigestArray:
    """Sorted 64-bit keys with their strings and one number each, as parts of one mapped file."""

    def __init__(self, data: np.ndarray):
        n = int(data[:8].view(np.int64)[0])
        self.end = 8 + 8 * (3 * n + 1) + int(data[8 + 8 * 3 * n:8 + 8 * (3 * n + 1)].view(np.int64)[0])
        words = data[8:8 + 8 * (3 * n + 1)]
        self.keys, self.values = words[:8 * n].view(np.uint64), words[8 * n:16 * n].view(np.int64)
        self.offsets = words[16 * n:].view(np.int64)
        self.text = data[8 + 8 * (3 * n + 1):self.end]

    @staticmethod
    def packed(keys: np.ndarray, values: np.ndarray, strings: list[bytes]) -> bytes:
        """The bytes of an array; keys needn't be sorted. Of equal keys all stay, by their strings."""
        order = sorted(range(len(strings)), key=lambda i: (int(keys[i]), strings[i]))
        text = [strings[i] for i in order]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in text], dtype=np.int64))).astype(np.int64)
        whole = b"".join([np.int64(len(order)).tobytes(), keys[order].astype(np.uint64).tobytes(), values[order].astype(np.int64).tobytes(), offsets.tobytes(), *text])
        return whole + bytes(-len(whole) % 8)

    def __len__(self) -> int:
        return len(self.keys)

    def string(self, i: int) -> bytes:
        return self.text[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """First place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == keys, np.minimum(at, len(self.keys) - 1), -1)

    def confirmed(self, place: int, key: int, string: bytes) -> int:
        """The place of the string among those of equal keys from ``place`` on, or -1."""
        while place < len(self.keys) and int(self.keys[place]) == key:
            if self.string(place) == string:
                return place
            place += 1
        return -1


def hashed(strings: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in strings), np.uint64, len(strings))


def packed_rules(rows: list) -> bytes:
    """Digest arrays of hosts (value: first place in the lengths), of rules (value: 1 for block), and the path lengths of each host."""
    hosts: dict[bytes, set[int]] = {}
    for r in rows:
        hosts.setdefault(r.host.encode(), set()).add(len(r.path.encode()))
    names = sorted(hosts)
    spans = np.concatenate(([0], np.cumsum([len(hosts[h]) for h in names], dtype=np.int64))).astype(np.int64)
    lengths = np.array([x for h in names for x in sorted(hosts[h], reverse=True)], np.int64)
    rules = [r.rule.encode() for r in rows]
    host_part = DigestArray.packed(hashed(names), np.arange(len(names)), names)
    rule_part = DigestArray.packed(hashed(rules), np.array([r.verdict == BLOCK for r in rows], np.int64), rules)
    head = np.array([len(host_part), len(rule_part), len(spans), len(lengths)], np.int64).tobytes()
    return head + host_part + rule_part + spans.tobytes() + lengths.tobytes()


class RuleFile:
    """Mapped rules of one file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        sizes = data[:32].view(np.int64)
        a, b = 32 + int(sizes[0]), 32 + int(sizes[0] + sizes[1])
        self.hosts, self.rules = DigestArray(data[32:a]), DigestArray(data[a:b])
        self.spans = data[b:b + 8 * int(sizes[2])].view(np.int64)
        self.lengths = data[b + 8 * int(sizes[2]):].view(np.int64)[:int(sizes[3])]

    def judge(self, keys: np.ndarray, n_keys: int, hosts: tuple[np.ndarray, np.ndarray], paths: tuple[np.ndarray, np.ndarray]) -> tuple[list, list]:
        """Rule and whether it blocks (None where none fits) of each row. keys: n_keys hashes a row, of the host's last 1, 2, .. labels."""
        rows = len(hosts[1]) - 1
        found = self.hosts.probe(keys)
        host, path = ((x[0].tobytes(), x[1]) for x in (hosts, paths))
        tried: list[tuple[int, int, bytes]] = []  # row, length of the rule, rule
        for at in np.flatnonzero(found >= 0):
            row, labels = divmod(int(at), n_keys)
            name = host[0][host[1][row]:host[1][row + 1]]
            end = b".".join(name.rsplit(b".", labels + 1)[-labels - 1:])
            if end.count(b".") < labels:
                continue  # the host has fewer labels: its whole name was hashed before
            place = self.hosts.confirmed(int(found[at]), int(keys[at]), end)
            if place < 0:
                continue
            own = path[0][path[1][row]:path[1][row + 1]]
            i = int(self.hosts.values[place])
            tried += [(row, len(end) + int(x), end + own[:x]) for x in self.lengths[self.spans[i]:self.spans[i + 1]] if x <= len(own)]
        rule, blocked, longest = [None] * rows, [None] * rows, [(-1, -1)] * rows
        probes = hashed([x[2] for x in tried])
        for (row, size, text), key, place in zip(tried, probes, self.rules.probe(probes)):
            host_size = len(text) if b"/" not in text else text.index(b"/")
            if place >= 0 and (size, host_size) > longest[row] and (hit := self.rules.confirmed(int(place), int(key), text)) >= 0:
                rule[row], blocked[row], longest[row] = text.decode(), bool(self.rules.values[hit]), (size, host_size)
        return rule, blocked


def written(spark: SparkSession, data: bytes) -> str:
    """Name of a file with these bytes that every executor can get: in the shared folder, and announced to Spark."""
    name = f"rules-{uuid.uuid4().hex}.bin"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tarnwell/{name}")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(data[i:i + (1 << 20)])
    finally:
        out.close()
    spark.sparkContext.addFile(at.toString())
    return name


def host_keys(host: Column, most: int) -> Column:
    """Hashes of the host's last 1 .. most labels; the whole host where it has fewer."""
    return F.array(*(F.xxhash64(F.substring_index(host, ".", -j)) for j in range(1, most + 1)))


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", most_rules: int = MOST_RULES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows with host, path, rule (null if none fits) and verdict."""
    spark = urls.sparkSession
    added = ("host", "path", "rule", "verdict")
    url = F.col(url_col).cast("string")
    kept = [c for c in urls.columns if c.lower() not in added]
    base = urls.select(*(F.col(c) for c in kept), host_of(url).alias("host"), path_of(url).alias("path"))
    known = listed(rules)
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0)).alias("bytes"), F.max("labels").alias("labels")).first()
    if not size.n:
        return base.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(ALLOW))
    if size.n > most_rules or size.bytes > most_bytes:
        return _joined(base, known, size.labels)
    name = written(spark, packed_rules(known.collect()))
    keys, n_keys = free_name(base, "host_keys"), size.labels
    sent = base.withColumn(keys, host_keys(F.col("host"), n_keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = RuleFile(SparkFiles.get(name))
        for batch in batches:
            names = batch.schema.names
            flat = batch.column(names.index(keys)).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            rule, blocked = file.judge(flat, n_keys, text_bytes(batch.column(names.index("host"))), text_bytes(batch.column(names.index("path"))))
            own = [batch.column(i) for i, c in enumerate(names) if c != keys]
            verdict = [BLOCK if x else ALLOW for x in blocked]
            yield pa.RecordBatch.from_arrays([*own, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*(c for c in names if c != keys), "rule", "verdict"])

    schema = base.withColumn("rule", F.lit("").cast("string")).withColumn("verdict", F.lit("").cast("string")).schema
    for field in schema.fields:
        field.nullable = True
    return sent.mapInArrow(run, schema)


def _joined(base: DataFrame, known: DataFrame, labels: int) -> DataFrame:
    """The same verdicts by joins: distinct (host, path) pairs, their hosts' ends, the path lengths of the hosts, then whole rules."""
    pairs = base.select("host", "path").distinct()
    ends = pairs.select("host", "path", F.explode(F.array_distinct(F.array(*(F.substring_index("host", ".", -j) for j in range(1, labels + 1))))).alias("end"))
    spans = known.select(F.col("host").alias("end"), F.length("path").alias("span")).distinct()
    key = lambda c: F.xxhash64(c)
    tried = ends.withColumn("k", key("end")).join(spans.withColumn("k", key("end")), ["k", "end"]).where(F.col("span") <= F.length("path"))
    tried = tried.select("host", "path", F.concat("end", F.substring(F.col("path"), F.lit(1), F.col("span"))).alias("rule"), F.length("end").alias("at"))
    hits = tried.withColumn("k", key("rule")).join(known.select("rule", "verdict").withColumn("k", key("rule")), ["k", "rule"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.octet_length("rule").alias("n"), "at", "rule", "verdict")).alias("b"))
    found = best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))
    out = base.join(found, ["host", "path"], "left")
    return out.select(*base.columns, "rule", F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"))
