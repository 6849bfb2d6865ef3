"""WARC archives: a writer, and a splittable reader that finds gzip members inside byte ranges.

The writer makes one gzip member per record, in files of the shared folder.  A payload of at least ``least_bytes`` that
several pages have is stored once, with the largest page_id, as a response; the others become revisit records that
refer to it.  The reader cuts the files into byte ranges.  A task scans its range for the gzip magic, takes a candidate
as a member only if its header and the start of its content decode to a WARC record, and owns the records that start
inside its range (the last may end beyond).  A member that can't be decoded to its end, or bytes between members that are
none, raise an error that names file and offset; with ``damaged="skip"`` reading goes on with the next member.

Files are opened through Arrow's file systems, at the location of spark.checkpoint.dir, which all executors see.  A
file is written under a name of its task attempt and then moved to a name that only depends on the partition, so a
repeated or lost task leaves one complete file.

Defined results: null html is an empty payload; null url leaves out the target; null page_id is kept as null; repeated
rows are repeated records (equal largest page_ids are all responses); an empty table writes no file and reads back as an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small_batches, stash

# The formats' own constants.
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
_PROBE_BYTES = 512
LEAST_BYTES = 1000
#: Digests of several pages that are broadcast (beyond, pages are joined by digest), and tasks that read ranges.
FEW, MOST_TASKS = 500_000, 10_000


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def with_roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses).

    Digests that several pages have are sums per digest, combined before the shuffle.  If they are few, which is
    counted, they are broadcast and no html is moved; else pages are joined by digest, and pages below ``least_bytes``,
    which no digest is sought for, are dealt by their ids.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least_bytes
    groups = stash(
        rows.where(large).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").select(F.col("digest").alias("sought"), "largest"),
        "digests",
    )
    few = groups.limit(FEW + 1).count() <= FEW
    keyed = rows.withColumn("sought", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("digest")))))
    return keyed.join(F.broadcast(groups) if few else groups, "sought", "left").select(
        "page_id", "url", "html", "digest",
        F.when(F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"),
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        body += b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-ID", str(refers_to)),
                 ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>")]
        body += b"\r\n"
    head.append(("Content-Length", str(len(body))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> tuple[str, DataFrame]:
    """Write the archives; returns their folder and a table of files: path, length, records. Runs the job."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = (folder or new_path(spark, "warc")).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}.warc.gz"
        store, path = _opened(name)
        trial, out, records = f"{path}.{context.taskAttemptId()}.tmp", None, 0
        try:
            for batch in batches:
                if batch.num_rows and out is None:
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(trial, compression=None)
                for page_id, url, text, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    out.write(member(record(page_id, url, text.encode(), digest, refers)))
                    records += 1
        finally:
            if out is not None:
                out.close()
        if out is not None:
            store.move(trial, path)
            length = store.get_file_info(path).size
            yield pa.RecordBatch.from_pydict({"path": [name], "length": [length], "records": [records]})

    files = with_roles(pages, least_bytes).mapInArrow(run, "path string, length long, records long")
    listing = new_path(spark, "warc-files")
    files.write.parquet(listing)
    return folder, spark.read.schema(files.schema).parquet(listing)


class _Window:
    """Bytes of a file, read forwards from some offset in pieces."""

    def __init__(self, source, at: int):
        self.source, self.base, self.data = source, at, b""
        source.seek(at)

    def more(self) -> bool:
        piece = self.source.read(READ_BYTES)
        self.data += piece
        return bool(piece)

    def upto(self, at: int, size: int) -> bytes:
        while self.base + len(self.data) < at + size and self.more():
            pass
        return self.data[at - self.base:at - self.base + size]

    def drop(self, at: int) -> None:
        if at - self.base > READ_BYTES:
            self.data, self.base = self.data[at - self.base:], at


def is_record(head: bytes) -> bool:
    """Whether the bytes begin a gzip member with a WARC record in it."""
    if len(head) < 18 or head[:3] != GZIP_MAGIC or head[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(head, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def members(source, start: int, end: int, damaged: str = "raise") -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record that starts in [start, end)."""
    window, at, expected = _Window(source, start), start, None

    def gone(where: int) -> None:
        if damaged == "raise":
            raise ValueError(f"damaged or cut-off member at byte {where}")

    while at < end:
        found = -1
        while found < 0:
            found = window.data.find(GZIP_MAGIC, at - window.base)
            if found < 0 or found + window.base >= end:
                have = window.base + len(window.data)
                if found >= 0 or have >= end + len(GZIP_MAGIC) or not window.more():
                    if expected is not None and window.upto(expected, 1):  # something follows that is no member
                        gone(expected)
                    return
                at = max(at, have - len(GZIP_MAGIC) + 1)
                found = -1
        at = found + window.base
        if not is_record(window.upto(at, _PROBE_BYTES)):
            at += 1
            continue
        if expected not in (None, at):
            gone(expected)
        unpacker, parts, fed = zlib.decompressobj(31), [], at
        try:
            while not unpacker.eof:
                piece = window.upto(fed, 1 << 16)
                if not piece:
                    raise EOFError
                parts.append(unpacker.decompress(piece))
                fed += len(piece)
        except (zlib.error, EOFError):  # look for the next member behind the magic
            gone(at)
            at, expected = at + 1, None
            continue
        yield at, b"".join(parts)
        at = expected = fed - len(unpacker.unused_data)
        window.drop(at)


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[:int(fields.get("Content-Length", len(rest)))]
    return fields, block.partition(b"\r\n\r\n")[2]


def read(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES, damaged: str = "raise") -> DataFrame:
    """Records of the archives, read by byte ranges: page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest.

    files: path and length of each. Digest and size of a response come from its payload; a record whose payload does
    not have the stated digest raises. Those of a revisit come from its header, as the payload is elsewhere.
    """
    ranges = files.select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start")
    )
    n = files.agg(F.sum(F.ceil(F.col("length") / F.lit(split_bytes)))).first()[0] or 0
    ranges = ranges.repartition(int(min(max(n, 1), MOST_TASKS)))  # a number, as tables of ranges are too small for Spark to see the work in them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = _opened(path)
                rows, held = [], 0
                with store.open_input_file(inner) as source:
                    for _, content in members(source, start, min(length, start + split_bytes), damaged):
                        fields, payload = parsed(content)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind, size = fields["WARC-Type"], int(fields["X-Payload-Length"])
                        if kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                            raise ValueError(f"{path}: a payload doesn't have its digest {digest}")
                        page, refers, url = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID"), fields.get("WARC-Target-URI")
                        rows.append((
                            int(page) if page is not None else None, url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
                            kind, int(refers) if refers is not None else None, payload if kind == "response" else None, size, digest,
                        ))
                        held += len(payload)
                        if held > READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return ranges.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def archive_round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write the pages and read the archives back."""
    _, files = write(pages, least_bytes=least_bytes)
    return read(pages.sparkSession, files, split_bytes)
