"""Result files and documents as Python data sources.

    register(spark)
    details.coalesce(1).write.format("result_csv").mode("overwrite").option("name", "details").option("bom", "true").save(path)
    chunks.write.format("named_text").mode("overwrite").save(path)          # name, content: a file for each row
    spark.read.format("docx").load(path)                                    # source, content: a row for each file

Writers put their files into a folder beside the target, each file under its final name by a rename when it is whole, so a task that is
tried again leaves one file.  When all tasks are done, the folder takes the target's place; when the job fails, it is deleted and
the target stays as it was.  Paths are such that Spark's workers and driver reach alike (a shared folder, hdfs, s3).
"""

from __future__ import annotations

import csv
import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Columns that a map of details may have in all; more are an error.
MOST_COLUMNS = 2000
# Columns of the load test's files.
SUMMARY_FIELDS = (
    "mode", "llm_type", "cache_state", "concurrency", "requests", "success",
    "errors", "error_rate", "total_duration_s", "throughput_rps",
    "mean_ms", "p50_ms", "p95_ms", "p99_ms", "min_ms", "max_ms",
    "ttft_mean_ms", "ttft_p50_ms", "ttft_p95_ms", "ttft_p99_ms",
    "retrieval_mean_ms", "retrieval_p50_ms",
    "done_rate", "duplicate_delta_count",
    "cache_hit_count", "cache_miss_count", "cache_unknown_count",
    "error_types", "sample_size_latency", "sample_size_ttft",
)
REQUEST_FIELDS = (
    "request_index", "request_id", "mode", "llm_type", "cache_state",
    "concurrency", "success", "status", "cache_hit", "ttft_ms", "total_ms",
    "retrieval_ms", "delta_count", "done_received", "duplicate_delta",
    "error_type",
)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"


def register(spark: SparkSession) -> None:
    for source in (ResultCsv, NamedText, Docx):
        spark.dataSource.register(source)


# -- sinks ------------------------------------------------------------------------------------------------------------


class Swapped(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        if not overwrite:
            raise ValueError("result files are written with mode overwrite")
        self.path = options["path"].rstrip("/")
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"
        store, at = self._store(self.staging)
        store.create_dir(at, recursive=True)

    @staticmethod
    def _store(path: str) -> tuple[arrow_fs.FileSystem, str]:
        return arrow_fs.FileSystem.from_uri(path)

    def put(self, name: str, chunks: Iterator[bytes]) -> None:
        store, at = self._store(self.staging)
        part = f"{at}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            for chunk in chunks:
                out.write(chunk)
        store.move(part, f"{at}/{name}")

    def commit(self, messages: list) -> None:
        store, new = self._store(self.staging)
        _, at = self._store(self.path)
        # what attempts that were stopped have left
        for f in store.get_file_info(arrow_fs.FileSelector(new)):
            if f.base_name.startswith("."):
                store.delete_file(f.path)
        old = f"{new}.old"
        there = store.get_file_info(at).type != arrow_fs.FileType.NotFound
        if there:
            store.move(at, old)
        store.move(new, at)
        if there:
            store.delete_dir(old) if store.get_file_info(old).type == arrow_fs.FileType.Directory else store.delete_file(old)

    def abort(self, messages: list) -> None:
        store, at = self._store(self.staging)
        if store.get_file_info(at).type != arrow_fs.FileType.NotFound:
            store.delete_dir(at)


class CsvWriter(Swapped):
    def __init__(self, fields: list[str], options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.fields, self.name, self.bom = fields, options.get("name", "part"), options.get("bom", "false").lower() == "true"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        number = TaskContext.get().partitionId()

        def chunks() -> Iterator[bytes]:
            text = io.StringIO(newline="")
            line = csv.writer(text)
            line.writerow(self.fields)
            yield b"\xef\xbb\xbf" if self.bom else b""
            for row in rows:
                line.writerow(["" if v is None else v for v in row])
                if text.tell() > 1 << 20:
                    yield text.getvalue().encode()
                    text.seek(0)
                    text.truncate()
            yield text.getvalue().encode()

        self.put(f"{self.name}.csv" if number == 0 else f"{self.name}-{number:05d}.csv", chunks())
        return WriterCommitMessage()


class ResultCsv(DataSource):
    """CSV files <name>.csv, <name>-00001.csv, .., one for each partition, with a header and, by option bom, a byte order mark; null is empty."""

    @classmethod
    def name(cls) -> str:
        return "result_csv"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return CsvWriter(schema.names, dict(self.options), overwrite)


class TextWriter(Swapped):
    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        for name, content in rows:
            if not name or "/" in name or name.startswith("."):
                raise ValueError(f"no name of a file: {name!r}")
            self.put(name, iter([(content or "").encode()]))
        return WriterCommitMessage()


class NamedText(DataSource):
    """A file for each row (name, content). Names must differ: see ``write_named_texts``."""

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TextWriter(dict(self.options), overwrite)


def spread(rows: DataFrame, column: str, *order: str) -> DataFrame:
    """``order`` and a column for each key of a map column, in order of their first row (by ``order``) and place; the keys of all rows, at most MOST_COLUMNS."""
    keys = rows.select(*order, F.posexplode(F.map_keys(column)).alias("place", "key")).groupBy("key").agg(F.min(F.struct(*order, "place")).alias("first"))
    found = [r.key for r in keys.orderBy("first", "key").limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    return rows.select(*order, *(F.try_element_at(column, F.lit(k)).alias(k) for k in found if k not in order))


def write_result(rows: DataFrame, path: str, name: str, fields: tuple[str, ...] | None = None, bom: bool = False, order: tuple[str, ...] = ()) -> None:
    """Rows as result_csv, in one file unless they are many, in ``order`` if that is given; with ``fields``, these columns in this order: one that is missing is empty, another is an error."""
    if fields:
        extra = [c for c in rows.columns if c not in fields]
        if extra:
            raise ValueError(f"columns that the file doesn't have: {extra}")
        rows = rows.select(*(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in fields))
    register(rows.sparkSession)
    rows = rows.orderBy(*order) if order else rows.hint("rebalance")
    rows.write.format("result_csv").mode("overwrite").option("name", name).option("bom", str(bom).lower()).save(path)


def write_named_texts(rows: DataFrame, path: str) -> None:
    """A file for each row (name, content); a name that stands twice is an error, and nothing is written then."""
    twice = rows.groupBy("name").count().where("count > 1").first()
    if twice:
        raise ValueError(f"two files of the name {twice.name!r}")
    register(rows.sparkSession)
    rows.select("name", "content").write.format("named_text").mode("overwrite").save(path)


def chunk_file_name(path, index):
    """Column <folder>__<stem>__<index of three digits or more>.md of a chunk's path and place; root stands for no folder."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    return F.format_string("%s__%s__%03d.md", F.when(folder == "", "root").otherwise(folder), stem, index)


# -- documents --------------------------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: list[str]


class DocxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("partitions", "64"))

    def partitions(self) -> list[InputPartition]:
        """Files in order of their paths, cut into ranges of about equal bytes."""
        store, at = arrow_fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(at)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == arrow_fs.FileType.File else [f for f in store.get_file_info(arrow_fs.FileSelector(at, recursive=True)) if f.type == arrow_fs.FileType.File]
        files = sorted((f.path, f.size or 0) for f in found if f.base_name.lower().endswith(".docx") and not f.base_name.startswith("~$"))
        share = sum(s for _, s in files) / self.parts
        out, held = [], 0
        for path, size in files:
            if not out or held >= share:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        store, _ = arrow_fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            try:
                with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as packed, packed.open("word/document.xml") as xml:
                    yield path.rpartition("/")[2], "\n".join(paragraphs(xml))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, zlib.error, ValueError) as e:
                raise ValueError(f"{path} is no readable docx file: {e}") from e


def paragraphs(xml) -> Iterator[str]:
    """Texts of a document's paragraphs, tables' and boxes' too; alternatives for older programs are skipped."""
    open_, skip = [], 0
    for event, node in ElementTree.iterparse(xml, events=("start", "end")):
        if node.tag == _FALLBACK:
            skip += 1 if event == "start" else -1
        elif skip:
            continue
        elif node.tag == f"{_W}p":
            if event == "start":
                open_.append([])
            else:
                yield "".join(open_.pop())
                node.clear()
        elif event == "end" and open_:
            if node.tag == f"{_W}t":
                open_[-1].append(node.text or "")
            elif node.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
                # a tab inside w:tabs is a stop of the layout, not a character
                open_[-1].append("\t" if node.tag == f"{_W}tab" and not node.attrib else "\n" if node.tag != f"{_W}tab" else "")


class Docx(DataSource):
    """source (the file's name), content (paragraphs, one a line) of the docx files of a folder and those in it, or of one file; a damaged one is an error that names it."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return "source string, content string"

    def reader(self, schema) -> DataSourceReader:
        return DocxReader(dict(self.options))
