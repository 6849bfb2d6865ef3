"""Sources and sinks: whole-file text, CSV rows as documents, JSONL questions, index tables, result files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.sources import files
from tarnwell.sources.shared import Folder

#: Extensions that are read.
EXTENSIONS = (".txt", ".md", ".csv")
INDEX_VERSION = 1
QUESTION = "id string, question string, reference_answer string, evidence string, source_contains string, answerable boolean, question_style string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


def allowed(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def read_text(spark: SparkSession, path: str, glob: str = "*.{txt,md}", ordered: bool = False) -> DataFrame:
    """source, content: each file is one document; source is the file's name. ``ordered``: by path."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = rows.orderBy("_metadata.file_path") if ordered else rows
    return rows.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("content"))


def read_csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """source, content: each row is one document of ``column: value`` lines."""
    rows = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in rows.columns]
    return rows.select(F.col("_metadata.file_name").alias("source"), F.concat_ws("\n", *lines).alias("content"))


def load_document(spark: SparkSession, path: str) -> DataFrame:
    """Reader by extension; other extensions are an error."""
    end = path.lower().rpartition(".")[2]
    if end == "csv":
        return read_csv_documents(spark, path)
    if end in ("txt", "md"):
        return read_text(spark, path, f"*.{path.rpartition('.')[2]}")
    if end == "docx":
        files.register(spark)
        return spark.read.format("docx").load(path)
    raise ValueError(f"no reader for .{end}")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions; missing texts are empty, and answerable is true unless said otherwise."""
    rows = spark.read.schema(QUESTION).option("mode", "FAILFAST").json(path)
    texts = ("reference_answer", "evidence", "source_contains")
    checked = F.when(F.col("id").isNull() | F.col("question").isNull(), F.raise_error(F.lit("a question needs id and question"))).otherwise(F.col("id"))
    return rows.select(checked.alias("id"), "question", *(F.coalesce(c, F.lit("")).alias(c) for c in texts), F.coalesce("answerable", F.lit(True)).alias("answerable"), "question_style")


def save_index(postings: DataFrame, path: str) -> None:
    """Index tables with their version, clustered by term; replaces what is there."""
    postings.withColumn("version", F.lit(INDEX_VERSION)).repartition(F.col("term")).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved postings, or None if there is none or it has another version."""
    try:
        rows = spark.read.parquet(path)
    except Exception as e:  # the path is missing or is no table
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "CANNOT_READ_FILE_FOOTER" in str(e) or "FAILED_READ_FILE" in str(e):
            return None
        raise
    if "version" not in rows.columns or rows.where(F.col("version") != INDEX_VERSION).limit(1).count():
        return None
    return rows.drop("version")


def write_details(rows: DataFrame, path: str, column: str | None = None, order: tuple[str, ...] = (), name: str = "evaluation_details") -> None:
    """CSV files with a byte order mark; of a map column, the union of its keys in order of appearance (see ``files.spread``)."""
    files.write_result(files.spread(rows, column, *order) if column else rows, path, name, bom=True, order=order)


def write_summary(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_rounds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files named <side>_r<round>_<scenario>.csv in a folder, with these parts as columns; of each side and scenario, rounds from 1 to the first that is missing.

    The files' names are listed by the driver: they are as many as there were test runs.
    """
    named = [m for m in (re.fullmatch(r"([a-z]+)_r([1-9]\d*)_(.+)\.csv", n) for n in Folder(spark, path).names("")) if m]
    rounds: dict[tuple[str, str], set[int]] = {}
    for m in named:
        rounds.setdefault((m[1], m[3]), set()).add(int(m[2]))
    kept = [m[0] for m in named if rounds[m[1], m[3]].issuperset(range(1, int(m[2])))]
    if not kept:
        return spark.createDataFrame([], f"{schema}, side string, round int, scenario string")
    rows = spark.read.schema(schema).option("header", "true").csv([f"{path.rstrip('/')}/{n}" for n in kept])
    part = lambda i: F.regexp_extract(F.col("_metadata.file_name"), r"^([a-z]+)_r(\d+)_(.+)\.csv$", i)
    return rows.select("*", part(1).alias("side"), part(2).cast("int").alias("round"), part(3).alias("scenario"))
