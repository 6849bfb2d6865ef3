"""Tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local one is made only where it is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tarnwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tarnwell/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """The table written and read back: it is computed once, and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Another writer has committed the same generation."""


class Folder:
    """Files of a folder that Spark can reach, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _store(self, at):
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        at = self._at(name)
        return self._store(at).exists(at)

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(x.getPath().getName() for x in self._store(at).listStatus(at)) if self._store(at).exists(at) else []

    def read(self, name: str) -> str:
        """Empty if the file's bytes don't match its checksum."""
        at = self._at(name)
        stream = self._store(at).open(at)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        except Exception as e:
            if "ChecksumException" in str(e):
                return ""
            raise
        finally:
            stream.close()

    def put_once(self, name: str, text: str) -> None:
        """The file appears whole or not at all; one that is there already is a conflict."""
        part = self._at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = self._store(part).create(part, True)
        try:
            out.write(text.encode())
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        none[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            context.rename(part, self._at(name), none)
        except Exception as e:
            self._store(part).delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{name} was written by another") from e
            raise

    def delete(self, name: str = "") -> None:
        at = self._at(name)
        self._store(at).delete(at, True)
