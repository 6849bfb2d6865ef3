"""Chunking by higher-order functions: split at the first separator present, then merge greedily with overlap."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.text import BLANKS, strip

#: Separators, from coarse to fine; after these, fixed windows.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ".", " ")


def recursive_split(text: Column, size: int = 500, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Pieces of at most ``size`` characters; a separator stays at the end of its piece.

    The recursion is unrolled: a piece that lacks a separator passes that level unchanged.
    """

    def level(pieces: Column, sep: str) -> Column:
        cut = lambda p: F.regexp_extract_all(p, F.lit(f"(?s).*?{re.escape(sep)}|.+"), F.lit(0))
        return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(cut(p))))

    pieces = F.array(text)
    for sep in separators:
        pieces = level(pieces, sep)
    starts = lambda p: F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size))
    return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.transform(starts(p), lambda i: F.substring(p, (i * size + 1).cast("int"), F.lit(size))))))


def merge_splits(pieces: Column, size: int = 500, overlap: int = 50) -> Column:
    """Chunks: pieces are appended while they fit; a new chunk begins with the last ``overlap`` characters."""
    if 2 * overlap > size:
        raise ValueError("overlap must be at most half the size")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, piece: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(piece) > size)
        tail = F.when(F.length(acc["cur"]) > overlap, F.substring(acc["cur"], F.length(acc["cur"]) - overlap + 1, F.lit(overlap))).otherwise(acc["cur"])
        fresh = F.concat(tail if overlap else F.lit(""), piece)
        over = F.length(fresh) > size
        return F.struct(
            F.when(full & over, F.concat(acc["out"], F.array(acc["cur"], F.substring(fresh, 1, size)))).when(full, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]).alias("out"),
            F.when(full & over, F.substring(fresh, F.lit(size - overlap + 1), F.length(fresh))).when(full, fresh).otherwise(F.concat(acc["cur"], piece)).alias("cur"),
        )

    done = F.aggregate(pieces, start, step, lambda acc: F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]))
    return F.filter(F.transform(done, lambda c: F.btrim(c, F.lit(BLANKS))), lambda c: c != "")


def chunk_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: int = 500, overlap: int = 50) -> DataFrame:
    """doc_id, source, chunk_index, content. Narrow: no shuffle."""
    pieces = recursive_split(strip(F.col(text_col)), size)
    rows = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), merge_splits(pieces, size, overlap).alias("chunks"))
    return rows.select("doc_id", "source", F.posexplode("chunks").alias("chunk_index", "content"))
