"""Connected components of an undirected graph, as DataFrames: least neighbours, pointer jumping, contraction.

In a round every node points to its least neighbour, pointers are followed to their ends, and the edges are contracted
to these, so that each round has at most half the nodes of the last.  Joins are on keys of the larger side that Spark can
split, minima combine before the shuffle, and nothing comes to the driver but whether something is left.  Tables of a
round are in the shared folder and removed when the next no longer needs them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, removed


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least, other) that connect what the given edges connect, one for each node but the least of a component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        low, high = np.minimum(p, q), np.maximum(p, q)
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _kept(spark: SparkSession, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """node, label: the least node that can be reached. Nodes without an edge are not in the result."""
    spark = edges.sparkSession
    pairs = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct()
    pairs, old = _kept(spark, pairs, "edges")
    rounds: list[DataFrame] = []
    while True:
        both = pairs.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("near")))
        labels, path = _kept(spark, both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
        while True:  # the label of the label
            ends = labels.select(F.col("node").alias("label"), F.col("label").alias("end"))
            followed, more = _kept(spark, labels.join(ends, "label").select("node", F.col("end").alias("label"), (F.col("end") != F.col("label")).alias("moved")), "labels")
            removed(spark, path)
            path, labels = more, followed.select("node", "label")
            if not followed.where("moved").limit(1).count():
                break
        rounds.append(labels)
        side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"new_{c}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").where("new_a <> new_b")
        pairs, now = _kept(spark, met.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "edges")
        removed(spark, old)
        old = now
        if not pairs.limit(1).count():
            break
    found = rounds[0]
    for labels in rounds[1:]:
        ends = labels.select(F.col("node").alias("label"), F.col("label").alias("end"))
        found = found.join(ends, "label", "left").select("node", F.coalesce("end", "label").alias("label"))
    return found
