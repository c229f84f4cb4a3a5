"""Connected components: by union-find within a task, by star contraction across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


class Forest:
    """Union-find over the rows of a task, fed with edges a block at a time; root[k] is the least row joined with k so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            more = root[a] != root[b]
            a, b = a[more], b[more]
        self.root = root


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of each node but the least itself. Alternating large-star and small-star steps until nothing changes."""
    edges = cut(edges.where("node <> root").select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.min("root").alias("low")).withColumn("low", F.least("low", "node"))
        large = both.join(low, "node").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root")).where("node <> root").distinct()
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node").select(F.when(F.col("root") == F.col("low"), F.col("node")).otherwise(F.col("root")).alias("node"), F.col("low").alias("root")).where("node <> root").distinct()
        old, edges = edges, cut(small, "edges")
        forget(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())
        if now == before:
            return edges
        before = now
