"""Connected components of a graph in DataFrames, and forests of what one task sees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is linked with) for the edges a-b, but for the smallest nodes themselves."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        was = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(was, root):
            break
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for edges ``a, b`` (longs): the label is the smallest node reachable. Nodes without edges have no row.

    Alternates large-star and small-star steps (a few rounds even for long chains), each written to the shared folder.
    Minima are combined before they shuffle, and the join that hands them back may split a hot node's neighbours.
    """
    now, before = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        now = written(small, "components")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = state
