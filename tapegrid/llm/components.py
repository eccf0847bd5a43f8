"""Connected components of links between long ids, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.plans.session import materialise


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within one batch of links: every linked id but the smallest of its group, and that smallest one."""
    own, inverse = np.unique(np.r_[a, b], return_inverse=True)
    i, j = inverse[: len(a)], inverse[len(a):]
    root = np.arange(len(own))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    away = root != np.arange(len(own))
    return own[away], own[root[away]]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked id, root being the smallest id of its component.

    Each round joins links with their nodes' smallest neighbours: a node with very many links is a skewed join,
    which adaptive execution splits, after minima that are combined inside the map tasks. Rounds are kept in the shared folder;
    the driver sees a count and a checksum of each. Rows grow with the links, never with pairs of a component.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialise(edges, "links")
    before = None
    while True:
        edges = materialise(_small(_large(edges)), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node get its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
