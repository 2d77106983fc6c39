"""Connected components of links that stay distributed: alternating large and small stars until nothing changes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.runtime import discard, materialise


def local_labels(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the links u - v, on top of earlier labels."""
    label = np.arange(n) if labels is None else labels
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """id and component (the smallest id reachable) for every id that has a link; self-links and repeats are ignored.

    Each round writes its links in the shared folder. Sums of a hub's links combine before the shuffle; its joins
    are plain equi-joins, which adaptive execution splits."""
    edges = materialise(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        lowest = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = materialise(both.join(lowest, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, materialise(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(before, large)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
