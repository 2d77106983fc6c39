"""Redirect chains: a bounded number of hops along an edge list, with loop detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.runtime import materialise

WIKI_HOPS, ARCHIVE_HOPS = 8, 16


def follow(starts: DataFrame, edges: DataFrame, hops: int = WIKI_HOPS) -> DataFrame:
    """id, target, hops, looped, exceeded for each start (column id); edges: src to dst, one per src.

    Unrolled equi-joins with edges that are dealt by src once. A start leaves the frontier where its chain ends, and what
    is left is written, so later joins hold only chains that go on. A chain that meets a node again is looped and stays
    where it closed; one that still has an edge after the last hop is exceeded."""
    edges = materialise(edges.select(F.col("src").alias("target"), F.col("dst").alias("_next")).repartition("target"), "edges")
    at = starts.select("id", F.col("id").alias("target"), F.lit(0).alias("hops"), F.array("id").alias("path"))
    ended = []
    for n in range(hops + 1):
        step = materialise(at.join(edges, "target", "left"), "hop")
        more = F.col("_next").isNotNull()
        loops = more & F.array_contains("path", F.col("_next")) if n < hops else F.lit(False)
        goes, over = more & ~loops, more if n == hops else F.lit(False)
        done = step.filter(~goes | over).select("id", "target", "hops", loops.alias("looped"), over.alias("exceeded"))
        ended.append(done.withColumns({"looped": F.coalesce("looped", F.lit(False)), "exceeded": F.coalesce("exceeded", F.lit(False))}))
        at = step.filter(goes).select("id", F.col("_next").alias("target"), (F.col("hops") + 1).alias("hops"), F.array_append("path", F.col("_next")).alias("path"))
        if n == hops or at.isEmpty():
            break
    return reduce(DataFrame.unionByName, ended)
