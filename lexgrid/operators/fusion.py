"""Combining ranked lists: reciprocal ranks, protected leaders, injected exact hits, duplicates and redirect stubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60
PROTECTED = 10


def reciprocal(*lists: DataFrame) -> DataFrame:
    """id and score: the sum of 1 / (60 + rank) over lists of id and rank."""
    out = lists[0].select("id", "rank")
    for x in lists[1:]:
        out = out.union(x.select("id", "rank"))
    return out.groupBy("id").agg(F.sum(1.0 / (RANK_CONSTANT + F.col("rank"))).alias("score"))


def fuse(primary: DataFrame, broad: DataFrame, protected: int = PROTECTED) -> DataFrame:
    """id, rank, score: the first `protected` of primary stay in place, the rest follows by reciprocal rank; scores are 1 / (60 + rank)."""
    leaders = primary.filter(F.col("rank") <= protected).select("id", F.lit(0).alias("tier"), (-F.col("rank")).cast("double").alias("by"))
    rest = reciprocal(primary, broad).join(leaders.select("id"), "id", "left_anti").select("id", F.lit(1).alias("tier"), F.col("score").alias("by"))
    order = Window.orderBy("tier", F.desc(F.round("by", 9)), "id")
    return leaders.union(rest).withColumn("rank", F.row_number().over(order)).select("id", "rank", (1.0 / (RANK_CONSTANT + F.col("rank"))).alias("score"))


def inject(hits: DataFrame, exact: DataFrame, embedded: DataFrame) -> DataFrame:
    """Hits (id, rank, score) with an exact hit on top (highest score + 1) and an embedded hit second (midway between its neighbours)."""
    top = F.coalesce(hits.agg(F.max("score")).scalar(), F.lit(0.0))
    second = F.coalesce(hits.filter("rank = 1").select("score").scalar(), F.lit(0.0))
    taken = exact.select("id").union(embedded.select("id"))
    return (
        exact.select("id", F.lit(0.0).alias("at"), (top + 1).alias("score"))
        .union(embedded.join(exact, "id", "left_anti").select("id", F.lit(0.5), (top + 1 + second) / 2))
        .union(hits.join(taken, "id", "left_anti").select("id", F.col("rank").cast("double"), "score"))
        .withColumn("rank", F.row_number().over(Window.orderBy("at", "id")))
        .select("id", "rank", "score")
    )


def first_only(hits: DataFrame, key: str, order: list[Column], stubs: DataFrame | None = None) -> DataFrame:
    """The best hit of each key; keys listed in `stubs` go."""
    if stubs is not None:
        hits = hits.join(stubs, key, "left_anti")
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def clean_score(score: Column) -> Column:
    return F.when(F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)


def grams(tokens: Column, longest: int = 8) -> Column:
    """Spans of query tokens that could be a title inside the query: from min(n - 1, 8) down to max(2, (2n + 4) // 5) tokens, n >= 3."""
    n = F.size(tokens)
    low, high = F.greatest(F.lit(2), F.floor((2 * n + 4) / 5).cast("int")), F.least(n - 1, F.lit(longest))
    widths = F.when((n >= 3) & (high >= low), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(widths, lambda w: F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.struct(w.alias("width"), i.alias("at"), F.concat_ws(" ", F.slice(tokens, i, w)).alias("span")))))


def distinctive(matches: Column, documents: Column, terms: Column) -> Column:
    """Whether so few documents hold all terms that the combination tells something."""
    return matches <= F.greatest(F.lit(32.0), F.when(terms == 2, documents / 20000).otherwise(documents / 1000))
