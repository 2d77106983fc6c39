"""The tiered ranker: phrases and terms in one tier, strict recall in another, both fused; exact and embedded titles first.

Each tier is a bounded window of the best by postings. What is fused, injected and deduplicated is at most two windows
and a few titles, so everything after the tiers works on a few hundred rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.functions import strings
from lexgrid.operators import fusion, redirects
from lexgrid.operators.postings import Index

TIER = 250
#: What each clause of the first tier counts, and the title's weight in strict recall.
CLAUSES = {"title_phrase": 8.0, "body_phrase": 3.0, "every_term": 2.0, "title": 4.0, "body": 1.0}
RECALL_TITLE = 3.0
#: Embedded titles taken at most; a span of two words must cover this share of the query.
EMBEDDED, TWO_OF = 3, 2 / 3
FIELDS = ["title", "body"]


def clause_scores(index: Index, terms: list[str]) -> DataFrame:
    """source, id, ranked (the disjunction of all clauses) and recall (null unless every term is in title or body)."""
    found = index.matches(terms, FIELDS)
    title, body, n = F.col("s_title"), F.col("s_body"), len(terms)
    every = F.when(F.col("terms") == n, CLAUSES["title"] * title + body).otherwise(0.0)
    score = CLAUSES["title"] * title + CLAUSES["body"] * body + (CLAUSES["every_term"] * every if n > 1 else F.lit(0.0))
    if n > 1:
        whole = index.phrases(terms, FIELDS).groupBy("source", "id").agg(F.bool_or(F.col("field") == "title").alias("in_title"), F.bool_or(F.col("field") == "body").alias("in_body"))
        found = found.join(whole, ["source", "id"], "left")
        score = score + F.when(F.col("in_title"), CLAUSES["title_phrase"] * title).otherwise(0.0) + F.when(F.col("in_body"), CLAUSES["body_phrase"] * body).otherwise(0.0)
    return found.select("source", "id", score.alias("ranked"), F.when(F.col("terms") == n, RECALL_TITLE * title + body).alias("recall"))


def tier(scores: DataFrame, by: str, window: int = TIER) -> DataFrame:
    """id and rank of the window of the best; ids carry their generation."""
    best = scores.filter(F.col(by) > 0).orderBy(F.desc(F.round(by, 6)), "id").limit(window)
    return best.select("id", F.row_number().over(Window.orderBy(F.desc(F.round(by, 6)), "id")).alias("rank"))


def fused(index: Index, terms: list[str], allowed: DataFrame | None = None, window: int = TIER) -> DataFrame:
    """id (source:id), rank, score of both tiers together; allowed (source, id): what may be found at all."""
    scores = clause_scores(index, terms)
    if allowed is not None:
        scores = scores.join(allowed, ["source", "id"], "left_semi")
    scores = scores.select(keyed().alias("id"), "ranked", "recall")
    return fusion.fuse(tier(scores, "ranked", window), tier(scores, "recall", window))


def keyed():
    return F.concat_ws(":", F.col("source").cast("string"), "id")


def canonical(titles: DataFrame, wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """wanted (name, a normalized title) with key, title and redirected of the record each one leads to, through redirects.

    titles: key, title_exact, title, primary; edges: src and dst, both normalized titles. Of records with one title a
    primary one is taken, then the smallest key. A chain that loops or is too long leads nowhere."""
    ends = redirects.follow(wanted.select(F.col("name").alias("id")).distinct(), edges).filter("not looped and not exceeded")
    best = titles.groupBy("title_exact").agg(F.min(F.struct(~F.col("primary"), F.col("key"), F.col("title"))).alias("b"))
    return ends.join(best, ends["target"] == best["title_exact"]).select(F.col("id").alias("name"), F.col("b.key").alias("key"), F.col("b.title").alias("title"), (F.col("hops") > 0).alias("redirected"))


def query_words(text: str) -> list[str]:
    """Words between blanks without marks at their ends."""
    return [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x) for x in text.split()) if w]


def embedded(index: Index, titles: DataFrame, text: str, edges: DataFrame) -> DataFrame:
    """Records that redirects lead to from the longest spans of the query that are titles: name and key, three at most.

    A span must be distinctive (few bodies hold all its terms); one of two words must cover two thirds of the query."""
    spark = titles.sparkSession
    words = query_words(text)
    names = spark.createDataFrame([(words,)], "t array<string>").select(F.inline(fusion.grams(F.col("t")))).select("width", "at", strings.normalize_title(F.col("span")).alias("name"))
    there = names.groupBy("name").agg(F.max("width").alias("width"), F.min("at").alias("at")).join(titles.select(F.col("title_exact").alias("name")).union(edges.select("src")).distinct(), "name", "left_semi")
    longest = there.agg(F.max("width")).scalar()
    spans = there.filter((F.col("width") == longest) & ((F.col("width") > 2) | (F.col("width") >= TWO_OF * len(words)))).orderBy("at").collect()
    kept = []
    for s in spans:
        terms = spark.range(1).select(F.array_distinct(strings.tokens(F.lit(s["name"]))).alias("t")).first()["t"]
        matches = index.matches(terms, ["body"]).filter(F.col("terms") == len(terms)).count() if terms else 0
        if 0 < matches <= max(32, index.documents // (20_000 if s["width"] == 2 else 1_000)):
            kept.append((s["name"], s["at"]))
    if not kept:
        return spark.createDataFrame([], "name string, key string")
    asked = spark.createDataFrame(kept, "name string, at int")
    hits = canonical(titles, asked, edges).filter("redirected").join(asked, "name")
    first = fusion.first_only(hits, "key", [F.col("at")])
    return first.orderBy("at").limit(EMBEDDED).select("name", "key")


def search(index: Index, titles: DataFrame, text: str, terms: list[str], edges: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """id (source:id), rank, score and mode: the fused tiers with an exact canonical hit on top, or else embedded ones second.

    Stubs that a redirect was entered by are left out. allowed as in fused()."""
    spark = titles.sparkSession
    hits = fused(index, terms, allowed) if terms else spark.createDataFrame([], "id string, rank int, score double")
    may = titles if allowed is None else titles.join(allowed.select(keyed().alias("key")), "key", "left_semi")
    asked = spark.range(1).select(strings.normalize_title(F.lit(text)).alias("name"))
    exact = canonical(may, asked, edges)
    one = exact.collect()
    none = spark.createDataFrame([], "id string")
    inner = none if one else embedded(index, may, text, edges).select(F.col("key").alias("id"))
    ids = spark.createDataFrame([(r["key"],) for r in one], "id string") if one else none
    modes = ids.withColumn("mode", F.lit("exact_redirect" if one and one[0]["redirected"] else "exact_title")).unionByName(inner.withColumn("mode", F.lit("embedded_redirect")))
    stubs = titles.filter(F.col("title_exact") == strings.normalize_title(F.lit(text))).join(ids.select(F.col("id").alias("key")), "key", "left_anti").select(F.col("key").alias("id")) if one and one[0]["redirected"] else none
    out = fusion.inject(hits.join(stubs, "id", "left_anti"), ids, inner)
    return out.join(modes, "id", "left").select("id", "rank", "score", F.coalesce("mode", F.lit("ranked")).alias("mode"))
