"""Ranked search over records: clauses scored by BM25 or as exact matches, filters, order, pages.

With an index (operators.postings) a query reads the postings of its terms and narrow columns of the records. Without
one it is two passes over the records: one gathers document frequencies and lengths of the query's terms in one row, the
other scores each record by expressions. Both keep the best by a top-k.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lexgrid.functions import strings

K1, B = 1.2, 0.75
#: What a match in each field counts.
BOOSTS = {"title_exact": 20.0, "identifier_exact": 30.0, "aliases": 5.0, "title": 6.0, "keywords": 2.5, "body": 1.0, "all_terms": 2.0}
WINDOW_LEAST, WINDOW_MOST = 100, 500


@dataclass
class Query:
    text: str
    full_text: bool = True
    include_secondary: bool = False
    sort: str = "relevance"
    after: str | None = None
    before: str | None = None
    offset: int = 0
    limit: int = 10
    datasets: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.text.strip():
            raise ValueError("an empty query")
        if self.sort not in ("relevance", "newest", "oldest"):
            raise ValueError(f"unknown sort: {self.sort}")
        if self.offset < 0 or not 1 <= self.limit <= 50:
            raise ValueError("offset or limit out of bounds")


def field_text(records: DataFrame, name: str) -> Column:
    return F.concat_ws(" ", name) if dict(records.dtypes)[name].startswith("array") else F.col(name)


def with_tokens(records: DataFrame, fields: list[str]) -> DataFrame:
    return records.withColumns({f"{f}_tokens": strings.tokens(field_text(records, f)) for f in fields})


def frequency(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == F.lit(term)))


@dataclass
class Statistics:
    documents: int
    average: dict[str, float]
    frequency: dict[tuple[str, str], int]


def statistics(tokenized: DataFrame, fields: list[str], terms: list[str]) -> Statistics:
    """Of the whole table, in one aggregation."""
    sums = [F.sum(F.size(f"{f}_tokens")).alias(f"len_{f}") for f in fields]
    found = [F.count_if(F.array_contains(f"{f}_tokens", t)).alias(f"df_{f}_{i}") for f in fields for i, t in enumerate(terms)]
    row = tokenized.agg(F.count("*").alias("n"), *sums, *found).first()
    n = row["n"]
    return Statistics(n, {f: (row[f"len_{f}"] or 0) / n if n else 0.0 for f in fields}, {(f, t): row[f"df_{f}_{i}"] for f in fields for i, t in enumerate(terms)})


def bm25(name: str, terms: list[str], s: Statistics) -> Column:
    """Score of the OR of terms in one field; 0 without a match."""
    length = F.size(f"{name}_tokens")
    out = F.lit(0.0)
    for t in terms:
        df = s.frequency[name, t]
        idf = math.log(1 + (s.documents - df + 0.5) / (df + 0.5))
        tf = frequency(f"{name}_tokens", t).cast("double")
        out = out + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(s.average[name] or 1.0)))
    return out


def all_terms(name: str, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(f"{name}_tokens", t) for t in terms])


def some_term(name: str, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.array_contains(f"{name}_tokens", t) for t in terms])


def phrase_count(name: str, terms: list[str]) -> Column:
    """How often the terms stand one after another; each token has blanks of its own, so neighbours share none."""
    wanted = "".join(f" {t} " for t in terms)
    line = F.concat(F.lit(" "), F.array_join(f"{name}_tokens", "  "), F.lit(" "))
    return ((F.length(line) - F.length(F.replace(line, F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")


def phrase(name: str, terms: list[str]) -> Column:
    """The terms one after another, anywhere in the field."""
    return phrase_count(name, terms) > 0


def query_terms(text: str, records: DataFrame) -> list[str]:
    """Distinct tokens of the query in order; tokenized like the records."""
    row = records.sparkSession.range(1).select(F.array_distinct(strings.tokens(F.lit(text))).alias("t")).first()
    return row["t"]


def looks_like_identifier(text: str) -> bool:
    import re

    return bool(re.fullmatch(r"[A-Za-z]{2,12}[0-9]{1,12}", re.sub("[ -]", "", text.strip())))


def bounded(records: DataFrame, after: str | None, before: str | None) -> DataFrame:
    """Both ends are part of the range; records without a date drop out where a bound is given."""
    if after:
        records = records.filter(F.col("published_at") >= F.lit(after).cast("timestamp"))
    if before:
        records = records.filter(F.col("published_at") <= F.lit(before).cast("timestamp"))
    return records


def visible(records: DataFrame, q: Query) -> DataFrame:
    if q.datasets:
        records = records.filter(F.col("dataset").isin(q.datasets))
    if not q.include_secondary:
        records = records.filter("primary")
    return bounded(records, q.after, q.before)


def ranked(records: DataFrame, q: Query, terms: list[str] | None = None, index=None) -> DataFrame:
    """Matching records with is_exact and score. Statistics are those of all records, whatever the filters.

    index: the postings of exactly these records; `source` tells generations apart where it has several."""
    terms = query_terms(q.text, records) if terms is None else terms
    names = ["title", *(n for n in ("keywords", "aliases") if n in records.columns), *(["body"] if q.full_text and "body" in records.columns else [])]
    exact = strings.normalize_title(F.col("title")) == strings.normalize_title(F.lit(q.text))
    wanted = strings.normalize_identifier(F.lit(q.text))
    identified = F.exists("identifiers", lambda x: strings.normalize_identifier(x) == wanted) if "identifiers" in records.columns else F.lit(False)
    score = F.when(exact, BOOSTS["title_exact"]).otherwise(0.0) + F.when(F.coalesce(identified, F.lit(False)), BOOSTS["identifier_exact"]).otherwise(0.0)
    if looks_like_identifier(q.text) or not terms:
        tokenized = records
    elif index is not None:
        key = ["source", "id"] if "source" in records.columns else ["id"]
        tokenized = records.join(index.matches(terms, names).select(*key, *(c for n in names for c in (f"s_{n}", f"n_{n}"))), key, "left")
        for n in names:
            score = score + BOOSTS[n] * F.coalesce(f"s_{n}", F.lit(0.0))
        if "body" in names and len(terms) > 1:
            score = score + F.when(F.col("n_body") == len(terms), BOOSTS["all_terms"] * F.col("s_body")).otherwise(0.0)
    else:
        tokenized = with_tokens(records, names)
        s = statistics(tokenized, names, terms)
        for n in names:
            score = score + BOOSTS[n] * bm25(n, terms, s)
        if "body" in names and len(terms) > 1:
            score = score + F.when(all_terms("body", terms), BOOSTS["all_terms"] * bm25("body", terms, s)).otherwise(0.0)
    weight = F.when(F.col("rank_weight") > 0, F.col("rank_weight")).otherwise(1.0) if "rank_weight" in records.columns else F.lit(1.0)
    out = visible(tokenized, q).withColumns({"is_exact": exact, "raw_score": score}).filter("raw_score > 0")
    return out.withColumn("score", F.col("raw_score") * weight).drop("raw_score", *(c for n in names for c in (f"{n}_tokens", f"s_{n}", f"n_{n}")))


def ordered(hits: DataFrame, sort: str = "relevance", key: str = "id") -> DataFrame:
    if sort == "newest":
        return hits.orderBy(F.desc_nulls_last("published_at"), F.desc(F.round("score", 6)), key)
    if sort == "oldest":
        return hits.orderBy(F.asc_nulls_last("published_at"), F.desc(F.round("score", 6)), key)
    return hits.orderBy(F.desc("is_exact"), F.desc(F.round("score", 6)), key)


def candidate_window(offset: int, limit: int) -> int:
    return min(WINDOW_MOST, max(WINDOW_LEAST, offset + 10 * limit))


def page(hits: DataFrame, q: Query, key: str = "id") -> DataFrame:
    """One page, cut from a bounded window of the best candidates; the total counts all."""
    best = ordered(hits, q.sort, key).limit(candidate_window(q.offset, q.limit))
    best = ordered(best, q.sort, key)
    return best.offset(q.offset).limit(q.limit) if q.offset else best.limit(q.limit)


def page_and_total(hits: DataFrame, q: Query, key: str = "id") -> tuple[list, int]:
    """(rows of the page, number of all hits) from one execution: hits are counted on their way to the top-k."""
    seen = Observation()
    rows = page(hits.observe(seen, F.count(F.lit(1)).alias("n")), q, key).collect()
    return rows, seen.get["n"]


def batch(index, queries: DataFrame, k: int) -> DataFrame:
    """Many queries in one plan: item_id and terms of `queries` against the bodies of an index; the k best of each.

    Of the postings only those of terms that some query asks for are read on; scores combine before they are shuffled."""
    asked = queries.select("item_id", F.explode("terms").alias("term")).distinct()
    postings = index.all_rows().filter("field = 'body' and term <> ''").join(asked.select("term").distinct(), "term", "left_semi").select("id", "term", "tf", "length")
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(index.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    one = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(index.average.get("body") or 1.0)))
    scores = postings.join(frequencies, "term").select("id", "term", one.alias("s")).join(asked, "term").groupBy("item_id", "id").agg(F.sum("s").alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 6)), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def in_namespaces(records: DataFrame, namespaces: list[int]) -> DataFrame:
    return records.filter(F.col("namespace").isin(namespaces))


def by_ids(records: DataFrame, ids: list, column: str = "id") -> DataFrame:
    return records.filter(F.col(column).isin(ids))


def by_title(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records whose normalized title (title_exact) is wanted, with the columns of `wanted`."""
    return records.join(wanted, "title_exact")


def with_metadata(hits: DataFrame, records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A bounded page of hits with columns that are read for these hits only."""
    return records.select(key, *columns).join(hits, key)
