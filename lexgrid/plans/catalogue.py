"""The registered queries of the engine, each next to the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrid.functions import dates, markup, passages, strings, wikitext
from lexgrid.operators import catalog, changelog, fusion, reading, redirects, references, search, tiered
from lexgrid.plans import carriers as C
from lexgrid.plans.carriers import REC, bm25, records, table, tok
from lexgrid.runtime import ship
from lexgrid.streaming import changelog as streamed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TERMS = ["with", "from", "this"]
QUERY = "with from this"


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def scored(hits: DataFrame, *columns: str) -> DataFrame:
    return hits.select(*columns, F.round("score", 4).alias("score"))


# tokens and statistics


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def token_stats(spark, sf_dir):
    t = C.spread(table(spark, sf_dir, "documents")).select("doc_id", strings.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tok('text')})) AS term FROM documents) GROUP BY term")
def term_df(spark, sf_dir):
    return C.index(spark, sf_dir).all_rows().filter("field = 'body' and term <> ''").groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT doc_id, 'body' AS field, CAST(len({tok('text')}) AS INTEGER) AS field_len FROM documents UNION ALL SELECT doc_id, 'title', CAST(len({tok('split_part(text, chr(10), 1)')}) AS INTEGER) FROM documents")
def doc_lengths(spark, sf_dir):
    docs = C.spread(table(spark, sf_dir, "documents"))
    fields = F.array(F.struct(F.lit("body").alias("field"), F.size(strings.tokens(F.col("text"))).alias("field_len")), F.struct(F.lit("title").alias("field"), F.size(strings.tokens(F.substring_index("text", "\n", 1))).alias("field_len")))
    return docs.select("doc_id", F.inline(fields))


@query(f"SELECT count(*) AS n_docs, CAST(sum(len({tok('text')})) AS BIGINT) AS sum_len, round(avg(len({tok('text')})), 6) AS avg_len FROM documents")
def corpus_stats(spark, sf_dir):
    n = F.size(strings.tokens(F.col("text")))
    return C.spread(table(spark, sf_dir, "documents")).agg(F.count("*").alias("n_docs"), F.sum(n).alias("sum_len"), F.round(F.avg(n), 6).alias("avg_len"))


# one field by BM25


def _one_field(spark, sf_dir, name: str, terms: list[str], k: int = 20) -> DataFrame:
    hits = C.index(spark, sf_dir).matches(terms, [name]).select("id", F.col(f"s_{name}").alias("score"))
    return scored(hits.orderBy(F.desc(F.round("score", 6)), "id").limit(k), "id")


def _one_field_sql(expr: str, terms: list[str], k: int = 20) -> str:
    return f"WITH {REC}, {bm25('b', expr, terms)} SELECT id, round(s, 4) AS score FROM b ORDER BY round(s, 6) DESC, id LIMIT {k}"


@query(_one_field_sql("body", TERMS))
def bm25_body_top20(spark, sf_dir):
    return _one_field(spark, sf_dir, "body", TERMS)


@query(_one_field_sql("title", ["the", "and", "of"]))
def bm25_title_top20(spark, sf_dir):
    return _one_field(spark, sf_dir, "title", ["the", "and", "of"])


@query(_one_field_sql("keywords", ["fr", "src7"]))
def bm25_keywords_top20(spark, sf_dir):
    return _one_field(spark, sf_dir, "keywords", ["fr", "src7"])


# the ranked query

_CLAUSES = f"""{bm25('t', 'title', TERMS)}, {bm25('k', 'keywords', TERMS)}, {bm25('b', 'body', TERMS)}"""


def _ranked_sql(where: str = "true", full: bool = True, tail: str = "LIMIT 10", columns: str = "id, is_exact, round(score, 4) AS score") -> str:
    body = "+ coalesce(b.s, 0) + CASE WHEN b.hits = 3 THEN 2 * b.s ELSE 0 END" if full else ""
    return f"""WITH {REC}, {_CLAUSES},
c AS (SELECT rec.*, lower(trim(replace(title, '_', ' '))) = '{QUERY}' AS is_exact,
  (CASE WHEN lower(trim(replace(title, '_', ' '))) = '{QUERY}' THEN 20.0 ELSE 0 END + 6 * coalesce(t.s, 0) + 2.5 * coalesce(k.s, 0) {body}) * w AS score
  FROM rec LEFT JOIN t USING (id) LEFT JOIN k USING (id) LEFT JOIN b USING (id))
SELECT {columns} FROM c WHERE score > 0 AND {where} {('ORDER BY is_exact DESC, round(score, 6) DESC, id ' + tail) if tail else ''}"""


def _hits(spark, sf_dir, q: search.Query) -> DataFrame:
    return search.ranked(records(spark, sf_dir), q, TERMS, C.index(spark, sf_dir))


def _ranked(spark, sf_dir, **options) -> DataFrame:
    q = search.Query(QUERY, **options)
    return scored(search.page(_hits(spark, sf_dir, q), q), "id", "is_exact")


@query(_ranked_sql("is_primary"))
def ranked_query_full(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query(_ranked_sql("is_primary", full=False))
def ranked_query_title_mode(spark, sf_dir):
    return _ranked(spark, sf_dir, full_text=False)


@query(_ranked_sql("is_primary"))
def search_primary_only(spark, sf_dir):
    return _ranked(spark, sf_dir, include_secondary=False)


@query(_ranked_sql("true"))
def search_include_secondary(spark, sf_dir):
    return _ranked(spark, sf_dir, include_secondary=True)


@query(_ranked_sql("is_primary", tail="LIMIT 10 OFFSET 10"))
def search_page_2(spark, sf_dir):
    return _ranked(spark, sf_dir, offset=10)


@query(_ranked_sql("is_primary", tail="", columns="count(*) AS total"))
def search_total_count(spark, sf_dir):
    return _hits(spark, sf_dir, search.Query(QUERY)).agg(F.count("*").alias("total"))


@query(_ranked_sql("is_primary AND dataset IN ('src1', 'src2')", columns="id, dataset, round(score, 4) AS score"))
def federated_search(spark, sf_dir):
    q = search.Query(QUERY, datasets=["src1", "src2"])
    return scored(search.page(_hits(spark, sf_dir, q), q), "id", "dataset")


@query(_ranked_sql("is_primary AND dataset = 'src3'", columns="id, dataset, round(score, 4) AS score"))
def single_dataset_search(spark, sf_dir):
    q = search.Query(QUERY, datasets=["src3"])
    return scored(search.page(_hits(spark, sf_dir, q), q), "id", "dataset")


_GENERATION = "substr(sha256('testdata' || chr(31) || source || chr(31) || 'v1'), 1, 32)"


@query(f"SELECT {_GENERATION} AS generation, count(*) AS documents FROM documents WHERE source IN ('src0', 'src4', 'src5') GROUP BY 1")
def active_generation_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("generation", strings.generation_id(F.lit("testdata"), F.col("source"), F.lit("v1")))
    active = docs.select("source").distinct().filter(F.col("source").isin("src0", "src4", "src5")).select(strings.generation_id(F.lit("testdata"), F.col("source"), F.lit("v1")).alias("generation"))
    return changelog.of_generations(docs, active).groupBy("generation").agg(F.count("*").alias("documents"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS identifier, CAST(30 AS DOUBLE) AS score FROM part WHERE regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') = 'brand12' ORDER BY CAST(p_partkey AS VARCHAR) LIMIT 50")
def ranked_query_identifier(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.array("p_brand").alias("identifiers"), F.col("p_brand").alias("identifier"), F.lit(True).alias("primary"))
    q = search.Query("Brand 12", full_text=False, limit=50)
    return search.page(search.ranked(parts, q, ["brand", "12"]), q).select("id", "identifier", "score")


@query(f"WITH {REC}, {bm25('b', 'body', TERMS)} SELECT id, round(2 * s, 4) AS score FROM b WHERE hits = 3 ORDER BY round(s, 6) DESC, id LIMIT 20")
def all_terms_conjunction(spark, sf_dir):
    found = C.index(spark, sf_dir).matches(TERMS, ["body"]).filter(F.col("n_body") == len(TERMS))
    return scored(found.select("id", (search.BOOSTS["all_terms"] * F.col("s_body")).alias("score")).orderBy(F.desc(F.round(F.col("score") / 2, 6)), "id").limit(20), "id")


@query(f"""WITH {REC}, {bm25('t', 'title', TERMS)}, {bm25('b', 'body', TERMS)},
h AS (SELECT id, count(DISTINCT term) AS n FROM (SELECT id, term FROM t_p UNION ALL SELECT id, term FROM b_p) GROUP BY id)
SELECT id, round(3 * coalesce(t.s, 0) + coalesce(b.s, 0), 4) AS score FROM h LEFT JOIN t USING (id) LEFT JOIN b USING (id) WHERE n = 3""")
def strict_recall(spark, sf_dir):
    return scored(tiered.clause_scores(C.index(spark, sf_dir), TERMS).filter("recall is not null").select("id", F.col("recall").alias("score")), "id")


_TIERS = f"""WITH {REC}, {bm25('t', 'title', TERMS)}, {bm25('b', 'body', TERMS)},
h AS (SELECT id, count(DISTINCT term) AS n FROM (SELECT id, term FROM t_p UNION ALL SELECT id, term FROM b_p) GROUP BY id),
f AS (SELECT t_t.id, len(list_filter(range(1, len(t_t.toks)), lambda i: t_t.toks[i:i + 2] = ['with', 'from', 'this'])) > 0 AS in_title,
  len(list_filter(range(1, len(b_t.toks)), lambda i: b_t.toks[i:i + 2] = ['with', 'from', 'this'])) > 0 AS in_body FROM t_t JOIN b_t USING (id)),
x AS (SELECT id, coalesce(t.s, 0) AS ts, coalesce(b.s, 0) AS bs, n, in_title, in_body FROM h LEFT JOIN t USING (id) LEFT JOIN b USING (id) JOIN f USING (id)),
y AS (SELECT id, 4 * ts + bs + CASE WHEN n = 3 THEN 2 * (4 * ts + bs) ELSE 0 END + CASE WHEN in_title THEN 8 * ts ELSE 0 END + CASE WHEN in_body THEN 3 * bs ELSE 0 END AS ranked, CASE WHEN n = 3 THEN 3 * ts + bs END AS recall FROM x)"""


@query(f"{_TIERS} SELECT id, round(ranked, 4) AS ranked, round(recall, 4) AS recall FROM y")
def tiered_clauses(spark, sf_dir):
    """Phrases, every term in title or body, and single terms, of the tiered ranker."""
    return tiered.clause_scores(C.index(spark, sf_dir), TERMS).select("id", F.round("ranked", 4).alias("ranked"), F.round("recall", 4).alias("recall"))


@query(f"""{_TIERS}, p AS (SELECT id, row_number() OVER (ORDER BY round(ranked, 6) DESC, id) AS rank FROM y WHERE ranked > 0 QUALIFY rank <= 250),
r AS (SELECT id, row_number() OVER (ORDER BY round(recall, 6) DESC, id) AS rank FROM y WHERE recall > 0 QUALIFY rank <= 250),
l AS (SELECT id, 0 AS tier, -rank::DOUBLE AS o FROM p WHERE rank <= 10),
s AS (SELECT id, 1 AS tier, sum(1.0 / (60 + rank)) AS o FROM (SELECT id, rank FROM p UNION ALL SELECT id, rank FROM r) WHERE id NOT IN (SELECT id FROM l) GROUP BY id),
u AS (SELECT id, CAST(row_number() OVER (ORDER BY tier, round(o, 9) DESC, id) AS INTEGER) AS rank FROM (SELECT * FROM l UNION ALL SELECT * FROM s))
SELECT '0:' || id AS id, rank, round(CAST(1.0 AS DOUBLE) / (60 + rank), 9) AS score FROM u""")
def tiered_fusion(spark, sf_dir):
    """Both tiers of the tiered ranker, fused."""
    return tiered.fused(C.index(spark, sf_dir), TERMS).select("id", "rank", F.round("score", 9).alias("score"))


@query("""WITH e AS (SELECT lower(p_brand) AS src, min(lower(p_name)) AS dst FROM part GROUP BY 1),
b AS (SELECT lower(p_name) AS t, min_by(p_name, (p_size % 2 <> 0, CAST(p_partkey AS VARCHAR))) AS title, min_by(CAST(p_partkey AS VARCHAR), (p_size % 2 <> 0, CAST(p_partkey AS VARCHAR))) AS key FROM part GROUP BY 1)
SELECT src AS name, key, title, true AS redirected FROM e JOIN b ON dst = t UNION ALL SELECT t, key, title, false FROM b""")
def canonical_titles(spark, sf_dir):
    """The record that each title leads to, of its own or through a redirect."""
    part = table(spark, sf_dir, "part")
    titles = part.select(F.col("p_partkey").cast("string").alias("key"), strings.normalize_title(F.col("p_name")).alias("title_exact"), F.col("p_name").alias("title"), (F.col("p_size") % 2 == 0).alias("primary"))
    edges = part.groupBy(F.lower("p_brand").alias("src")).agg(F.min(F.lower("p_name")).alias("dst"))
    return tiered.canonical(titles, edges.select(F.col("src").alias("name")).union(titles.select("title_exact")), edges)


@query(f"SELECT doc_id, CAST(len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS INTEGER) AS n FROM (SELECT doc_id, {tok('text')} AS t FROM documents) WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) > 0")
def phrase_match(spark, sf_dir):
    return C.index(spark, sf_dir).phrases(["of", "the"], ["body"]).select(F.col("id").cast("long").alias("doc_id"), "n")


# dates


def dated(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("published_at"), F.lit(True).alias("primary"), F.col("o_orderkey"))


_URGENT = ["urgent"]
_DATED = "rec AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey, o_orderpriority AS title, o_orderdate AS published_at FROM orders)"


def _dated_sql(where: str, order: str) -> str:
    return f"WITH {_DATED}, {bm25('t', 'title', _URGENT)} SELECT id, published_at, round(6 * s, 4) AS score FROM rec JOIN t USING (id) WHERE {where} ORDER BY {order} LIMIT 10"


def _dated(spark, sf_dir, **options) -> DataFrame:
    q = search.Query("urgent", full_text=False, **options)
    return scored(search.page(search.ranked(dated(spark, sf_dir), q, _URGENT), q), "id", "published_at")


@query(_dated_sql("published_at >= TIMESTAMP '1996-01-01' AND published_at <= TIMESTAMP '1996-12-31 23:59:59.999999'", "round(6 * s, 6) DESC, id"))
def search_date_range(spark, sf_dir):
    first, last = dates.search_bounds("1996")
    return _dated(spark, sf_dir, after=first, before=last)


@query(_dated_sql("true", "published_at DESC NULLS LAST, round(6 * s, 6) DESC, id"))
def search_newest(spark, sf_dir):
    return _dated(spark, sf_dir, sort="newest")


@query(_dated_sql("true", "published_at ASC NULLS LAST, round(6 * s, 6) DESC, id"))
def search_oldest(spark, sf_dir):
    return _dated(spark, sf_dir, sort="oldest")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS shown,
CASE o_orderkey % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS published_precision FROM orders""")
def search_date_precision(spark, sf_dir):
    kind = F.col("o_orderkey") % 3
    precision = F.when(kind == 0, "year").when(kind == 1, "month").otherwise("day")
    shown = F.when(kind == 0, F.date_format("o_orderdate", "yyyy")).when(kind == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"), precision.alias("published_precision"))


# many queries at once, fusion


@query(f"""WITH {REC}, q AS (SELECT item_id, unnest(list_distinct({tok('text')})) AS term FROM benchmark),
t AS (SELECT id, {tok('body')} AS toks FROM rec), s AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM t),
p AS (SELECT id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT id, unnest(toks) AS term, len(toks) AS l FROM t) WHERE term IN (SELECT term FROM q) GROUP BY id, term),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
x AS (SELECT item_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS sc FROM q JOIN p USING (term) JOIN d USING (term), s GROUP BY item_id, id),
r AS (SELECT item_id, id, sc, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(sc, 6) DESC, id) AS INTEGER) AS rank FROM x)
SELECT item_id, rank, id, round(sc, 4) AS score FROM r WHERE rank <= 3""")
def benchmark_batch_search(spark, sf_dir):
    """All terms of each text are asked for."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(strings.tokens(F.col("text"))).alias("terms"))
    return scored(search.batch(C.index(spark, sf_dir), asked, 3), "item_id", "rank", "id")


def _ranks(spark, sf_dir, column: str, k: int) -> DataFrame:
    docs = C.spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.length("text").alias("chars"), F.size(strings.tokens(F.col("text"))).alias("words"))
    best = docs.orderBy(F.desc(column), "id").limit(k)
    return best.select("id", F.row_number().over(Window.orderBy(F.desc(column), "id")).alias("rank"))


_LISTS = f"""docs AS (SELECT doc_id AS id, length(text) AS chars, len({tok('text')}) AS words FROM documents),
p AS (SELECT id, row_number() OVER (ORDER BY chars DESC, id) AS rank FROM docs QUALIFY rank <= 50),
b AS (SELECT id, row_number() OVER (ORDER BY words DESC, id) AS rank FROM docs QUALIFY rank <= 50)"""


@query(f"""WITH {_LISTS}, l AS (SELECT id, 0 AS tier, -rank::DOUBLE AS o FROM p WHERE rank <= 10),
s AS (SELECT id, 1 AS tier, sum(1.0 / (60 + rank)) AS o FROM (SELECT id, rank FROM p UNION ALL SELECT id, rank FROM b) WHERE id NOT IN (SELECT id FROM l) GROUP BY id),
u AS (SELECT id, CAST(row_number() OVER (ORDER BY tier, round(o, 9) DESC, id) AS INTEGER) AS rank FROM (SELECT * FROM l UNION ALL SELECT * FROM s))
SELECT id, rank, round(CAST(1.0 AS DOUBLE) / (60 + rank), 9) AS score FROM u""")
def rrf_fusion(spark, sf_dir):
    return fusion.fuse(_ranks(spark, sf_dir, "chars", 50), _ranks(spark, sf_dir, "words", 50)).select("id", "rank", F.round("score", 9).alias("score"))


@query("""SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS n FROM documents)
WHERE n = 1 AND NOT starts_with(text, 'The and')""")
def dedupe_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = docs.withColumn("key", F.sha2("text", 256))
    stubs = key.filter(F.startswith("text", F.lit("The and"))).select("key").distinct()
    return fusion.first_only(key, "key", [F.desc("n_chars"), F.col("doc_id")], stubs).select("doc_id", "source", "n_chars")


@query(f"""WITH {_LISTS}, h AS (SELECT id, rank, 1.0 / rank::DOUBLE AS score FROM p WHERE rank <= 20), e AS (SELECT 3::BIGINT AS id), m AS (SELECT 5::BIGINT AS id),
x AS (SELECT max(score) + 1 AS top, max(score) FILTER (rank = 1) AS second FROM h),
u AS (SELECT e.id, 0.0 AS o, top AS score FROM e, x UNION ALL SELECT m.id, 0.5, (top + second) / 2 FROM m, x UNION ALL SELECT id, rank, score FROM h WHERE id NOT IN (3, 5))
SELECT id, CAST(row_number() OVER (ORDER BY o, id) AS INTEGER) AS rank, round(score, 6) AS score FROM u""")
def tier_injection(spark, sf_dir):
    hits = _ranks(spark, sf_dir, "chars", 20).withColumn("score", 1.0 / F.col("rank").cast("double"))
    one = lambda i: spark.range(i, i + 1)
    return fusion.inject(hits, one(3), one(5)).select("id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH q AS (SELECT item_id, {tok('text')} AS t FROM benchmark),
n AS (SELECT item_id, t, len(t) AS n FROM q WHERE len(t) >= 3),
w AS (SELECT item_id, t, n, unnest(range(greatest(2, (2 * n + 4) // 5), least(n - 1, 8) + 1)) AS w FROM n),
g AS (SELECT item_id, t, w, unnest(range(1, n - w + 2)) AS i FROM w)
SELECT item_id, CAST(w AS INTEGER) AS width, CAST(i AS INTEGER) AS at, array_to_string(t[i:i + w - 1], ' ') AS span FROM g""")
def embedded_title_ngrams(spark, sf_dir):
    """Spans of whole texts; over 20 tokens the shortest span allowed is longer than the longest, so there is none."""
    q = table(spark, sf_dir, "benchmark").select("item_id", strings.tokens(F.col("text")).alias("t"))
    return q.select("item_id", F.inline(fusion.grams(F.col("t"))))


@query(f"""WITH q AS (SELECT item_id, list_sort(list_distinct({tok('text')})) AS t FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct({tok('text')})) AS term FROM documents),
m AS (SELECT item_id, doc_id FROM (SELECT item_id, len(t) AS n, unnest(t) AS term FROM q) JOIN d USING (term) GROUP BY item_id, doc_id, n HAVING count(*) = n),
c AS (SELECT item_id, count(*) AS c FROM m GROUP BY item_id), n AS (SELECT count(*) AS docs FROM documents)
SELECT item_id, coalesce(c, 0) AS matches, coalesce(c, 0) <= greatest(32, CASE WHEN len(t) = 2 THEN docs / 20000 ELSE docs / 1000 END) AS is_distinctive FROM q LEFT JOIN c USING (item_id), n""")
def distinctive_terms(spark, sf_dir):
    """All terms of each text.

    Only documents with an item's rarest term are looked at, so common terms make no pairs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(strings.tokens(F.col("text"))).alias("tokens"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(strings.tokens(F.col("text"))).alias("t"))
    n = docs.count()
    terms = asked.select("item_id", F.explode("t").alias("term"))
    held = docs.select("doc_id", "tokens", F.explode("tokens").alias("term"))
    often = held.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rarest = terms.join(often, "term", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("r")).select("item_id", F.col("r.term").alias("term"))
    whole = held.join(F.broadcast(rarest.join(asked, "item_id")), "term").filter(F.size(F.array_except("t", "tokens")) == 0)
    counts = whole.groupBy("item_id").agg(F.count("*").alias("c"))
    matches = F.coalesce("c", F.lit(0))
    return asked.join(counts, "item_id", "left").select("item_id", matches.alias("matches"), fusion.distinctive(matches, F.lit(float(n)), F.size("t")).alias("is_distinctive"))


# lookups


@query("""WITH t AS (SELECT doc_id, lower(trim(replace(substr(split_part(text, chr(10), 1), 1, 80), '_', ' '))) AS t FROM documents), w AS (SELECT t, min(doc_id) AS wanted FROM t GROUP BY t)
SELECT wanted, doc_id FROM t JOIN w USING (t)""")
def exact_title_lookup(spark, sf_dir):
    """Every title is asked for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", strings.normalize_title(C.title_of(F.col("text"))).alias("title_exact"))
    wanted = docs.groupBy("title_exact").agg(F.min("doc_id").alias("wanted"))
    return search.by_title(docs, wanted).select("wanted", "doc_id")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (1, 17, 42, 99)")
def id_lookup(spark, sf_dir):
    return search.by_ids(table(spark, sf_dir, "documents"), [1, 17, 42, 99], "doc_id").select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, lang, source, substr(split_part(text, chr(10), 1), 1, 80) AS title FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def late_metadata_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    best = docs.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)
    return search.with_metadata(best.select("doc_id"), docs, "doc_id", ["lang", "source", "text"]).select("doc_id", "lang", "source", C.title_of(F.col("text")).alias("title"))


# redirects

_EDGES = "e AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events WHERE event_type <> 'error'), f AS (SELECT src, dst FROM e WHERE dst IS NOT NULL)"


def event_edges(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").filter("event_type <> 'error'").select(F.col("event_id").alias("src"), F.lead("event_id").over(order).alias("dst")).filter("dst is not null")


@query(f"""WITH RECURSIVE {_EDGES}, r(id, target, hops) AS (SELECT src, src, 0 FROM f UNION ALL SELECT r.id, f.dst, r.hops + 1 FROM r JOIN f ON f.src = r.target WHERE r.hops < 8),
l AS (SELECT id, max(hops) AS hops, arg_max(target, hops) AS target FROM r GROUP BY id)
SELECT id, target, CAST(hops AS INTEGER) AS hops, hops = 8 AND target IN (SELECT src FROM f) AS exceeded FROM l""")
def redirect_chain_8(spark, sf_dir):
    """The chains from every edge."""
    edges = event_edges(spark, sf_dir)
    return redirects.follow(edges.select(F.col("src").alias("id")), edges).select("id", "target", "hops", "exceeded")


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents")
def redirect_canonical(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    first = docs.groupBy("key").agg(F.min("doc_id").alias("canonical"))
    return docs.join(first, "key").select(F.col("doc_id").alias("id"), "canonical")


def _guarded(spark, orders: DataFrame) -> DataFrame:
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 9), (4, 9)], "src long, dst long")
    keys = orders.select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 5).alias("start"))
    ends = redirects.follow(edges.select(F.col("src").alias("id")), edges).select(F.col("id").alias("start"), "target", "hops", "looped")
    return keys.join(ends, "start").select(F.col("key").alias("id"), "start", "hops", "target", "looped")


@query("SELECT o_orderkey AS id, o_orderkey % 5 AS start, CAST(CASE WHEN o_orderkey % 5 < 3 THEN 2 ELSE 1 END AS INTEGER) AS hops, CASE WHEN o_orderkey % 5 < 3 THEN (o_orderkey % 5 + 2) % 3 ELSE CAST(9 AS BIGINT) END AS target, o_orderkey % 5 < 3 AS looped FROM orders")
def redirect_loop_guard(spark, sf_dir):
    """All orders."""
    return _guarded(spark, table(spark, sf_dir, "orders"))


# change logs and generations

_LAST = "SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events"


@query(f"SELECT user_id, event_id, ts, event_type, value FROM ({_LAST}) WHERE n = 1 AND event_type <> 'error'")
def changelog_compact(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return changelog.compact(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "ts", "event_type", "value")


@query(f"SELECT user_id, event_id FROM ({_LAST}) WHERE n = 1 AND event_type = 'error'")
def tombstone_drop(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    kept = changelog.compact(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    last = changelog.compact(events, "user_id", ["ts", "event_id"], F.lit(False))
    return last.join(kept, "user_id", "left_anti").select("user_id", "event_id")


@query(f"SELECT event_type AS generation, count(*) AS documents FROM ({_LAST}) WHERE n = 1 AND event_type <> 'error' GROUP BY event_type")
def generation_doc_count(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return changelog.compact(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error").groupBy(F.col("event_type").alias("generation")).agg(F.count("*").alias("documents"))


@query("SELECT event_id, event_type AS generation FROM events WHERE event_type NOT IN ('click', 'error')")
def retired_cleanup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("generation"))
    retired = events.select("generation").distinct().filter(F.col("generation").isin("click", "error"))
    return changelog.without_generations(events, retired).select("event_id", "generation")


@query("""WITH b AS (SELECT source AS dataset, CAST(sum(octet_length(encode(split_part(text, chr(10), 1))) + octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY source)
SELECT dataset, bytes, CAST(floor(bytes::DOUBLE / (SELECT sum(bytes::DOUBLE) FROM b) * 54000000000.0::DOUBLE) AS BIGINT) AS share FROM b""")
def indexed_bytes_share(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    by = docs.groupBy(F.col("source").alias("dataset")).agg(F.sum(changelog.indexed_bytes("title", "text")).alias("bytes"))
    return changelog.storage_shares(by, 54_000_000_000).select("dataset", "bytes", "share")


# scalar functions


@query(f"SELECT DISTINCT source AS dataset, {_GENERATION} AS generation FROM documents")
def generation_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("dataset")).distinct().withColumn("generation", strings.generation_id(F.lit("testdata"), F.col("dataset"), F.lit("v1")))


def _b64(x: str) -> str:
    return f"rtrim(translate(base64(encode({x})), '+/', '-_'), '=')"


@query(f"SELECT doc_id, {_b64(_GENERATION)} || '.' || {_b64('CAST(doc_id AS VARCHAR)')} AS doc_key FROM documents")
def doc_keys(spark, sf_dir):
    generation = strings.generation_id(F.lit("testdata"), F.col("source"), F.lit("v1"))
    return table(spark, sf_dir, "documents").select("doc_id", strings.doc_key(generation, F.col("doc_id").cast("string")).alias("doc_key"))


@query("SELECT doc_id, lower(trim(replace(text, '_', ' '))) AS title FROM documents")
def normalize_title(spark, sf_dir):
    """Whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", strings.normalize_title(F.col("text")).alias("title"))


@query("SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS identifier, regexp_matches(regexp_replace(trim(p_brand), '[ -]', '', 'g'), '^[A-Za-z]{2,12}[0-9]{1,12}$') AS looks FROM part")
def normalize_identifier(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", strings.normalize_identifier(F.col("p_brand")).alias("identifier"), strings.looks_like_identifier(F.col("p_brand")).alias("looks"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS title FROM documents")
def reference_title(spark, sf_dir):
    """Whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", strings.reference_title(F.col("text")).alias("title"))


@query("SELECT p_partkey, rtrim(substr(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120), '-') AS slug FROM part")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", strings.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


# pages: links, titles, text, urls

_HREFS = """unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1))"""


@query(f"SELECT page_id, {_HREFS} AS href FROM pages")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(reading.hrefs(F.col("html"))).alias("href"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", reading.html_title(F.col("html")).alias("title"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS body FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", reading.html_text(F.col("html")).alias("body"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
regexp_extract(url, '#(.*)$', 1) AS fragment, regexp_matches(lower(url), '^(https?:)?//') AS is_external FROM pages""")
def url_parts(spark, sf_dir):
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("^[a-z]+://([^/?#]*)").alias("host"), part("^[a-z]+://[^/?#]*([^?#]*)").alias("path"), part("#(.*)$").alias("fragment"), strings.is_external_url(F.col("url")).alias("is_external"))


_TARGET = "regexp_extract(href, '^(?:[a-z]+://[^/?#]*)?([^?#]*)', 1)"


@query(f"""WITH l AS (SELECT page_id, {_HREFS} AS href FROM pages), p AS (SELECT min(page_id) AS target_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages GROUP BY path),
k AS (SELECT page_id, {_TARGET} AS path, count(*) AS n FROM l WHERE {_TARGET} <> '' GROUP BY 1, 2)
SELECT page_id, path, n, coalesce(target_id, -1) AS target_id FROM k LEFT JOIN p USING (path)""")
def link_resolution(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_extract("href", "^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1).alias("path")
    links = pages.select("page_id", F.explode(reading.hrefs(F.col("html"))).alias("href")).select("page_id", path).filter("path <> ''").groupBy("page_id", "path").agg(F.count("*").alias("n"))
    known = pages.groupBy(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path")).agg(F.min("page_id").alias("target_id"))
    return reading.resolved(links, known, "path", "target_id", -1).select("page_id", "path", "n", "target_id")


@query(f"""WITH l AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS src, {_HREFS} AS dst FROM pages)
SELECT src, dst, 'links_to' AS type, count(*) AS n FROM l WHERE dst <> '' GROUP BY src, dst""")
def relationship_edges(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("src")
    links = table(spark, sf_dir, "pages").select(host, F.explode(reading.hrefs(F.col("html"))).alias("dst")).filter("dst <> ''")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n")).select("src", "dst", F.lit("links_to").alias("type"), "n")


# reading


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS level, role || ' ' || CAST(turn AS VARCHAR) AS heading,
count(*) OVER (PARTITION BY conv_id) > 200 AS truncated FROM conversations QUALIFY place <= 200""")
def section_outline(spark, sf_dir):
    """Conversations as Markdown, a heading for each turn; its text stands in a code fence, so that only those are headings."""
    level = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("```"), F.lit("~~~"))
    part = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n```\n"), body, F.lit("\n```\n"))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("turn"), part.alias("p")))), lambda x: x["p"]), "").alias("text"))
    return reading.outline(whole, "conv_id", "text").select("conv_id", "place", "level", "heading", "truncated")


@query("""WITH t AS (SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS level FROM conversations),
f AS (SELECT conv_id, min(turn) AS first FROM t WHERE role = 'user' GROUP BY conv_id),
e AS (SELECT t.conv_id, min(turn) AS stop FROM t JOIN f USING (conv_id) WHERE turn > first AND level <= 1 GROUP BY t.conv_id)
SELECT conv_id, turn, role FROM t JOIN f USING (conv_id) LEFT JOIN e USING (conv_id) WHERE turn >= first AND turn < coalesce(stop, 1e18)""")
def section_extract(spark, sf_dir):
    level = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", level.alias("level"))
    return reading.section(turns, "conv_id", "turn", "level", "role", F.lit("user")).select("conv_id", "turn", "role")


@query("""SELECT doc_id, CAST(o AS INTEGER) AS "offset", CAST(length(substr(text, o + 1, 1000)) AS INTEGER) AS returned, CAST(length(text) AS INTEGER) AS total, o + length(substr(text, o + 1, 1000)) < length(text) AS truncated, sha256(substr(text, o + 1, 1000)) AS content_sha256
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) AS o FROM documents)""")
def page_slices(spark, sf_dir):
    cut = reading.slices(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1000)
    return cut.select("doc_id", "offset", "returned", "total", "truncated", F.sha2("content", 256).alias("content_sha256"))


@query("""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r(doc_id, text, "offset", "end") AS (SELECT doc_id, text, -1, 0 FROM t UNION ALL
  SELECT doc_id, text, o, CASE WHEN length(text) > o + 1000 AND back > 0 AND 1001 - back > 500 THEN o + 1001 - back ELSE least(o + 1000, length(text)) END
  FROM (SELECT doc_id, text, "end" AS o, strpos(reverse(substr(text, "end" + 1, 1000)), chr(10)) AS back FROM r WHERE "end" < length(text) OR "offset" < 0))
SELECT doc_id, CAST("offset" AS INTEGER) AS "offset", CAST("end" AS INTEGER) AS "end" FROM r WHERE "offset" >= 0""")
def slice_alignment(spark, sf_dir):
    """Every page of each text, one beginning where the one before it ends."""
    return reading.aligned_pages(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", 1000).select("doc_id", "offset", "end")


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"""WITH f AS (SELECT doc_id, {_FLAT} AS flat FROM documents),
a AS (SELECT *, least(coalesce(nullif(strpos(lower(flat), 'with'), 0), 1000000000), coalesce(nullif(strpos(lower(flat), 'from'), 0), 1000000000)) AS m FROM f)
SELECT doc_id, substr(flat, CAST(greatest(1, CASE WHEN m = 1000000000 THEN 1 ELSE m END - 73) AS BIGINT), 220) AS snippet FROM a""")
def snippet_first_term(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.snippet(F.col("text"), ["with", "from", "of"], 220).alias("snippet"))


@query("""SELECT conv_id, turn, CAST(least(length(text), 300) AS INTEGER) AS used, sum(least(length(text), 300)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 800 AS included FROM conversations""")
def reference_budget(spark, sf_dir):
    return reading.within_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 300, 800).select("conv_id", "turn", "used", "included")


# catalog

_SUPPLIERS = "SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def suppliers(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])
    return table(spark, sf_dir, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query(f"SELECT s_suppkey, n_name FROM ({_SUPPLIERS}) WHERE contains(lower(s_name || ' ' || n_name || ' ' || r_name), 'ia')")
def catalog_filter(spark, sf_dir):
    return catalog.matching(suppliers(spark, sf_dir), "IA", ["s_name", "n_name", "r_name"], []).select("s_suppkey", "n_name")


@query("SELECT lower(n_name) AS code, n_name AS name FROM nation")
def catalog_facets(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("code"), F.col("n_name").alias("name"))
    return catalog.language_facet(names.union(names.select("code", F.col("code"))))


@query("SELECT p_name AS id, count(DISTINCT p_brand) AS providers FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def catalog_collisions(spark, sf_dir):
    return catalog.collisions(table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_brand").alias("provider")))


@query(f"SELECT s_suppkey, s_name FROM ({_SUPPLIERS}) ORDER BY r_name, s_suppkey LIMIT 20 OFFSET 10")
def catalog_page(spark, sf_dir):
    return catalog.page(suppliers(spark, sf_dir), ["r_name", "s_suppkey"], 10, 20).select("s_suppkey", "s_name")


@query("SELECT p_brand AS dataset, min(p_type) AS primary_variant, count(DISTINCT p_type) AS n_variants, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS variant_list FROM part GROUP BY p_brand")
def catalog_variants(spark, sf_dir):
    return catalog.variants(table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), "p_type"), "dataset", "p_type")


_INSTALLED = "i AS (SELECT o_custkey AS id, CAST(max(o_orderkey) % 7 AS VARCHAR) AS f FROM orders GROUP BY o_custkey), c AS (SELECT c_custkey AS id, CAST(c_custkey % 7 AS VARCHAR) AS g FROM customer)"


def _installed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    have = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.max("o_orderkey") % 7).cast("string").alias("fingerprint"))
    offered = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).cast("string").alias("fingerprint"))
    return have, offered


@query(f"WITH {_INSTALLED} SELECT id, f IS NOT NULL AS installed, coalesce(f <> g, false) AS update_available FROM c LEFT JOIN i USING (id)")
def installed_overlay(spark, sf_dir):
    have, offered = _installed(spark, sf_dir)
    return catalog.overlay(offered, have).select("id", "installed", "update_available")


@query(f"WITH {_INSTALLED} SELECT id, f AS have, g AS latest FROM c JOIN i USING (id) WHERE f <> g")
def upgrade_diff(spark, sf_dir):
    have, offered = _installed(spark, sf_dir)
    return catalog.upgrades(have, offered).select("id", "have", "latest")


_PARTS = "prev AS (SELECT o_orderkey AS k, md5(o_orderstatus) AS h FROM orders WHERE o_orderkey % 4 <> 0), cur AS (SELECT o_orderkey AS k, md5(CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END) AS h FROM orders)"


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    previous = orders.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), F.md5("o_orderstatus").alias("h"))
    return previous, orders.select(F.col("o_orderkey").alias("k"), F.md5(F.when(F.col("o_orderkey") % 5 == 0, "new").otherwise(F.col("o_orderstatus"))).alias("h"))


@query(f"WITH {_PARTS} SELECT k, h FROM cur SEMI JOIN prev USING (k, h)")
def part_reuse(spark, sf_dir):
    return changelog.reuse(*_parts(spark, sf_dir), ["k"], "h")[0].select("k", "h")


@query(f"WITH {_PARTS} SELECT k, h FROM cur ANTI JOIN prev USING (k, h)")
def part_download(spark, sf_dir):
    return changelog.reuse(*_parts(spark, sf_dir), ["k"], "h")[1].select("k", "h")


@query("SELECT o_orderpriority AS release, sha256(string_agg(CAST(o_orderkey AS VARCHAR) || chr(9) || md5(o_orderstatus), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))) AS fingerprint FROM orders GROUP BY 1")
def release_fingerprint(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("release"), F.col("o_orderkey").cast("string").alias("name"), F.md5("o_orderstatus").alias("digest"))
    return changelog.fingerprint(parts, "release", "name", "digest")


# jobs

#: Event types as job events.
_STATE = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'canceled' WHEN 'view' THEN 'indexing' ELSE 'queued' END"


def job_events(spark, sf_dir) -> DataFrame:
    state = F.expr(_STATE)
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", state.alias("state"), "value")


_JOB_EVENTS = f"j AS (SELECT user_id, ts, event_id, {_STATE} AS state, value FROM events)"


@query(f"WITH {_JOB_EVENTS} SELECT user_id, event_id, state FROM j QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_job(spark, sf_dir):
    return catalog.latest_job(job_events(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "state")


@query(f"""WITH {_JOB_EVENTS}, a AS (SELECT user_id AS id, arg_max(state, (ts, event_id)) AS state, min(ts) AS created_at, max(ts) AS updated_at FROM j GROUP BY user_id)
SELECT id, state, CAST(row_number() OVER (ORDER BY state IN ('completed', 'failed', 'canceled'), CASE WHEN state NOT IN ('completed', 'failed', 'canceled') THEN created_at END NULLS FIRST,
  CASE WHEN state IN ('completed', 'failed', 'canceled') THEN updated_at END DESC NULLS LAST, id) AS INTEGER) AS place FROM a""")
def job_order(spark, sf_dir):
    jobs = job_events(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    return catalog.pipeline_order(jobs).select("id", "state", "place")


@query("""SELECT user_id, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failures, arg_max(event_type, (ts, event_id)) AS last_event,
CAST(count(*) - count(*) FILTER (event_type IN ('error', 'purchase')) AS BIGINT) AS steps FROM events GROUP BY user_id""")
def job_state_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return catalog.folded_jobs(events, "user_id", ["ts", "event_id"], "event_type", "error", ["error", "purchase"]).select("user_id", "failures", F.col("last").alias("last_event"), "steps")


@query("""WITH h AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events)
SELECT user_id, event_id, value FROM h WHERE high IS NULL OR value >= high""")
def progress_monotone(spark, sf_dir):
    return catalog.monotone(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "value")


# storage


@query("""SELECT CAST(sum(l_linenumber) AS BIGINT) AS total_bytes, CAST(sum(l_linenumber) FILTER (l_returnflag = 'A') AS BIGINT) AS a_bytes, CAST(sum(l_linenumber) FILTER (l_returnflag = 'R') AS BIGINT) AS r_bytes,
CAST(sum(l_linenumber) FILTER (l_returnflag NOT IN ('A', 'R')) AS BIGINT) AS other_bytes FROM lineitem""")
def storage_breakdown(spark, sf_dir):
    return catalog.storage_breakdown(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", ["A", "R"])


@query("""WITH o AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS "offset" FROM lineitem), s AS (SELECT max(l_partkey) + 1 AS size FROM lineitem)
SELECT file, "offset", coalesce(lead("offset") OVER (PARTITION BY file ORDER BY "offset"), size) AS "end" FROM o, s""")
def stream_offsets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    size = lines.agg(F.max("l_partkey") + 1).scalar()
    return catalog.stream_ranges(lines.select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("offset"), size.alias("size")), "file", "offset", "size").select("file", "offset", "end")


# references


@query("SELECT user_id, max(ts) + INTERVAL 7 DAY AS expires_at, max(ts) + INTERVAL 7 DAY > TIMESTAMP '2024-02-05 00:00:00' AS live FROM events GROUP BY user_id")
def refs_expiry(spark, sf_dir):
    return references.expiry(table(spark, sf_dir, "events"), "user_id", "ts", "2024-02-05 00:00:00")


@query("""WITH l AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, CAST(count(*) FILTER (before IS NULL OR ts >= before + INTERVAL 1 DAY) AS BIGINT) AS minted, CAST(count(*) FILTER (before IS NOT NULL AND ts < before + INTERVAL 1 DAY) AS BIGINT) AS reused FROM l GROUP BY user_id""")
def refs_reuse(spark, sf_dir):
    return references.usage(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "ts", "interval 1 day")


# dates and identifiers of providers


@query("""SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + CAST((o_orderkey % 31) AS INTEGER) AS TIMESTAMP) AS published_at, 'day' AS precision FROM orders""")
def pubmed_dates(spark, sf_dir):
    at, precision = dates.citation_date(F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MMM"), (F.col("o_orderkey") % 31 + 1).cast("string"), F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", at.alias("published_at"), precision.alias("precision"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('month', o_orderdate) ELSE date_trunc('year', o_orderdate) END AS TIMESTAMP) AS published_at, CASE WHEN o_orderkey % 2 = 0 THEN 'month' ELSE 'year' END AS precision FROM orders""")
def rfc_dates(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM yyyy")).otherwise(F.date_format("o_orderdate", "yyyy"))
    at, precision = dates.catalog_date(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", at.alias("published_at"), precision.alias("precision"))


@query("SELECT o_orderkey, 'RFC ' || CAST(o_orderkey % 10000 AS VARCHAR) AS ref FROM orders")
def rfc_refs(spark, sf_dir):
    raw = F.concat(F.lit("rfc"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.document_ref(raw).alias("ref"))


# transforms that SQL cannot express; tests hold them against literal results


@query(None)
def html_markdown(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "pages").select("page_id", markup.markdown_udf("html").alias("markdown"))


@query(None)
def html_plain(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "pages").select("page_id", markup.text_udf("html").alias("text"))


@query(None)
def wiki_plain_text(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", wikitext.plain_text_udf(wikitext_of("text")).alias("text"))


@query(None)
def wiki_markdown(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", wikitext.markdown_udf(wikitext_of("text"), F.lit("https://wiki.test")).alias("markdown"))


def wikitext_of(text: str) -> F.Column:
    """A text dressed as a wiki page: its first line as a heading, source and language as links and a template."""
    head = F.substring_index(text, "\n", 1)
    return F.concat(F.lit("== "), head, F.lit(" ==\n"), F.substring(text, F.length(head) + 2, F.length(text)), F.lit("\n[[Category:"), F.col("source"), F.lit("]] [["), F.col("lang"), F.lit("|language]] {{convert|1|km}}<ref>"), F.col("source"), F.lit("</ref>"))


@query(None)
def snippet_window(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "documents").select("doc_id", passages.snippet_udf("text", F.lit(QUERY), F.lit(220)).alias("snippet"))


@query(ORACLE_SQL["changelog_compact"])
def stream_changelog(spark, sf_dir):
    """The compaction as a stream over the event file, drained to its end."""
    return streamed.compacted_stream(spark, f"{sf_dir}/events.parquet", "user_id", ["ts", "event_id"], "event_type = 'error'").select("user_id", "event_id", "ts", "event_type", "value")
