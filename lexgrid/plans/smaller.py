"""Registered queries of single functions and smaller operators, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexgrid.functions import dates, strings
from lexgrid.operators import catalog, changelog, fusion, search
from lexgrid.plans.carriers import table, title_of
from lexgrid.plans.catalogue import query
from lexgrid.sources import legal, listings

# predicates and projections


@query("SELECT doc_id FROM documents WHERE trim(substr(split_part(text, chr(10), 1), 1, 80)) <> ''")
def record_validity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), title_of(F.col("text")).alias("title"))
    return changelog.valid(docs).select("doc_id")


@query("SELECT c_custkey, regexp_matches(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END || 'wiki', '^[a-z0-9_]+(wiki|wiktionary|wikibooks|wikinews|wikiquote|wikisource|wikiversity|wikivoyage)$') AS valid FROM customer")
def wiki_name_predicate(spark, sf_dir):
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")), F.lit("wiki"))
    return table(spark, sf_dir, "customer").select("c_custkey", listings.valid_wiki_name(name).alias("valid"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey % 4 = 0")
def namespace_zero(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("namespace", (F.col("o_custkey") % 4).cast("int"))
    return search.in_namespaces(rows, [0]).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey AS id, p_name AS name, p_type AS kind FROM part")
def catalog_projection(spark, sf_dir):
    """What callers see of the catalog: without brand, size and price."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("fingerprint"), (F.col("p_size") > 10).alias("closed"))
    return catalog.public(rows)


@query("SELECT o_orderkey, CAST(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'soon' ELSE CAST(o_orderdate AS VARCHAR) END AS TIMESTAMP) AS TIMESTAMP) AS published_at FROM orders")
def temporal_projection(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise(F.col("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.or_null(text).cast("timestamp_ntz").alias("published_at"))


# sizes, urls, links


@query(
    "SELECT doc_id, CASE WHEN b >= 1125899906842624 THEN CAST(round(b / 1125899906842624, 1) AS VARCHAR) || ' PiB' WHEN b >= 1099511627776 THEN CAST(round(b / 1099511627776, 1) AS VARCHAR) || ' TiB' WHEN b >= 1073741824 THEN CAST(round(b / 1073741824, 1) AS VARCHAR) || ' GiB' WHEN b >= 1048576 THEN CAST(round(b / 1048576, 1) AS VARCHAR) || ' MiB' WHEN b >= 1024 THEN CAST(round(b / 1024, 1) AS VARCHAR) || ' KiB' ELSE CAST(b AS VARCHAR) || ' B' END AS size FROM (SELECT doc_id, n_chars * 97 AS b FROM documents)"
)
def human_sizes(spark, sf_dir):
    """Sizes of every document, null ones as null."""
    return table(spark, sf_dir, "documents").select("doc_id", strings.human_bytes(F.col("n_chars") * 97).alias("size"))


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 1024 WHEN 2 THEN o_custkey * 1048576 ELSE -1 END AS BIGINT) AS size FROM orders")
def listing_sizes(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("", "K", "M", "?"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(strings.parse_size(F.concat(F.col("o_custkey").cast("string"), unit)), F.lit(-1)).alias("size"))


@query("SELECT n_nationkey, 'https://wiki.test/wiki/' || replace(n_name, ' ', '_') AS url FROM nation")
def page_urls(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", strings.page_url(F.lit("https://wiki.test"), F.col("n_name")).alias("url"))


@query("SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS fragment FROM part")
def link_targets(spark, sf_dir):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("#"), F.replace("p_type", F.lit(" "), F.lit("_")))).otherwise(F.lit("")))
    title, fragment = strings.title_and_fragment(raw)
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), fragment.alias("fragment"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE '3' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || 'R' END AS celex FROM orders")
def celex_links(spark, sf_dir):
    number = F.concat(F.lit("3"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.lit("r"))
    kind = F.col("o_orderkey") % 3
    href = F.when(kind == 0, F.concat(F.lit("https://law.test/TXT/?uri=CELEX%3A"), number)).when(kind == 1, F.concat(F.lit("/celex/"), number, F.lit("#a"))).otherwise(F.lit("https://law.test/other"))
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.celex_of_link(href).alias("celex"))


@query("SELECT o_orderkey, 'x' || CAST(o_orderkey AS VARCHAR) || '.0001' AS id FROM orders")
def cellar_ids(spark, sf_dir):
    uri = F.concat(F.lit("http://law.test/resource/cellar/x"), F.col("o_orderkey").cast("string"), F.lit(".0001/DOC_1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.cellar_id(uri).alias("id"))


@query("SELECT l_orderkey, l_linenumber, l_partkey AS part, l_suppkey AS \"offset\", CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE -1 END AS \"end\" FROM lineitem")
def stream_locators(spark, sf_dir):
    text = F.concat_ws(":", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey").cast("string")).otherwise("x"))
    part, offset, end = strings.stream_location(text)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", part.alias("part"), offset.alias("offset"), F.coalesce(end, F.lit(-1)).alias("end"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS target FROM part")
def redirect_directives(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" #Redirect: [[ "), F.col("p_name"), F.lit(" |x]] tail"))).otherwise(F.concat(F.lit("see [["), F.col("p_name"), F.lit("]]")))
    return table(spark, sf_dir, "part").select("p_partkey", strings.redirect_target(text).alias("target"))


@query("SELECT p_partkey, '\\[' || p_brand || '\\]' AS label, p_name || '\\|' || p_type AS cell FROM part")
def markdown_escapes(spark, sf_dir):
    label = strings.escape_markdown(F.concat(F.lit("["), F.col("p_brand"), F.lit("]")))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), strings.escape_cell(F.concat_ws("|", "p_name", "p_type")).alias("cell"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN p_name ELSE '' END AS value FROM part")
def first_values(spark, sf_dir):
    first = F.when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise("  ")
    second = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", strings.first_nonempty(first, second).alias("value"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM documents")
def collapsed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", strings.collapse(F.col("text")).alias("body"))


# dates


@query("SELECT o_orderkey, o_orderdate AS at, strftime(o_orderdate, '%Y%m%d') AS compact FROM orders")
def revision_times(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.revision_time(text).cast("timestamp_ntz").alias("at"), dates.compact_date(F.col("o_orderdate")).alias("compact"))


@query("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month FROM orders")
def listing_months(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.listing_month(F.date_format("o_orderdate", "dd-MMM-yyyy")).cast("string").alias("month"))


@query("SELECT l_orderkey, arg_max(l_shipdate, (CASE l_returnflag WHEN 'A' THEN 3 WHEN 'R' THEN 2 ELSE 1 END, l_linenumber, l_shipdate)) AS published_at FROM lineitem GROUP BY l_orderkey")
def publication_priority(spark, sf_dir):
    """The date with the highest priority; of equal ones the later entry."""
    priority = F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "R", 2).otherwise(1)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(dates.by_priority(F.col("l_shipdate"), priority, F.col("l_linenumber")).alias("published_at"))


# aggregations, windows and sets


@query("SELECT o_orderpriority AS release, count(*) AS parts, CAST(sum(o_custkey) AS BIGINT) AS bytes, max(o_orderdate) AS updated_at FROM orders GROUP BY o_orderpriority")
def release_totals(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("release"), F.col("o_custkey").alias("size"), F.col("o_orderdate").alias("updated_at"))
    return catalog.release_totals(parts, "release", "size", "updated_at")


@query("SELECT l_suppkey AS stream, count(DISTINCT l_partkey) AS wanted, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS ids FROM lineitem GROUP BY l_suppkey")
def wanted_by_stream(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stream"), F.col("l_partkey").cast("string").alias("id"))
    return catalog.wanted_ids(wanted, "stream", "id").select("stream", "wanted", F.array_join("ids", ",").alias("ids"))


@query("SELECT event_type AS provider, arg_max(value, (ts, event_id)) >= 50 AS healthy, max(ts) AS checked_at FROM events GROUP BY event_type")
def provider_status(spark, sf_dir):
    checks = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), "ts", "event_id", (F.col("value") >= 50).alias("healthy"))
    return catalog.provider_status(checks, "provider", ["ts", "event_id"], "healthy").select("provider", "healthy", F.col("ts").alias("checked_at"))


@query("SELECT user_id AS dataset, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id")
def latest_failed_job(spark, sf_dir):
    return catalog.latest_job(table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("dataset"), "ts", "event_id"), "dataset", ["ts", "event_id"]).select("dataset", "event_id")


@query("SELECT p_name AS name, arg_min(p_type, (p_size, p_type)) AS url FROM part GROUP BY p_name")
def mirror_choice(spark, sf_dir):
    links = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("https://"), F.col("p_type")).alias("url"), F.col("p_size").alias("priority"))
    return listings.mirror(links).select("name", F.substring("url", 9, 200).alias("url"))


@query("SELECT p_name AS celex, p_brand AS expression, format FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'xhtml' ELSE 'html' END AS format, row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END, p_brand) AS n FROM part) WHERE n = 1")
def one_expression(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("celex"), F.col("p_brand").alias("expression"), F.when(F.col("p_size") % 2 == 0, "xhtml").otherwise("html").alias("format"))
    return legal.one_expression(rows)


@query("SELECT name, CAST(row_number() OVER (ORDER BY stage, name) - 1 AS INTEGER) AS part FROM (SELECT DISTINCT 0 AS stage, p_brand AS name FROM part UNION ALL SELECT DISTINCT 1, p_type FROM part)")
def ordered_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return listings.ordered_parts(part.select(F.col("p_brand").alias("name")).distinct(), part.select(F.col("p_type").alias("name")).distinct()).select("name", "part")


@query("SELECT 'a' AS provider, n_name AS id FROM nation UNION ALL SELECT 'b', r_name FROM region")
def catalog_union(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.lit("a").alias("provider"), F.col("n_name").alias("id"))
    return catalog.together([nations, table(spark, sf_dir, "region").select(F.lit("b").alias("provider"), F.col("r_name").alias("id"))])


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'a,b' ELSE 'a,b,' || lower(n_name) END AS added, 'b' AS removed FROM nation")
def retired_list(spark, sf_dir):
    """A set of retired generations, with one added and one removed."""
    held, new = F.array(F.lit("a"), F.lit("b")), F.when(F.col("n_regionkey") == 0, "a").otherwise(F.lower("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(changelog.retired(held, new), ",").alias("added"), F.array_join(changelog.unretired(held, F.lit("a")), ",").alias("removed"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 'search,read' WHEN c_acctbal > 0 THEN 'read' ELSE '' END AS capabilities FROM customer")
def local_summary(spark, sf_dir):
    has = catalog.capabilities(F.col("c_acctbal") > 5000, F.col("c_acctbal") > 0)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(has, ",").alias("capabilities"))


@query("SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN NOT regexp_matches(id, '^[a-z0-9][a-z0-9._-]{0,127}$') THEN 'id' WHEN description = '' THEN 'description' WHEN p_size % 7 = 0 THEN 'variants' END AS reason FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'part-' || CAST(p_partkey AS VARCHAR) END AS id, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS description, p_size FROM part)) WHERE reason IS NOT NULL GROUP BY reason")
def catalog_validation(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    id_ = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")))
    variants = F.when(F.col("p_size") % 7 != 0, F.array("p_type"))
    rows = part.select(id_.alias("id"), F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name")).alias("description"), variants.alias("variants"))
    return catalog.invalid(rows).groupBy("reason").agg(F.count("*").alias("rows"))


@query("SELECT id, score FROM (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS n FROM documents) WHERE n <= 110 AND n > 100")
def candidate_window(spark, sf_dir):
    """A page is cut from the bounded window of the best candidates."""
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").cast("double").alias("score"), F.lit(False).alias("is_exact"))
    return search.page(hits, search.Query("any", offset=100, limit=10)).select("id", "score")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 0 ELSE value END AS score FROM events")
def score_cleanup(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, float("nan")).when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", fusion.clean_score(raw).alias("score"))


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS next_turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM conversations")
def section_ranges(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    upto = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.lead("turn").over(order), F.lit(-1)).alias("next_turn"), upto.alias("upto"))
