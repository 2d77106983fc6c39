"""The given tables as records, in Spark and in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.functions import strings
from lexgrid.operators import postings
from lexgrid.operators.postings import Index
from lexgrid.runtime import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a table is too small for one split a core; larger ones stay as they are read."""
    spark = rows.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * split else rows


_INDEXES: dict[tuple[str, str], Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The postings of plain(); written once a session, when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        postings.write(plain(spark, sf_dir), ["title", "keywords", "body"], path, 16)
        _INDEXES[key] = Index(spark, [path], 16)
    return _INDEXES[key]


def title_of(text: F.Column) -> F.Column:
    return F.substring(F.substring_index(text, "\n", 1), 1, 80)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as records: the first line is the title, low quality is secondary, toxic weighs less."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        "doc_id",
        title_of(F.col("text")).alias("title"),
        F.col("text").alias("body"),
        F.array("lang", "source").alias("keywords"),
        "lang",
        F.col("source").alias("dataset"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("primary"),
        F.when(F.col("toxic") == 1, 0.65).otherwise(1.0).alias("rank_weight"),
    )


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents alone, all of them primary and of one weight."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", title_of(F.col("text")).alias("title"), F.col("text").alias("body"), F.array("lang", "source").alias("keywords"), "lang", F.col("source").alias("dataset"), F.lit(True).alias("primary")
    )


REC = """
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
rec AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id, substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS body, lang || ' ' || source AS keywords,
  lang, source AS dataset, coalesce(quality, 1) = 1 AS is_primary, CASE WHEN toxic = 1 THEN 0.65 ELSE 1.0 END AS w FROM documents d LEFT JOIN lab USING (doc_id))"""

P = strings.TOKEN.replace("'", "''")


def tok(expr: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), '{P}')"


def bm25(name: str, expr: str, terms: list[str], source: str = "rec") -> str:
    """CTEs that end in name(id, s, hits)."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
{name}_t AS (SELECT id, {tok(expr)} AS toks FROM {source}),
{name}_s AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM {name}_t),
{name}_p AS (SELECT id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT id, unnest(toks) AS term, len(toks) AS l FROM {name}_t) WHERE term IN ({listed}) GROUP BY id, term),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name} AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS s, count(*) AS hits
  FROM {name}_p JOIN {name}_d USING (term), {name}_s GROUP BY id)"""
