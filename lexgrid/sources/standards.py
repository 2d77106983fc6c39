"""Standards: the catalog XML and the raw texts, as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udf
from pyspark.sql.types import StringType

from lexgrid import schemas
from lexgrid.functions import dates, standards, strings
from lexgrid.runtime import ship
from lexgrid.sources.records import as_records


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries that exist as text, by number: id, title, authors, status, stream, keywords, related documents, date."""
    rows = spark.read.format("xml").option("rowTag", "rfc-entry").option("ignoreNamespace", "true").schema(schemas.RFC_ENTRY).load(path)
    rows = rows.filter(F.exists(F.col("format.file-format"), lambda x: F.upper(F.trim(x)) == "TXT"))
    refs = lambda c: F.transform(F.coalesce(F.col(f"`{c}`.`doc-id`"), F.array().cast("array<string>")), strings.document_ref)
    month, year = F.coalesce("date.month", F.lit("")), F.coalesce("date.year", F.lit(""))
    at, precision = dates.catalog_date(F.trim(F.concat(month, F.lit(" "), year)))
    return rows.select(
        F.regexp_replace(F.upper("`doc-id`"), "^RFC0*", "").alias("id"), "title", F.col("author.name").alias("authors"), F.lower("current-status").alias("status"), "stream",
        F.coalesce("keywords.kw", F.array().cast("array<string>")).alias("keywords"), refs("obsoletes").alias("obsoletes"), refs("obsoleted-by").alias("obsoleted_by"), refs("updates").alias("updates"),
        refs("updated-by").alias("updated_by"), refs("is-also").alias("also"), refs("see-also").alias("see_also"), at.alias("published_at"), precision.alias("published_precision"),
    ).orderBy(F.col("id").cast("int"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """id and content of the files rfcN.txt at a path."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"rfc0*([0-9]+)\.txt$", 1).alias("id"), F.col("value").alias("content"))


@udf(StringType())
def _markdown(number, title, content, entry):
    return standards.markdown(number, title, content, standards.relationships(entry.asDict()), entry["status"] or "")


def records(entries: DataFrame, raw: DataFrame, dataset: str = "rfc") -> DataFrame:
    """Obsoleted and historic documents weigh less."""
    ship(entries.sparkSession)
    rows = entries.join(raw, "id")
    number = F.concat(F.lit("RFC "), F.col("id"))
    weight = F.when(F.size("obsoleted_by") > 0, 0.65).when(F.upper("status") == "HISTORIC", 0.8).otherwise(1.0)
    entry = F.struct("status", "obsoletes", "obsoleted_by", "updates", "updated_by", "also", "see_also")
    return as_records(
        rows, "rfc", dataset, id="id", title="title", body=_markdown("id", "title", "content", entry), identifiers=F.concat(F.array(number), F.col("also")), aliases=F.array(number, F.concat(F.lit("RFC"), F.col("id"))),
        keywords=F.concat("keywords", F.array_compact(F.array("stream", "status"))), status="status", rank_weight=weight, published_at="published_at", published_precision="published_precision", seq=F.col("id").cast("long"),
    )
