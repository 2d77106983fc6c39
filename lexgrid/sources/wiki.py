"""Wiki exports: page XML (plain, gz or bz2), multistream index lines, and records from both."""

from __future__ import annotations

import bz2
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexgrid import schemas
from lexgrid.functions import dates, strings, wikitext
from lexgrid.runtime import map_batches, materialise, numbered, ship
from lexgrid.sources.cursors import SparseCursor
from lexgrid.sources.records import as_records


def pages(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """Pages of the export files at a path, with file; Spark splits files at pages."""
    rows = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", "true").schema(schemas.WIKI_PAGE).load(path)
    rows = rows.withColumn("file", F.input_file_name())
    return rows.filter(F.col("id").isin(ids)) if ids is not None else rows


def is_redirect(rows: DataFrame) -> F.Column:
    return F.col("redirect").isNotNull() | (strings.redirect_target(F.col("revision.text")) != "")


def target(rows: DataFrame) -> F.Column:
    named = F.col("redirect._title")
    return F.coalesce(named, F.nullif(strings.redirect_target(F.col("revision.text")), F.lit("")))


def records(spark: SparkSession, path: str, dataset: str, base: str, bodies: bool = True) -> DataFrame:
    """Pages as records; redirects are secondary and have no body. Without bodies, texts are not rendered."""
    ship(spark)
    rows = pages(spark, path)
    redirects = is_redirect(rows)
    body = F.when(redirects, "").otherwise(wikitext.plain_text_udf(F.coalesce("revision.text", F.lit("")))) if bodies else F.lit("")
    return as_records(
        rows, "wiki", dataset, id=F.col("id").cast("string"), title="title", body=body, url=strings.page_url(F.lit(base), F.col("title")), locator=F.concat(F.lit("file:"), F.col("file")),
        namespace="ns", primary=(F.col("ns") == 0) & ~redirects, modified_at=dates.revision_time(F.col("revision.timestamp")), seq="id",
    )


def redirect_edges(spark: SparkSession, path: str) -> DataFrame:
    """src and dst titles (normalized) and the fragment of each redirect."""
    rows = pages(spark, path)
    to, fragment = strings.title_and_fragment(target(rows))
    return rows.filter(is_redirect(rows)).select(strings.normalize_title(F.col("title")).alias("src"), strings.normalize_title(to).alias("dst"), fragment.alias("fragment"))


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """offset, page_id, title of lines offset:id:title (titles may hold colons); bad lines raise an error when they are read."""
    field = F.split("value", ":", 3)
    offset, page_id = F.get(field, 0).try_cast("long"), F.get(field, 1).try_cast("long")
    ok = (offset >= 0) & (page_id > 0) & (F.size(field) == 3)
    checked = F.when(F.coalesce(ok, F.lit(False)), F.struct(offset.alias("offset"), page_id.alias("page_id"), F.get(field, 2).alias("title"))).otherwise(F.raise_error(F.concat(F.lit("bad index line: "), F.col("value"))))
    return spark.read.text(path).filter("value <> ''").select(checked.alias("x")).select("x.*")


def streams(lines: DataFrame, size: int) -> DataFrame:
    """offset and end of each stream: it ends where the next one begins, the last at the file's size."""
    at = materialise(numbered(lines.select("offset").distinct(), [F.col("offset").asc()], "n"), "streams")
    after = at.select((F.col("n") - 1).alias("n"), F.col("offset").alias("end"))
    return at.join(after, "n", "left").select("offset", F.coalesce("end", F.lit(size)).alias("end"))


def wanted_streams(lines: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """offset, end and ids: the pages that are wanted of each stream (column page_id)."""
    ids = lines.join(wanted.select("page_id").distinct(), "page_id", "left_semi").groupBy("offset").agg(F.sort_array(F.collect_set("page_id")).alias("ids"))
    return streams(lines, size).join(ids, "offset")


def selected(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """Pages that wanted_streams() names, from a multistream file: only their byte ranges are read, each range by itself.

    offset, id, title, ns, text of each page found; path has to be readable from every executor."""

    return map_batches(ranges.select("offset", "end", "ids").repartition("offset"), _stream_reader(path), PAGE)


def _stream_reader(path: str):
    """Rows of PAGE from batches of offset, end and, where only some pages are wanted, ids."""
    schema = to_arrow_schema(T.StructType.fromDDL(PAGE))

    def read(batches):
        for b in batches:
            rows = []
            with open(path, "rb") as f:
                for offset, end, *ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    f.seek(offset)
                    rows += [(offset, *p) for p in pages_of_stream(bz2.decompress(f.read(end - offset))) if not ids or p[0] in ids[0]]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return read


PAGE = "offset long, id long, title string, ns int, text string"


def pages_of_stream(xml: bytes) -> Iterator[tuple[int, str, int, str]]:
    """(id, title, ns, text) of the pages of one stream, which is XML without a root."""
    for page in ET.fromstring(b"<s>" + xml.replace(b"</mediawiki>", b"") + b"</s>").iter("page"):
        yield int(page.findtext("id")), page.findtext("title") or "", int(page.findtext("ns") or 0), page.findtext("revision/text") or ""


def scan_bodies(spark: SparkSession, path: str, ranges: list[tuple[int, int]], cursor: str, out: str, batch: int = 64) -> Iterator[str]:
    """Bodies of a multistream file as Parquet under `out`, stream by stream; yields the cursor after each batch of streams.

    A batch is written before its streams count as done, so a scan that was stopped goes on after the last cursor."""
    done = SparseCursor.parse(cursor, len(ranges))
    left = [i for i in range(len(ranges)) if not done.completed(i)]
    for at in range(0, len(left), batch):
        mine = left[at : at + batch]
        rows = spark.createDataFrame([ranges[i] for i in mine], "offset long, end long")

        map_batches(rows.repartition(min(len(mine), spark.sparkContext.defaultParallelism), "offset"), _stream_reader(path), PAGE).write.mode("overwrite").parquet(f"{out}/streams={mine[0]}-{mine[-1]}")
        for i in mine:
            done.complete(i)
        yield str(done)
