"""Postings of records as Parquet: written once with a generation, read by every search after.

A row is a term in a field of a record: id, how often it stands there, where, and the field's length. Each record is
turned into its rows by itself, so nothing is gathered before the one shuffle that orders rows by (shard, term, id). It
is an ordering by ranges: a term in every record is dealt over many files, and a search reads the shards of its terms
only, where the files' own minima and maxima skip the rest. The empty term stands once for each record and field with
the field's length; the statistics of a corpus are sums over those rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.functions import strings
from lexgrid.operators.search import B, K1, Statistics, field_text
from lexgrid.runtime import map_batches

SHARDS = 64
ROW = "id string, field string, term string, tf int, length int, positions array<int>"


def _rows(batch: pa.RecordBatch, fields: list[str]) -> Iterable[pa.RecordBatch]:
    """The rows of a batch of ids and one list of tokens for each field."""
    ids = batch.column(0)
    for i, field in enumerate(fields, 1):
        lists = batch.column(i)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = lists.flatten().dictionary_encode()
        code, doc = encoded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.lexsort((place, code, doc))
        code, doc, place = code[order], doc[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])) if len(code) else np.zeros(0, np.int64)
        tf = np.diff(np.concatenate([first, [len(code)]]))
        n = len(lengths)
        at = np.concatenate([doc[first], np.arange(n)])
        terms = pa.concat_arrays([encoded.dictionary.take(pa.array(code[first])).cast(pa.string()), pa.array([""] * n, pa.string())])
        offsets = np.concatenate([first, np.full(n + 1, len(code))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at)), pa.array([field] * len(at)), terms, pa.array(np.concatenate([tf, lengths]).astype(np.int32)), pa.array(lengths[at].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))],
            ["id", "field", "term", "tf", "length", "positions"],
        )


def postings(records: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of ROW for the fields of records with an id."""
    tokens = [strings.tokens(field_text(records, f)).alias(f) for f in fields]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                yield from _rows(b.slice(at, 512), fields)

    return map_batches(records.select(F.col("id").cast("string").alias("id"), *tokens), run, ROW)


def shard(term: Column | str, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def shard_of(term: str, shards: int = SHARDS) -> int:
    """shard() of one term, computed here: the engine's hash is the public one with seed 42, as a signed number."""
    h = xxhash.xxh64_intdigest(term.encode("utf-8"), 42)
    return (h - (1 << 64) if h >> 63 else h) % shards


def write(records: DataFrame, fields: list[str], path: str, shards: int = SHARDS) -> None:
    """Postings under path/terms, statistics of the fields under path/fields."""
    rows = postings(records, fields).withColumn("shard", shard("term", shards))
    rows.repartitionByRange("shard", "term", "id").sortWithinPartitions("shard", "term", "id").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/terms")
    lengths = _read(records.sparkSession, path, [""], shards).groupBy("field").agg(F.count("*").alias("n"), F.sum(F.col("tf").cast("long")).alias("total"))
    lengths.write.mode("overwrite").parquet(f"{path}/fields")


def _read(spark: SparkSession, path: str, terms: list[str], shards: int) -> DataFrame:
    numbers = sorted({shard_of(t, shards) for t in terms})
    rows = spark.read.schema(ROW + ", shard int").parquet(f"{path}/terms")
    return rows.filter(F.col("shard").isin(numbers) & F.col("term").isin(terms)).drop("shard")


class Index:
    """The postings of one or more generations; statistics are those of all their records."""

    def __init__(self, spark: SparkSession, paths: list[str], shards: int = SHARDS) -> None:
        self.spark, self.paths, self.shards = spark, paths, shards
        rows = spark.read.parquet(*[f"{p}/fields" for p in paths]).groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        self.documents = max((r["n"] for r in rows), default=0)
        self.average = {r["field"]: (r["total"] or 0) / r["n"] for r in rows}

    def rows(self, terms: list[str], fields: list[str] | None = None) -> DataFrame:
        """The postings of some terms, with their generation's path where there are several."""
        out = None
        for i, p in enumerate(self.paths):
            part = _read(self.spark, p, terms, self.shards).withColumn("source", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out.filter(F.col("field").isin(fields)) if fields else out

    def all_rows(self) -> DataFrame:
        """The postings of all terms."""
        return self.spark.read.schema(ROW + ", shard int").parquet(*[f"{p}/terms" for p in self.paths]).drop("shard")

    def statistics(self, terms: list[str], fields: list[str]) -> Statistics:
        found = {(r["field"], r["term"]): r["n"] for r in self.rows(terms, fields).groupBy("field", "term").agg(F.count("*").alias("n")).collect()}
        return Statistics(self.documents, {f: self.average.get(f, 0.0) for f in fields}, {(f, t): found.get((f, t), 0) for f in fields for t in terms})

    def matches(self, terms: list[str], fields: list[str]) -> DataFrame:
        """id, source, and for each field s_<field> (BM25 of the OR of the terms) and n_<field> (how many of them stand there). Only postings of the terms are read."""
        s = self.statistics(terms, fields)
        one = one_score(s)
        sums = [x for f in fields for x in (F.sum(F.when(F.col("field") == f, one).otherwise(0.0)).alias(f"s_{f}"), F.count_if(F.col("field") == f).alias(f"n_{f}"))]
        return self.rows(terms, fields).groupBy("source", "id").agg(*sums, F.count_distinct("term").alias("terms"))

    def phrases(self, terms: list[str], fields: list[str]) -> DataFrame:
        """source, id, field and n: how often the terms stand one after another, counted by their starts. Terms may repeat."""
        names = sorted(set(terms))
        held = self.rows(names, fields).groupBy("source", "id", "field").agg(F.count("*").alias("k"), *(F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(names)))
        starts = [_moved(F.col(f"p{names.index(t)}"), i) for i, t in enumerate(terms)]
        common = starts[0]
        for x in starts[1:]:
            common = F.array_intersect(common, x)
        return held.filter(F.col("k") == len(names)).select("source", "id", "field", F.size(common).alias("n")).filter("n > 0")


def _moved(places: Column, by: int) -> Column:
    step = F.lit(by)
    return F.transform(places, lambda x: x - step)


def one_score(s: Statistics) -> Column:
    """BM25 of one posting (field, term, tf, length) by the statistics of its field and term."""
    idf = {k: math.log(1 + (s.documents - df + 0.5) / (df + 0.5)) for k, df in s.frequency.items()}
    weight, average = F.lit(0.0), F.lit(1.0)
    for (f, t), x in idf.items():
        weight = F.when((F.col("field") == f) & (F.col("term") == t), F.lit(x)).otherwise(weight)
    for f, a in s.average.items():
        average = F.when(F.col("field") == f, F.lit(a or 1.0)).otherwise(average)
    tf = F.col("tf").cast("double")
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / average))
