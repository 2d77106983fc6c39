"""Session helpers: shared work folders, written intermediates, shipping the package, row-wise Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set; intermediates need a folder that all executors share")
    return "file:///tmp/checkpoints"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete the files of materialise() whose readers have all been written themselves; nothing can ask for them again."""
    for df in written:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """rows with their number from 1 in an order of the whole table. The order is dealt out by ranges and written; numbers are places in
    a range plus the sizes of the ranges before it, so no task sees all rows. Only the sizes come to the driver."""
    sorted_rows = materialise(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    sizes = {r["_range"]: r["count"] for r in sorted_rows.groupBy("_range").count().collect()}
    before, offsets = 0, []
    for k in sorted(sizes):
        offsets += [F.lit(k), F.lit(before)]
        before += sizes[k]
    offset = F.element_at(F.create_map(*offsets), F.col("_range")) if offsets else F.lit(0)
    return sorted_rows.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + offset).drop("_range")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers started elsewhere can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp())
    path = os.path.join(folder, "lexgrid_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        # slices keep the Python copies of very long texts few
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield from zip(*[c.to_pylist() for c in part.columns], strict=True)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, most_rows: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, (str, bytes)))
        if len(held) >= most_rows or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def tidy() -> None:
    """Give what a task has freed back to the system; a worker lives on for the tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow that tidies up after each task."""
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            tidy()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with a function from an iterator of row tuples to row tuples; batches go out by size."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    return map_batches(df, lambda batches: batches_of(fn(rows_of(batches)), arrow), schema)
