"""Ordered change logs as streams: each micro-batch is compacted, then merged into the state table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.operators.changelog import compact_rows
from lexgrid.runtime import shared_dir


class StateTable:
    """The last event of every key, as versions of a Parquet table; a version is complete before it is current.

    A finished version holds a file that names its batch; the version of the latest batch is the current one, also after
    a restart with the same folder. A batch that is replayed after a failure meets state that already holds it, and the last event
    still wins. Versions before the one before the current are deleted."""

    MARK = "_CURRENT"

    def __init__(self, spark: SparkSession, root: str, key: str, order: list[str]) -> None:
        self.spark, self.root, self.key, self.order = spark, root.rstrip("/"), key, order
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, int, str]]:
        """(batch, time, folder) of the finished versions, oldest first."""
        if not self.files.exists(self.path):
            return []
        out = []
        for s in self.files.listStatus(self.path):
            mark = self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), self.MARK)
            if self.files.exists(mark):
                batch = int(s.getPath().getName().removeprefix("version=").partition("-")[0])
                out.append((batch, self.files.getFileStatus(mark).getModificationTime(), f"{self.root}/{s.getPath().getName()}"))
        return sorted(out)

    @property
    def current(self) -> str | None:
        found = self.versions()
        return found[-1][2] if found else None

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        current = self.current
        rows = batch if current is None else batch.unionByName(self.spark.read.schema(batch.schema).parquet(current))
        target = f"{self.root}/version={batch_id}-{uuid.uuid4().hex}"
        compact_rows(rows, self.key, self.order, F.lit(False)).write.parquet(target)
        self.files.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{self.MARK}")).close()
        for _, _, old in self.versions()[:-2]:
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(old), True)

    def rows(self, deleted: str) -> DataFrame:
        return self.spark.read.parquet(self.current).filter(~F.coalesce(F.expr(deleted), F.lit(False)))


def ingest(stream: DataFrame, state: StateTable, checkpoint: str) -> None:
    """Run a stream to the end of what is there."""
    stream.writeStream.foreachBatch(state.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def compacted_stream(spark: SparkSession, path: str, key: str, order: list[str], deleted: str) -> DataFrame:
    """The compaction of the Parquet files at a path, read as a stream of files; tombstones stay in the state and out of the result."""
    schema = spark.read.parquet(path).schema
    root = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    state = StateTable(spark, f"{root}/state", key, order)
    # as a pattern, the path may be one file or a folder
    pattern = f"{path[:-1]}[{path[-1]}]"
    ingest(spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(pattern), state, f"{root}/checkpoint")
    if state.current is None:
        return spark.createDataFrame([], schema)
    return state.rows(deleted)


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each kind in each window; what is later than the watermark is left out. For batches and streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
