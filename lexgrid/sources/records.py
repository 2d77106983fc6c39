"""From any source's rows to the record schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrid import schemas


def as_records(rows: DataFrame, provider: str, dataset: str | Column, **columns: Column | str) -> DataFrame:
    """Select the record schema; fields not given are null, primary is true and deleted false by default."""
    given = {"provider": F.lit(provider), "dataset": F.lit(dataset) if isinstance(dataset, str) else dataset, "primary": F.lit(True), "deleted": F.lit(False), "namespace": F.lit(0), "rank_weight": F.lit(1.0)}
    given |= {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    fields = T.StructType.fromDDL(schemas.RECORD).fields
    return rows.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
