"""Change logs: the last event of a key wins, tombstones remove it; generations and their visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact(events: DataFrame, key: str, order: list[str], deleted: Column) -> DataFrame:
    """The last event of each key in the order given, unless it is a tombstone.

    One aggregation: the last event is a maximum over a struct, so partial results combine before the shuffle and a key
    with very many events is no large group."""
    rest = [c for c in events.columns if c != key and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("last")
    out = events.groupBy(key).agg(last).select(key, *(F.col(f"last.{c}").alias(c) for c in [*order, *rest]))
    return out.filter(~F.coalesce(deleted, F.lit(False)))


def compact_rows(events: DataFrame, key: str, order: list[str], deleted: Column) -> DataFrame:
    """The same where columns cannot be compared (maps): the place of the last event is found first."""
    rest = F.struct(*[c for c in events.columns if c != key])
    out = events.groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("last")).select(key, "last.*")
    return out.select(*events.columns).filter(~F.coalesce(deleted, F.lit(False)))


def valid(records: DataFrame) -> DataFrame:
    """Records with an id and a title that is not blank."""
    return records.filter("id <> '' and trim(title) <> ''")


def indexed_bytes(*columns: str) -> Column:
    return sum((F.coalesce(F.octet_length(F.coalesce(c, F.lit(""))), F.lit(0)).cast("long") for c in columns), F.lit(0).cast("long"))


def storage_shares(datasets: DataFrame, disk_bytes: int) -> DataFrame:
    """dataset, bytes, share: the disk's bytes divided in proportion; the division comes first, so nothing overflows."""
    total = datasets.agg(F.sum(F.col("bytes").cast("double"))).scalar()
    return datasets.withColumn("share", F.floor(F.col("bytes").cast("double") / total * F.lit(float(disk_bytes))).cast("long"))


def fingerprint(parts: DataFrame, group: str, name: str, digest: str) -> DataFrame:
    """group, fingerprint: SHA-256 over its (name, digest) lines in the order of names."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(name, digest))), lambda x: F.concat_ws("\t", x[name], x[digest]))
    return parts.groupBy(group).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


def reuse(previous: DataFrame, current: DataFrame, key: list[str], digest: str) -> tuple[DataFrame, DataFrame]:
    """Parts of the current release that the previous one has unchanged, and those to fetch."""
    same = [*key, digest]
    known = previous.select(*same).distinct()
    return current.join(known, same, "left_semi"), current.join(known, same, "left_anti")


def of_generations(rows: DataFrame, active: DataFrame, column: str = "generation") -> DataFrame:
    """Rows of the generations listed."""
    return rows.join(active.select(column).distinct(), column, "left_semi")


def without_generations(rows: DataFrame, gone: DataFrame, column: str = "generation") -> DataFrame:
    """Rows of all generations but those listed."""
    return rows.join(gone.select(column).distinct(), column, "left_anti")


def retired(held: Column, new: Column) -> Column:
    """The set of retired generations with one more; it stands there once."""
    return F.array_union(held, F.array(new))


def unretired(held: Column, back: Column) -> Column:
    return F.array_remove(held, back)
