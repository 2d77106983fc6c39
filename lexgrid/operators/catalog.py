"""Catalog rows: validation, browsing, facets, variants, and their overlay with what is installed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.runtime import numbered

ID_PATTERN = r"^[a-z0-9][a-z0-9._-]{0,127}$"
#: States in which a job has ended.
TERMINAL = ["completed", "failed", "canceled"]


def matching(catalog: DataFrame, text: str, scalars: list[str], arrays: list[str]) -> DataFrame:
    """Rows that hold the text anywhere in their fields, whatever the case."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in scalars] + [F.coalesce(F.array_join(c, " "), F.lit("")) for c in arrays]
    return catalog.filter(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lower(F.lit(text))))


def invalid(catalog: DataFrame) -> DataFrame:
    """Rows without a proper id, description or variants, with the reason."""
    reason = (
        F.when(~F.coalesce(F.col("id").rlike(ID_PATTERN), F.lit(False)), "id")
        .when(F.trim(F.coalesce("description", F.lit(""))) == "", "description")
        .when(F.coalesce(F.size("variants"), F.lit(0)) <= 0, "variants")
    )
    return catalog.withColumn("reason", reason).filter("reason is not null")


def collisions(catalog: DataFrame) -> DataFrame:
    """id and the number of providers that offer it, where several do."""
    return catalog.groupBy("id").agg(F.count_distinct("provider").alias("providers")).filter("providers > 1")


def variants(entries: DataFrame, dataset: str, variant: str) -> DataFrame:
    """One row a dataset: its primary variant (the smallest), how many it has and all of them in order."""
    return entries.groupBy(dataset).agg(F.min(variant).alias("primary_variant"), F.count_distinct(variant).alias("n_variants"), F.array_join(F.sort_array(F.collect_set(variant)), ",").alias("variant_list"))


def language_facet(catalog: DataFrame) -> DataFrame:
    """code, name of all languages; a real name is taken before one that repeats the code."""
    real = F.when(F.lower("name") != F.lower("code"), F.col("name"))
    return catalog.groupBy("code").agg(F.coalesce(F.min(real), F.min("name")).alias("name")).orderBy(F.lower("name"), "code")


def browse(catalog: DataFrame, language: str = "", source: str = "", hide: DataFrame | None = None) -> DataFrame:
    """Catalog rows of a language and a provider, without those whose id is in `hide`; an empty choice is all."""
    if language:
        wanted = language.lower()
        catalog = catalog.filter(F.exists("languages", lambda x: F.lower(x["code"]) == wanted))
    if source:
        catalog = catalog.filter(F.col("provider") == source)
    return catalog if hide is None else catalog.join(hide.select("id").distinct(), "id", "left_anti")


def with_state(installed: DataFrame, jobs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Installed datasets with the state of a job that has not ended (else ready) and their bytes (else 0).

    jobs: dataset, state, updated_at; sizes: dataset, bytes."""
    active = jobs.filter(~F.col("state").isin(TERMINAL)).groupBy("dataset").agg(F.max_by("state", "updated_at").alias("state"))
    out = installed.join(active, "dataset", "left").join(sizes.groupBy("dataset").agg(F.sum("bytes").alias("bytes")), "dataset", "left")
    return out.withColumns({"state": F.coalesce("state", F.lit("ready")), "bytes": F.coalesce("bytes", F.lit(0)).cast("long")})


def overlay(catalog: DataFrame, installed: DataFrame) -> DataFrame:
    """Catalog rows with installed and update_available (both fingerprints known and different)."""
    mine = installed.select("id", F.col("fingerprint").alias("installed_fingerprint"))
    differs = (F.col("fingerprint") != F.col("installed_fingerprint")) & (F.col("fingerprint") != "") & (F.col("installed_fingerprint") != "")
    return catalog.join(mine, "id", "left").withColumns({"installed": F.col("installed_fingerprint").isNotNull(), "update_available": F.coalesce(differs, F.lit(False))})


def upgrades(installed: DataFrame, latest: DataFrame) -> DataFrame:
    both = installed.withColumnRenamed("fingerprint", "have").join(latest.withColumnRenamed("fingerprint", "latest"), "id")
    return both.filter("have <> latest and have <> '' and latest <> ''")


def latest_job(events: DataFrame, dataset: str, order: list[str]) -> DataFrame:
    rest = [c for c in events.columns if c not in (dataset, *order)]
    return events.groupBy(dataset).agg(F.max(F.struct(*order, *rest)).alias("j")).select(dataset, *(f"j.{c}" for c in [*order, *rest]))


def pipeline_order(jobs: DataFrame) -> DataFrame:
    """Jobs with place: active ones by creation, then ended ones by their last change, newest first."""
    ended = F.col("state").isin(TERMINAL)
    return numbered(jobs, [ended.asc(), F.when(~ended, F.col("created_at")).asc(), F.when(ended, F.col("updated_at")).desc(), F.col("id").asc()], "place")


def monotone(progress: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Progress that never falls: events below what was reported before are dropped."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return progress.withColumn("_high", F.max(value).over(before)).filter(F.col("_high").isNull() | (F.col(value) >= F.col("_high"))).drop("_high")


def storage_breakdown(files: DataFrame, by: str, size: str, classes: list[str]) -> DataFrame:
    """total and a sum for each class of files; the rest is other."""
    sums = [F.coalesce(F.sum(F.when(F.col(by) == c, F.col(size))), F.lit(0)).alias(f"{c.lower()}_bytes") for c in classes]
    return files.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), *sums, F.coalesce(F.sum(F.when(~F.col(by).isin(classes), F.col(size))), F.lit(0)).alias("other_bytes"))


def stream_ranges(offsets: DataFrame, file: str, offset: str, size: str) -> DataFrame:
    """file, offset, end: each stream ends where the next begins, the last at the file's size."""
    order = Window.partitionBy(file).orderBy(offset)
    return offsets.select(file, offset, size).distinct().withColumn("end", F.coalesce(F.lead(offset).over(order), F.col(size))).drop(size)


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def public(rows: DataFrame) -> DataFrame:
    """What callers see of catalog rows: neither fingerprints and digests nor whether a source is closed."""
    return rows.drop("fingerprint", "digest", "closed")


def together(catalogs: list[DataFrame]) -> DataFrame:
    """Rows of all catalogs; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), catalogs)


def capabilities(indexed: Column, readable: Column) -> Column:
    return F.array_compact(F.array(F.when(indexed, "search"), F.when(readable, "read")))


def release_totals(parts: DataFrame, release: str, size: str, updated: str) -> DataFrame:
    return parts.groupBy(release).agg(F.count("*").alias("parts"), F.sum(size).alias("bytes"), F.max(updated).alias(updated))


def wanted_ids(rows: DataFrame, stream: str, id_: str) -> DataFrame:
    """stream, wanted and ids: the distinct ids that are wanted of each stream, in order."""
    return rows.groupBy(stream).agg(F.sort_array(F.collect_set(id_)).alias("ids")).withColumn("wanted", F.size("ids").cast("long"))


def provider_status(checks: DataFrame, provider: str, order: list[str], healthy: str) -> DataFrame:
    """The last check of each provider."""
    return checks.groupBy(provider).agg(F.max(F.struct(*order, healthy)).alias("c")).select(provider, f"c.{healthy}", *(f"c.{c}" for c in order))


def folded_jobs(events: DataFrame, key: str, order: list[str], state: str, failed: str, ended: list[str]) -> DataFrame:
    """failures, last state and steps (events that ended nothing) of each job."""
    return events.groupBy(key).agg(F.count_if(F.col(state) == failed).alias("failures"), F.max_by(state, F.struct(*order)).alias("last"), F.count_if(~F.col(state).isin(ended)).alias("steps"))
