"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and the rows that the stage before it kept.

Quality and language filters drop documents, near-dedup keeps one document of each group (five-word shingles,
similarity 0.8), substring dedup removes repeated runs of 35 words, and packing places what is left in sequences of
2048 ids. All stages but the last return the columns of documents. Models are fitted on the stage's own input.

Edge cases, stage by stage: a null or empty text is scored like any other; it is not identified, so the language stage
drops it. Rows without an id stay where their text does. Of rows that repeat, one of each group stays. Empty tables give
empty tables. Without labels every score is 0.5, below the threshold, and without languages nothing is identified: either way
no document is kept. Columns beside those of documents are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexgrid.llm import langid, minhash, packing, quality, substrings
from lexgrid.runtime import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below the classifier's threshold. The labels are read from sf_dir."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose two best languages are too close."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    return minhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; a text that loses words keeps the others joined by one blank."""
    return substrings.drop_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its sequence and its place there."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]
#: Two stages are models that are fitted here, and ids come from a tokenizer; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
