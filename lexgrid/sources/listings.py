"""Listings and metadata of sources: directory pages, checksum lists, catalogs, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.functions import strings
from lexgrid.runtime import numbered

#: Three-letter to two-letter language codes, with names.
LANGUAGES = {"eng": ("en", "English"), "fra": ("fr", "French"), "deu": ("de", "German"), "spa": ("es", "Spanish"), "ita": ("it", "Italian"), "por": ("pt", "Portuguese"), "nld": ("nl", "Dutch"), "dan": ("da", "Danish"), "swe": ("sv", "Swedish"), "pol": ("pl", "Polish")}
WIKI_NAME = r"^[a-z0-9_]+(wiki|wiktionary|wikibooks|wikinews|wikiquote|wikisource|wikiversity|wikivoyage)$"


def files(page: DataFrame, column: str = "value") -> DataFrame:
    """name, day and size of the files of directory pages; sizes may have a K, M, G or T."""
    found = F.regexp_extract_all(column, F.lit(r'(<a href="[^"/?]+">[^<]*</a>\s+[0-9]{2,4}-[0-9A-Za-z]{2,3}-[0-9]{2,4}\s+[0-9:]{5}\s+[0-9.]+[KMGT]?)'), F.lit(1))
    row = page.select(F.explode(found).alias("v"))
    part = lambda p: F.regexp_extract("v", p, 1)
    return row.select(part(r'href="([^"]+)"').alias("name"), part(r"</a>\s+(\S+)").alias("day"), strings.parse_size(part(r"(\S+)$")).alias("size"))


def checksums(lines: DataFrame, column: str = "value") -> DataFrame:
    """name and digest of lines `digest  name` or `MD5(name)= digest`."""
    tail = F.regexp_extract(column, r"^([0-9a-fA-F]{32,64})\s+\*?(\S+)$", 2)
    named = F.regexp_extract(column, r"^\w+\(([^)]+)\)=\s*([0-9a-fA-F]+)$", 1)
    digest = F.when(tail != "", F.regexp_extract(column, r"^([0-9a-fA-F]{32,64})\s", 1)).otherwise(F.regexp_extract(column, r"=\s*([0-9a-fA-F]+)$", 1))
    return lines.select(F.when(tail != "", tail).otherwise(named).alias("name"), F.lower(digest).alias("digest")).filter("name <> ''")


def ordered_parts(baseline: DataFrame, updates: DataFrame) -> DataFrame:
    """Both lists with a part number: the baseline first, each by name."""
    both = baseline.withColumn("stage", F.lit(0)).unionByName(updates.withColumn("stage", F.lit(1)))
    return numbered(both, [F.col("stage").asc(), F.col("name").asc()], "_n").withColumn("part", F.col("_n") - 1).drop("stage", "_n")


def mirror(links: DataFrame) -> DataFrame:
    """name and url: of each file's https mirrors the one with the lowest priority number."""
    return links.filter(F.col("url").startswith("https://")).groupBy("name").agg(F.min_by("url", F.struct("priority", "url")).alias("url"))


def languages(codes: str) -> list[dict]:
    """Distinct languages of a comma list, two-letter where known, by name."""
    two = {c: n for c, n in LANGUAGES.values()}
    found = {}
    for raw in codes.split(","):
        code = LANGUAGES.get(raw.strip().lower(), (raw.strip().lower(),))[0]
        if code:
            found[code] = {"code": code, "name": two.get(code, code)}
    return sorted(found.values(), key=lambda x: (x["name"].lower(), x["code"]))


def language_summary(found: list[dict]) -> dict:
    return found[0] if len(found) == 1 else {"code": "mul", "name": f"Multilingual ({len(found)} languages)"}


def valid_wiki_name(name: F.Column) -> F.Column:
    return name.rlike(WIKI_NAME)
