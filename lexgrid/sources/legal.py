"""Legal acts: catalog pages by key, one expression for each act, XHTML documents as records."""

from __future__ import annotations

import urllib.parse
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udf
from pyspark.sql.types import StringType

from lexgrid.functions import markup
from lexgrid.runtime import ship
from lexgrid.sources.records import as_records

PAGE = 5000


def catalog_pages(fetch: Callable[[str, int], list[dict]], size: int = PAGE) -> Iterator[list[dict]]:
    """All pages of a catalog that is asked for what follows a key; a page that does not get on is an error."""
    last = ""
    while rows := fetch(last, size):
        key = max(r["celex"] for r in rows)
        if key <= last:
            raise ValueError(f"the catalog does not advance beyond {last}")
        yield rows
        last = key
        if len(rows) < size:
            return


def query_text(language: str, after: str, size: int) -> str:
    """The question for one page: acts in force with an expression in a language, by key."""
    return f"""PREFIX cdm: <http://publications.europa.eu/ontology/cdm#>
SELECT DISTINCT ?celex ?expression ?format ?title ?date WHERE {{
  ?work cdm:resource_legal_id_celex ?celex ; cdm:resource_legal_in-force true .
  OPTIONAL {{ ?work cdm:work_date_document ?date }}
  ?expression cdm:expression_belongs_to_work ?work ; cdm:expression_uses_language ?language ; cdm:expression_title ?title .
  ?manifestation cdm:manifestation_manifests_expression ?expression ; cdm:manifestation_type ?format .
  FILTER(?language = <http://publications.europa.eu/resource/authority/language/{language.upper()}>)
  FILTER(STR(?celex) > "{after}")
}} ORDER BY ?celex LIMIT {size}"""


def query_url(base: str, language: str, after: str, size: int) -> str:
    return f"{base}?{urllib.parse.urlencode({'query': query_text(language, after, size), 'format': 'application/sparql-results+json'})}"


def bindings(answer: dict) -> list[dict]:
    """Rows of an answer; fields without a value are empty."""
    return [{k: row.get(k, {}).get("value", "") for k in ("celex", "expression", "format", "title", "date")} for row in answer["results"]["bindings"]]


def one_expression(rows: DataFrame) -> DataFrame:
    """One row for each act: XHTML before other formats, then the smallest expression."""
    order = Window.partitionBy("celex").orderBy(F.when(F.lower("format") == "xhtml", 0).otherwise(1), "expression")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def records(acts: DataFrame, documents: DataFrame, dataset: str = "eurlex") -> DataFrame:
    """acts: celex, title, date; documents: celex, content."""
    ship(acts.sparkSession)

    @udf(StringType())
    def body(content):
        return markup.html_to_markdown(content, markup.legal_link(dataset))

    at = F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))
    return as_records(
        acts.join(documents, "celex"), "legal", dataset, id="celex", title="title", body=body("content"), url=F.concat(F.lit("https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:"), F.col("celex")),
        identifiers=F.array("celex"), published_at=at, published_precision=F.when(at.isNotNull(), "day").otherwise(""),
    )
