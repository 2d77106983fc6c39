"""Biomedical citations: gzip XML parts with articles, book articles and deletions in file order, as a data source.

Order within and between parts decides which event of an id is the last, so each part is one partition that is parsed
as a stream and numbered.
"""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lexgrid import schemas
from lexgrid.functions.dates import MONTHS
from lexgrid.sources.records import as_records


def flat(node) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def date_of(node) -> tuple[datetime | None, str]:
    """Timestamp and precision of a date element; days run over into the next month."""
    if node is None:
        return None, ""
    free = flat(node.find("MedlineDate"))
    year = flat(node.find("Year")) or free[:4]
    if not (year.isdigit() and 1000 <= int(year) <= 9999):
        return None, ""
    word = flat(node.find("Month")) or (free.split()[1].split("-")[0] if len(free.split()) > 1 else "")
    low = word.lower()
    month = int(low) if low.isdigit() and 1 <= int(low) <= 12 else next((i for i, m in enumerate(MONTHS, 1) if len(low) >= 3 and m.startswith(low)), 0)
    day = flat(node.find("Day"))
    if not month:
        return datetime(int(year), 1, 1), "year"
    if not (day.isdigit() and 1 <= int(day) <= 31):
        return datetime(int(year), month, 1), "month"
    return datetime(int(year), month, 1) + timedelta(days=int(day) - 1), "day"


def article(node) -> dict:
    """One article or book article as a citation row."""
    first = lambda *paths: next((n for p in paths if (n := node.find(p)) is not None), None)
    pmid = flat(first(".//MedlineCitation/PMID", ".//BookDocument/PMID", ".//PMID"))
    abstracts = [{"label": a.get("Label") or "", "text": flat(a)} for a in node.iterfind(".//Abstract/AbstractText")]
    best = (0, None, "")
    for rank, path in ((1, ".//JournalIssue/PubDate"), (1, ".//Book/PubDate"), (2, ".//ArticleDate"), (3, ".//PubMedPubDate[@PubStatus='pubmed']")):
        at, precision = date_of(node.find(path))
        if at and rank >= best[0]:
            best = (rank, at, precision)
    mesh = []
    for heading in node.iterfind(".//MeshHeading"):
        descriptor = flat(heading.find("DescriptorName"))
        mesh += [descriptor] + [f"{descriptor}/{flat(q)}" for q in heading.iterfind("QualifierName")]
    authors = [" ".join(x for x in (flat(a.find("ForeName")), flat(a.find("LastName"))) if x) or flat(a.find("CollectiveName")) for a in node.iterfind(".//AuthorList/Author")]
    ids = [f"{i.get('IdType', '').upper()} {flat(i)}" for i in node.iterfind("./PubmedData/ArticleIdList/ArticleId") if flat(i) and i.get("IdType") != "pubmed"]
    return {
        "pmid": pmid, "title": flat(first(".//ArticleTitle", ".//BookTitle")), "journal": flat(first(".//Journal/Title", ".//Book/BookTitle")), "identifiers": [f"PMID {pmid}", *ids],
        "keywords": [flat(p) for p in node.iterfind(".//PublicationType")] + mesh, "languages": [flat(x) for x in node.iterfind(".//Language")], "authors": [a for a in authors if a], "abstracts": abstracts,
        "created_at": date_of(node.find(".//PubMedPubDate[@PubStatus='entrez']"))[0], "published_at": best[1], "modified_at": date_of(node.find(".//DateRevised"))[0], "published_precision": best[2], "deleted": False,
    }


def scan(stream):
    """Rows of one part in file order."""
    for _, node in ET.iterparse(stream, events=("end",)):
        if node.tag in ("PubmedArticle", "PubmedBookArticle"):
            yield article(node)
            node.clear()
        elif node.tag == "DeleteCitation":
            for pmid in node.iterfind("PMID"):
                yield {"pmid": flat(pmid), "deleted": True}
            node.clear()


class Part(InputPartition):
    def __init__(self, number: int, path: str) -> None:
        super().__init__(number)
        self.number, self.path = number, path


class CitationReader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str]) -> None:
        self.names, self.paths = schema.fieldNames(), paths

    def partitions(self):
        return [Part(i, p) for i, p in enumerate(self.paths)]

    def read(self, partition: Part):
        opened = gzip.open(partition.path) if partition.path.endswith(".gz") else open(partition.path, "rb")
        with opened as stream:
            for seq, row in enumerate(scan(stream), 1):
                row |= {"part": partition.number, "seq": seq}
                yield tuple(row.get(n) for n in self.names)


class CitationSource(DataSource):
    """Option paths: the parts in order (baseline, then updates), separated by newlines; readable from every executor."""

    @classmethod
    def name(cls):
        return "citations"

    def schema(self):
        return schemas.CITATION

    def reader(self, schema):
        return CitationReader(schema, self.options["paths"].split("\n"))


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(CitationSource)
    return spark.read.format("citations").option("paths", "\n".join(paths)).load()


def markdown() -> F.Column:
    """Body of a citation: journal, authors, abstract parts, terms."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), c))
    part = lambda a: F.concat(F.when(F.coalesce(a["label"], F.lit("")) != "", F.concat(F.lit("### "), a["label"], F.lit("\n\n"))).otherwise(F.lit("")), a["text"])
    abstract = F.array_join(F.transform("abstracts", part), "\n\n")
    return F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), line("Journal", F.col("journal")), line("Authors", F.array_join("authors", ", ")), F.when(abstract != "", F.concat(F.lit("## Abstract\n\n"), abstract)), line("Terms", F.array_join("keywords", "; ")))


def records(rows: DataFrame, dataset: str = "pubmed") -> DataFrame:
    return as_records(
        rows, "pubmed", dataset, id="pmid", title="title", body=markdown(), url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("pmid"), F.lit("/")), identifiers="identifiers", keywords="keywords",
        created_at="created_at", published_at="published_at", modified_at="modified_at", published_precision="published_precision", deleted="deleted", part="part", seq="seq",
    )
