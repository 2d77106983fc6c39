"""The concrete providers: what each offers, its latest release, how its files come and how they become records.

Everything that a provider asks the network for goes through `fetch` (address to bytes) and acquire.Part addresses, so a
folder of files works as well as a server. A staged release is a folder with the files and `release.json`.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.operators.jobs import read_json, write_json
from lexgrid.sources import acquire, archive, citations, legal, listings, sites, standards, wiki
from lexgrid.sources.registry import Provider

Fetch = Callable[[str], bytes]


def fetch_url(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=60) as response:
        return response.read()


@dataclass
class Release:
    """A version of a dataset: parts in the order in which they are scanned, and what tells it from other versions."""

    dataset: str
    variant: str
    date: str
    parts: list[acquire.Part]
    metadata: dict = field(default_factory=dict)

    @property
    def fingerprint(self) -> str:
        lines = [f"{p.name}\t{p.digest or p.size}" for p in sorted(self.parts, key=lambda p: p.name)]
        return hashlib.sha256("\n".join([self.dataset, self.variant, *lines]).encode()).hexdigest()


class FileProvider(Provider):
    """A provider whose releases are files: discover, latest, acquire, open_corpus and backfill on top of catalog() and resolve()."""

    id = ""

    def __init__(self, base: str, fetch: Fetch = fetch_url) -> None:
        self.base, self.fetch = base.rstrip("/"), fetch

    def catalog(self) -> list[dict]:
        raise NotImplementedError

    def resolve(self, dataset: str, variant: str) -> Release:
        raise NotImplementedError

    def scan(self, spark: SparkSession, release: Release, folder: str) -> DataFrame:
        raise NotImplementedError

    def redirects(self, spark: SparkSession, release: Release, folder: str) -> DataFrame | None:
        """src, dst and fragment between normalized titles, where the source has redirects."""
        return None

    def discover(self) -> list[dict]:
        return self.catalog()

    def owns(self, dataset: str) -> bool:
        return any(r["id"] == dataset for r in self.catalog())

    def row(self, dataset: str) -> dict:
        for r in self.catalog():
            if r["id"] == dataset:
                return r
        raise ValueError(f"{self.id} does not offer {dataset}")

    def latest(self, dataset: str, variant: str = "") -> Release:
        """The latest release of a variant; the first one listed where none is named."""
        variants = [v["id"] for v in self.row(dataset)["variants"]]
        if variant and variant not in variants:
            raise ValueError(f"{dataset} has no variant {variant}")
        return self.resolve(dataset, variant or variants[0])

    def acquire(self, release: Release, stage: str, previous: str | None = None) -> tuple[list[str], list[str]]:
        """(reused, fetched) names; the release is described in the stage once all parts are there."""
        found = acquire.acquire(release.parts, stage, previous)
        write_json(f"{stage}/release.json", asdict(release) | {"provider": self.id, "fingerprint": release.fingerprint})
        return found

    def open_corpus(self, spark: SparkSession, folder: str) -> DataFrame:
        """Records of a staged release."""
        held = read_json(f"{folder}/release.json", None)
        if held is None:
            raise ValueError(f"{folder} holds no release")
        release = Release(held["dataset"], held["variant"], held["date"], [acquire.Part(**p) for p in held["parts"]], held["metadata"])
        return self.scan(spark, release, folder)

    def records(self, dataset: str, variant: str = ""):
        raise ValueError("records come from a staged release; see open_corpus()")

    def backfill(self, folder: str) -> dict:
        """Metadata that a release staged earlier lacks, from the catalog of today; what is there stays."""
        held = read_json(f"{folder}/release.json", {})
        row = self.row(held["dataset"])
        fresh = {"name": row.get("name", ""), "description": row["description"], "languages": row.get("languages", [])}
        held["metadata"] = fresh | {k: v for k, v in held["metadata"].items() if v}
        write_json(f"{folder}/release.json", held)
        return held["metadata"]

    def paths(self, release: Release, folder: str) -> list[str]:
        return [os.path.join(folder, p.name) for p in release.parts]


ENGLISH = [{"code": "en", "name": "English"}]


class Standards(FileProvider):
    """The catalog XML and one text for each entry."""

    id = "rfc"

    def catalog(self) -> list[dict]:
        return [{"id": "rfc", "name": "RFC Series", "description": "Standards and notes of the Internet as text", "languages": ENGLISH, "variants": [{"id": "current", "name": "Current"}]}]

    def resolve(self, dataset: str, variant: str) -> Release:
        index = self.fetch(f"{self.base}/rfc-index.xml")
        numbers, newest = [], ""
        for entry in ET.fromstring(index).iterfind(".//{*}rfc-entry"):
            if any((f.text or "").strip().upper() in ("TXT", "TEXT", "ASCII") for f in entry.iterfind("{*}format/{*}file-format")):
                numbers.append(int(re.sub(r"\D", "", entry.findtext("{*}doc-id") or "0")))
            year = entry.findtext("{*}date/{*}year") or ""
            newest = max(newest, year)
        parts = [acquire.Part("rfc-index.xml", f"{self.base}/rfc-index.xml", len(index), hashlib.sha256(index).hexdigest())]
        return Release(dataset, variant, newest, parts + [acquire.Part(f"rfc{n}.txt", f"{self.base}/rfc{n}.txt") for n in sorted(numbers)], {"entries": len(numbers)})

    def scan(self, spark, release, folder):
        return standards.records(standards.catalog(spark, f"{folder}/rfc-index.xml"), standards.texts(spark, f"{folder}/rfc*.txt"), release.dataset)


class Citations(FileProvider):
    """Baseline and update parts of a directory page, each with a checksum beside it; updates follow the baseline."""

    id = "pubmed"
    FOLDERS = ("baseline", "updatefiles")

    def catalog(self) -> list[dict]:
        return [{"id": "pubmed", "name": "PubMed", "description": "Citations and abstracts of biomedical literature", "languages": ENGLISH, "variants": [{"id": "full", "name": "Baseline and updates"}, {"id": "baseline", "name": "Baseline"}]}]

    def resolve(self, dataset: str, variant: str) -> Release:
        parts, newest = [], ""
        for folder in self.FOLDERS[: 1 if variant == "baseline" else 2]:
            page = self.fetch(f"{self.base}/{folder}/").decode("utf-8", "replace")
            for name, day in sorted(set(re.findall(r'href="([^"/?]+\.xml\.gz)">[^<]*</a>\s+(\S+)', page))):
                sums = self.fetch(f"{self.base}/{folder}/{name}.md5").decode()
                digest = re.search(r"\b([0-9a-fA-F]{32})\b", sums)
                parts.append(acquire.Part(name, f"{self.base}/{folder}/{name}", 0, digest[1].lower() if digest else "", "md5"))
                newest = max(newest, day)
        if not parts:
            raise ValueError(f"{self.base} lists no parts")
        return Release(dataset, variant, newest, parts)

    def scan(self, spark, release, folder):
        return citations.records(citations.read(spark, self.paths(release, folder)), release.dataset)


class Wikis(FileProvider):
    """Dumps of many wikis: a list of databases, and for each a status file with the latest dump's files and checksums."""

    id = "wiki"

    def __init__(self, base: str, fetch: Fetch = fetch_url, matrix: str = "") -> None:
        super().__init__(base, fetch)
        self.matrix = matrix

    def catalog(self) -> list[dict]:
        names = re.findall(r"^\S+", self.fetch(f"{self.base}/databases.txt").decode(), re.MULTILINE)
        known = sites.matrix_of(self.fetch(self.matrix)) if self.matrix else {}
        out = []
        for name in names:
            if re.match(listings.WIKI_NAME, name):
                site = sites.merged(known.get(name, {}), sites.inferred(name))
                out.append({"id": name, "name": site["name"], "description": sites.description(site), "closed": site.get("closed", False), "languages": [{"code": site["language"], "name": site["language_name"]}], "variants": [{"id": "articles", "name": "Articles"}]})
        return out

    def resolve(self, dataset: str, variant: str) -> Release:
        status = json.loads(self.fetch(f"{self.base}/{dataset}/latest/dumpstatus.json"))
        job = status["jobs"].get("articlesmultistreamdump") or status["jobs"]["articlesdump"]
        if job.get("status") != "done":
            raise ValueError(f"the latest dump of {dataset} is not done")
        number = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
        files = {n: f for n, f in job["files"].items() if "index" not in n}
        parts = [acquire.Part(n, f"{self.base}/{f['url'].lstrip('/')}", f.get("size", 0), f.get("sha1", "") or f.get("md5", ""), "sha1" if f.get("sha1") else "md5") for n, f in sorted(files.items(), key=lambda x: number(x[0]))]
        return Release(dataset, variant, job.get("updated", ""), parts, sites.merged({}, sites.inferred(dataset)) | {"base": status.get("base", f"https://{dataset}.test")})

    def scan(self, spark, release, folder):
        frames = [wiki.records(spark, p, release.dataset, release.metadata["base"]) for p in self.paths(release, folder)]
        return reduce(DataFrame.unionByName, frames)

    def redirects(self, spark, release, folder):
        return reduce(DataFrame.unionByName, [wiki.redirect_edges(spark, p) for p in self.paths(release, folder)])


class Acts(FileProvider):
    """Legal acts: pages of a catalog asked for by key, then one XHTML document for each act."""

    id = "legal"
    PAGE = legal.PAGE

    def catalog(self) -> list[dict]:
        return [{"id": "eurlex", "name": "EUR-Lex", "description": "Acts of European law in force", "languages": [{"code": c, "name": n} for c, n in listings.LANGUAGES.values()], "variants": [{"id": c, "name": n} for c, n in listings.LANGUAGES.values()]}]

    def acts(self, language: str) -> list[dict]:
        ask = lambda after, size: json.loads(self.fetch(legal.query_url(self.base, language, after, size)))
        rows = [r for page in legal.catalog_pages(lambda after, size: legal.bindings(ask(after, size)), self.PAGE) for r in page]
        best: dict[str, dict] = {}
        for r in sorted(rows, key=lambda r: (r["format"].lower() != "xhtml", r["expression"])):
            best.setdefault(r["celex"], r)
        return [best[k] for k in sorted(best)]

    def resolve(self, dataset: str, variant: str) -> Release:
        acts = self.acts(variant)
        parts = [acquire.Part(f"{re.sub(r'[^0-9A-Za-z]', '_', a['celex'])}.xhtml", a["expression"]) for a in acts]
        return Release(dataset, variant, max((a["date"] for a in acts), default=""), parts, {"acts": acts})

    def scan(self, spark, release, folder):
        rows = [(a["celex"], a["title"], a["date"], p) for a, p in zip(release.metadata["acts"], self.paths(release, folder), strict=True)]
        acts = spark.createDataFrame(rows, "celex string, title string, date string, path string")
        texts = spark.read.text([p for *_, p in rows], wholetext=True)
        name = F.substring_index(F.input_file_name(), "/", -1)
        documents = texts.select(name.alias("file"), F.col("value").alias("content")).join(acts.select("celex", F.substring_index("path", "/", -1).alias("file")), "file")
        return legal.records(acts.drop("path"), documents.select("celex", "content"), release.dataset)


class Archives(FileProvider):
    """Web archives of a feed catalog; a dataset's variants are its flavours. A metalink names the file, its size and digest."""

    id = "archive"
    PAGE = 500

    def entries(self) -> list[dict]:
        out, start = [], 0
        while True:
            page = feed_entries(self.fetch(f"{self.base}/entries?start={start}&count={self.PAGE}"))
            out += page
            start += len(page)
            if len(page) < self.PAGE:
                return out

    def catalog(self) -> list[dict]:
        groups: dict[str, list[dict]] = {}
        for e in self.entries():
            groups.setdefault(e["name"], []).append(e)
        rows = []
        for name, found in sorted(groups.items()):
            found.sort(key=lambda e: (variant_id(e), e["updated"]))
            codes = ",".join(sorted({c for e in found for c in e["language"].split(",")}))
            kinds = {variant_id(e): {"id": variant_id(e), "name": variant_name(e), "description": variant_description(e), "updated": e["updated"], "url": e["url"]} for e in found}
            rows.append({"id": name, "name": found[0]["title"], "description": found[0]["summary"] or found[0]["title"], "languages": listings.languages(codes), "variants": list(kinds.values())})
        return rows

    def resolve(self, dataset: str, variant: str) -> Release:
        chosen = next(v for v in self.row(dataset)["variants"] if v["id"] == variant)
        part = metalink_part(self.fetch(chosen["url"]))
        return Release(dataset, variant, chosen["updated"], [part])

    def scan(self, spark, release, folder):
        return archive.records(archive.entries(spark, self.paths(release, folder)[0]), release.dataset)


def feed_entries(xml: bytes) -> list[dict]:
    """Entries of one page of a feed: name, title, summary, language, flavour, updated and the address of the metalink."""
    out = []
    for e in ET.fromstring(xml).iterfind("{*}entry"):
        text = lambda tag, e=e: (e.findtext(f"{{*}}{tag}") or "").strip()
        link = next((x.get("href") for x in e.iterfind("{*}link") if x.get("type") == "application/x-zim"), "")
        if link and text("name"):
            out.append({"name": text("name").lower(), "title": text("title"), "summary": text("summary"), "language": text("language"), "flavour": text("flavour"), "updated": text("updated"), "url": link})
    return out


def variant_id(entry: dict) -> str:
    return entry["flavour"] or "default"


def variant_name(entry: dict) -> str:
    """What a flavour is called: its words with capitals."""
    return variant_id(entry).replace("_", " ").title()


def variant_description(entry: dict) -> str:
    return f"{entry['title']} ({variant_name(entry).lower()}, {entry['updated'][:10]})"


def metalink_part(xml: bytes) -> acquire.Part:
    """The file of a metalink: size, SHA-256 and the secure address with the lowest priority number."""
    file = ET.fromstring(xml).find("{*}file")
    if file is None:
        raise ValueError("the metalink names no file")
    secure = sorted((int(u.get("priority") or 999_999), (u.text or "").strip()) for u in file.iterfind("{*}url") if (u.text or "").strip().startswith("https://"))
    if not secure:
        raise ValueError("the metalink has no secure address")
    digest = next((h.text or "" for h in file.iterfind("{*}hash") if (h.get("type") or "").lower() == "sha-256"), "")
    return acquire.Part(file.get("name") or secure[0][1].rsplit("/", 1)[-1], secure[0][1], int(file.findtext("{*}size") or 0), digest.strip().lower())
