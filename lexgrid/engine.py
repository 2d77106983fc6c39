"""The engine: installs datasets as generations of Parquet, searches the active ones, reads documents.

A generation is written whole under a folder of its own: records, postings of their fields, redirects where a source has
some. A manifest names the active generation of each dataset, and replacing the manifest publishes it. A search reads the
postings of its terms in the active generations and narrow columns of their records.

With a registry of providers the engine also offers what there is, and downloads and updates it by jobs: the latest
release is compared by fingerprint, staged, published by a rename and indexed.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import time
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.functions import passages, standards, strings
from lexgrid.operators import catalog, changelog, postings, redirects, search, tiered
from lexgrid.operators.dispatch import Dispatcher, Notices
from lexgrid.operators.jobs import Job, Jobs, Settings, read_json, write_json
from lexgrid.operators.postings import Index
from lexgrid.operators.references import References
from lexgrid.runtime import materialise
from lexgrid.sources.registry import Registry

#: The layout of a generation's files.
LAYOUT = 2


def generation_of(provider: str, dataset: str, fingerprint: str) -> str:
    return hashlib.sha256("\x1f".join((provider, dataset, fingerprint)).encode()).hexdigest()[:32]


@dataclass
class Document:
    id: str
    title: str
    dataset: str
    content: str
    offset: int
    total: int
    truncated: bool
    next_offset: int | None
    section_found: bool = True
    outline: list[dict] = field(default_factory=list)
    outline_truncated: bool = False
    hops: list[str] = field(default_factory=list)
    ref: str = ""
    hop_refs: list[str] = field(default_factory=list)
    section: str = ""


FIELDS = ["title", "aliases", "keywords", "body"]
#: Rows of a page of the catalog.
CATALOG_PAGE, CATALOG_MOST = 20, 50


class Engine:
    """root: a folder on a file system that the driver and the executors share. registry: the providers to download from."""

    def __init__(self, spark: SparkSession, root: str, registry: Registry | None = None, clock=time.time) -> None:
        self.spark, self.root, self.registry, self.clock = spark, root, registry, clock
        self.jobs = Jobs(f"{root}/jobs.json")
        self.references = References(f"{root}/references.json")
        self.settings = Settings(**read_json(f"{root}/settings.json", {}))
        self.dispatcher = Dispatcher(lambda: self.settings.download_workers)
        self.notices = Notices(self.snapshot)
        self.errors: dict[str, str] = {}
        self.checked_at = 0.0

    # generations

    @property
    def manifest(self) -> dict:
        return read_json(f"{self.root}/manifest.json", {"version": 1, "datasets": {}, "retired": []})

    def _save(self, manifest: dict) -> None:
        write_json(f"{self.root}/manifest.json", manifest)

    def _folder(self, generation: str) -> str:
        return f"{self.root}/generations/generation={generation}"

    def _index(self, generation: str) -> str:
        return f"{self.root}/indexes/generation={generation}"

    def finished(self, generation: str) -> bool:
        """The checkpoint is written last and names the version of the layout; another version is built anew."""
        return read_json(f"{self._index(generation)}/checkpoint.json", {}).get("version") == LAYOUT and os.path.exists(f"{self._folder(generation)}/_SUCCESS")

    def build(self, records: DataFrame, provider: str, dataset: str, fingerprint: str, edges: DataFrame | None = None) -> str:
        """Write a generation, invisible until it is activated; a finished one of the same fingerprint is reused.

        edges: src, dst and fragment of redirects between normalized titles. What an earlier call finished is kept: records,
        then postings, then redirects, each complete when its marker stands."""
        generation = generation_of(provider, dataset, fingerprint)
        folder, index = self._folder(generation), self._index(generation)
        if self.finished(generation):
            return generation
        if not os.path.exists(f"{folder}/_SUCCESS"):
            rows = changelog.compact_rows(records, "id", ["part", "seq"], F.col("deleted"))
            rows = changelog.valid(rows).withColumns({"title_exact": strings.normalize_title(F.col("title")), "doc_key": strings.doc_key(F.lit(generation), F.col("id"))})
            rows.write.mode("overwrite").parquet(folder)
        if not os.path.exists(f"{index}/fields/_SUCCESS"):
            postings.write(self.spark.read.parquet(folder), FIELDS, index)
        if edges is not None:
            edges.select("src", "dst", F.col("fragment") if "fragment" in edges.columns else F.lit("").alias("fragment")).write.mode("overwrite").parquet(f"{index}/redirects")
        write_json(f"{index}/checkpoint.json", {"version": LAYOUT, "provider": provider, "dataset": dataset, "fingerprint": fingerprint})
        return generation

    def activate(self, provider: str, dataset: str, fingerprint: str) -> str:
        generation = generation_of(provider, dataset, fingerprint)
        if not self.finished(generation):
            raise ValueError(f"{dataset} has no finished generation for {fingerprint}")
        manifest = self.manifest
        before = manifest["datasets"].get(dataset, {}).get("generation")
        retired = [g for g in manifest["retired"] if g != generation] + ([before] if before and before != generation else [])
        manifest["datasets"][dataset] = {"provider": provider, "generation": generation, "fingerprint": fingerprint}
        self._save(manifest | {"retired": retired})
        return generation

    def remove(self, dataset: str) -> None:
        if any(j.dataset == dataset and j.state not in ("completed", "failed", "canceled") for j in self.jobs.jobs.values()):
            raise ValueError(f"{dataset} has a job that has not ended")
        manifest = self.manifest
        gone = manifest["datasets"].pop(dataset)
        manifest["retired"].append(gone["generation"])
        self._save(manifest)

    def cleanup(self) -> list[str]:
        """Delete retired generations and builds that were given up."""
        manifest = self.manifest
        active = {d["generation"] for d in manifest["datasets"].values()}
        tops = [f"{self.root}/generations", f"{self.root}/indexes"]
        there = {x.removeprefix("generation=") for top in tops for x in (os.listdir(top) if os.path.isdir(top) else [])}
        gone = sorted(g for g in there if g not in active and (g in manifest["retired"] or not self.finished(g)))
        for g in gone:
            for top in tops:
                shutil.rmtree(f"{top}/generation={g}", ignore_errors=True)
        self._save(manifest | {"retired": [g for g in manifest["retired"] if g not in gone]})
        return gone

    def install(self, records: DataFrame, provider: str, dataset: str, fingerprint: str, edges: DataFrame | None = None):
        """Build and activate as a job."""
        job = self.jobs.submit(dataset, "index")
        self.jobs.progress(job.id, 0, 1, "indexing")
        try:
            self.build(records, provider, dataset, fingerprint, edges)
            self.activate(provider, dataset, fingerprint)
        except Exception as e:
            self.jobs.finish(job.id, str(e)[:500] or "failed")
            raise
        return self.jobs.finish(job.id)

    # what there is

    def list_local(self) -> DataFrame:
        """Installed datasets with what can be done with them, the state of their job and their bytes."""
        rows = [(d, m["provider"], m["generation"], m["fingerprint"]) for d, m in sorted(self.manifest["datasets"].items())]
        installed = self.spark.createDataFrame(rows, "dataset string, provider string, generation string, fingerprint string")
        jobs = self.spark.createDataFrame([(j.dataset, j.state, j.updated_at) for j in self.jobs.jobs.values()], "dataset string, state string, updated_at double")
        sizes = self.spark.createDataFrame([(d, _bytes(self._folder(g)) + _bytes(self._index(g))) for d, _, g, _ in rows], "dataset string, bytes long")
        return catalog.with_state(installed, jobs, sizes).withColumn("capabilities", catalog.capabilities(F.lit(True), F.lit(True))).orderBy("dataset")

    def list_available(self, text: str = "", offset: int = 0, limit: int = CATALOG_PAGE, refresh: bool = False, language: str = "", source: str = "", hide_installed: bool = False) -> tuple[list[dict], int]:
        """(a page of the catalog, how many rows fit). Callers see neither fingerprints nor whether a source is closed."""
        if offset < 0 or not 1 <= limit <= CATALOG_MOST:
            raise ValueError("offset or limit out of bounds")
        found, self.errors = self._registry.discover(text, refresh)
        rows = [(r["provider"], r["id"], r.get("name", r["id"]), r["description"], r.get("languages", []), r["variants"]) for r in found]
        kinds = "array<struct<code: string, name: string>>, variants array<struct<id: string, name: string>>"
        frame = self.spark.createDataFrame(rows, f"provider string, id string, name string, description string, languages {kinds}")
        hidden = self.spark.createDataFrame([(d,) for d in self.manifest["datasets"]], "id string") if hide_installed else None
        kept = catalog.browse(frame, language, source, hidden)
        page = catalog.page(kept, ["provider", "id"], offset, limit).collect()
        return [r.asDict(recursive=True) | {"installed": r["id"] in self.manifest["datasets"]} for r in page], kept.count()

    @property
    def _registry(self) -> Registry:
        if self.registry is None:
            raise ValueError("no providers are configured")
        return self.registry

    def status(self) -> dict:
        """Settings, what the providers last said, and when updates are looked for next."""
        return {"settings": vars(self.settings), "providers": {p: self.errors.get(p, "") for p in (self.registry.providers if self.registry else [])}, "next_check": self.checked_at + 3600 * self.settings.update_hours, "active": sorted(self.manifest["datasets"])}

    def snapshot(self) -> dict:
        return {"jobs": [asdict(j) for j in self.jobs.listed()], "datasets": sorted(self.manifest["datasets"])}

    # downloads and updates

    def download(self, dataset: str, variant: str = "") -> Job:
        """A job that brings the latest release of a dataset and indexes it. With a release that is installed already it ends at once."""
        owner = self._registry.owner(dataset)
        job = self.jobs.submit(dataset, "download")
        self.dispatcher.enqueue(job.id, lambda: self.run_download(job.id, owner, variant))
        self.notices.changed()
        return job

    def run_download(self, job_id: str, owner, variant: str = "") -> None:
        """Compare fingerprints, stage the parts that changed, publish the stage by a rename, build and activate."""
        job = self.jobs.jobs[job_id]
        try:
            self.jobs.progress(job_id, 0, 0, "downloading")
            held = self.manifest["datasets"].get(job.dataset, {})
            release = owner.latest(job.dataset, variant or held.get("variant", ""))
            if held.get("fingerprint") != release.fingerprint:
                top = f"{self.root}/sources/{job.dataset}"
                stage, target = f"{top}/.stage-{release.fingerprint[:16]}", f"{top}/{release.fingerprint[:16]}"
                previous = f"{top}/{held['fingerprint'][:16]}" if held else None
                if not os.path.exists(f"{target}/release.json"):
                    owner.acquire(release, stage, previous)
                    if job.state in ("paused", "canceled"):
                        return
                    os.replace(stage, target)
                self.jobs.progress(job_id, len(release.parts), len(release.parts), "indexing")
                records = owner.open_corpus(self.spark, target)
                self.build(records, owner.id, job.dataset, release.fingerprint, owner.redirects(self.spark, release, target))
                if job.state in ("paused", "canceled"):
                    return
                self.activate(owner.id, job.dataset, release.fingerprint)
                manifest = self.manifest
                manifest["datasets"][job.dataset] |= {"variant": release.variant, "date": release.date}
                self._save(manifest)
            self.jobs.finish(job_id)
        except Exception as e:
            self.jobs.finish(job_id, str(e)[:500] or "failed")
            raise
        finally:
            self.notices.changed()

    def resume(self) -> list[str]:
        """Queue again what was running when the engine stopped."""
        again = [j for j in self.jobs.listed() if j.state == "queued" and j.kind == "download"]
        for j in again:
            self.dispatcher.enqueue(j.id, lambda j=j: self.run_download(j.id, self._registry.owner(j.dataset)))
        return [j.id for j in again]

    def update(self, dataset: str) -> Job:
        if dataset not in self.manifest["datasets"]:
            raise ValueError(f"{dataset} is not installed")
        return self.download(dataset)

    def check_updates(self, force: bool = False) -> list[str]:
        """Datasets whose latest release differs from what is installed, looked for every so many hours; with auto_update they are queued."""
        if not force and self.clock() - self.checked_at < 3600 * self.settings.update_hours:
            return []
        self.checked_at = self.clock()
        out = []
        for dataset, held in sorted(self.manifest["datasets"].items()):
            try:
                newest = self._registry.owner(dataset).latest(dataset, held.get("variant", "")).fingerprint
            except Exception as e:  # noqa: BLE001  one provider's failure is reported beside the others' answers
                self.errors[held["provider"]] = str(e)
                continue
            if newest != held["fingerprint"]:
                out.append(dataset)
                if self.settings.auto_update:
                    self.update(dataset)
        return out

    def job_status(self, job_id: str = "", dataset: str = "") -> Job:
        """By id, or the latest job of a dataset."""
        if job_id:
            return self.jobs.jobs[job_id]
        mine = [j for j in self.jobs.jobs.values() if j.dataset == dataset]
        if not mine:
            raise KeyError(f"{dataset} has no job")
        return max(mine, key=lambda j: j.updated_at)

    def records(self, datasets: list[str] | None = None) -> DataFrame:
        names = self._active(datasets)
        frames = [self.spark.read.parquet(self._folder(g)).withColumn("source", F.lit(i)) for i, g in enumerate(names.values())]
        return reduce(DataFrame.unionByName, frames)

    def _active(self, datasets: list[str] | None = None) -> dict[str, str]:
        """Generations by dataset, in the order of their names."""
        active = self.manifest["datasets"]
        names = sorted(active) if datasets is None else datasets
        if missing := [d for d in names if d not in active]:
            raise ValueError(f"not active: {', '.join(missing)}")
        if not names:
            raise ValueError("no dataset is active")
        return {d: active[d]["generation"] for d in names}

    def index(self, datasets: list[str] | None = None) -> Index:
        return Index(self.spark, [self._index(g) for g in self._active(datasets).values()])

    def edges(self, dataset: str) -> DataFrame | None:
        path = f"{self._index(self._active([dataset])[dataset])}/redirects"
        return self.spark.read.parquet(path) if os.path.exists(path) else None

    def document_counts(self) -> DataFrame:
        return self.records().groupBy("dataset").agg(F.count("*").alias("documents"))

    # search and read

    def search(self, query: str, dataset: str | None = None, mode: str = "auto", snippets: bool = True, **options) -> tuple[DataFrame, int]:
        """(hits of the page with references and snippets, number of all matches)."""
        if mode not in ("auto", "title", "full"):
            raise ValueError(f"unknown mode: {mode}")
        q = search.Query(query, full_text=mode != "title", **options)
        names = [dataset] if dataset else None
        records = self.records(names)
        terms = search.query_terms(query, records)
        found, total = search.page_and_total(search.ranked(records.withColumn("body", F.lit("")), q, terms, self.index(names)), q, "doc_key")
        return self._decorated(found, records, terms, snippets), total

    def search_tiered(self, query: str, dataset: str, include_secondary: bool = False, offset: int = 0, limit: int = 10, snippets: bool = True) -> tuple[DataFrame, int]:
        """The tiered ranker over one dataset: phrases and strict recall fused, titles reached through redirects first."""
        q = search.Query(query, include_secondary=include_secondary, offset=offset, limit=limit)
        records, edges = self.records([dataset]), self.edges(dataset)
        if edges is None:
            edges = self.spark.createDataFrame([], "src string, dst string")
        titles = records.select(tiered.keyed().alias("key"), "title_exact", "title", "primary")
        allowed = None if include_secondary else records.filter("primary").select("source", "id")
        hits = materialise(tiered.search(self.index([dataset]), titles, query, search.query_terms(query, records), edges, allowed), "tiered")
        page = hits.orderBy("rank").offset(q.offset).limit(q.limit)
        rows = records.withColumn("key", tiered.keyed()).join(page.withColumnRenamed("id", "key"), "key").drop("body").withColumn("is_exact", F.col("mode").startswith("exact")).orderBy("rank").collect()
        return self._decorated(rows, records, search.query_terms(query, records), snippets), hits.count()

    def _decorated(self, rows: list, records: DataFrame, terms: list[str], snippets: bool) -> DataFrame:
        """The rows of a page with a reference each; texts are read for these rows only."""
        refs = self.references.mint_many([(r["provider"], r["dataset"], r["id"], r["title"], "") for r in rows])
        known = [(i, r["doc_key"], r["dataset"], r["id"], r["title"], r["url"], r["status"], r["published_at"], r["published_precision"], r["is_exact"], r["score"], refs[i]) for i, r in enumerate(rows)]
        page = self.spark.createDataFrame(known, "place int, doc_key string, dataset string, id string, title string, url string, status string, published_at timestamp, published_precision string, is_exact boolean, score double, ref string")
        if not snippets:
            return page.orderBy("place").drop("place", "doc_key")
        bodies = records.filter(F.col("doc_key").isin([r["doc_key"] for r in rows])).select("doc_key", strings.snippet(F.col("body"), terms, 220).alias("snippet"))
        return page.join(bodies, "doc_key", "left").orderBy("place").drop("place", "doc_key")

    def read(self, dataset: str, id_: str | None = None, title: str | None = None, section: str = "", offset: int = 0, max_chars: int = 50_000, outline: bool = False, edges: DataFrame | None = None) -> Document:
        """One document by id or exact title. Redirects of the dataset are followed from a title, eight hops at most, and a
        fragment of the last one is the section where none is asked for. edges (src, dst of ids) are followed from an id."""
        if (id_ is None) == (title is None):
            raise ValueError("either an id or a title")
        if not 1 <= max_chars <= 500_000 or offset < 0:
            raise ValueError("offset or max_chars out of bounds")
        records = self.records([dataset])
        hops = []
        known = self.edges(dataset) if title is not None else None
        if known is not None:
            name = self.spark.range(1).select(strings.normalize_title(F.lit(title)).alias("id"))
            end = redirects.follow(name, known.select("src", "dst")).first()
            if end["looped"] or end["exceeded"]:
                raise ValueError(f"the redirects of {title} do not end")
            if end["hops"]:
                hops = [title]
                last = known.filter((F.col("dst") == end["target"]) & (F.col("fragment") != "")).orderBy("src").first()
                section = section or (last["fragment"] if last else "")
                title = end["target"]
        if id_ is not None and edges is not None:
            end = redirects.follow(self.spark.createDataFrame([(id_,)], "id string"), edges).first()
            if end["looped"] or end["exceeded"]:
                raise ValueError(f"the redirects of {id_} do not end")
            hops = [id_] if end["target"] != id_ else []
            id_ = end["target"]
        if id_ is not None:
            found = search.by_ids(records, [id_]).limit(1).collect()
        else:
            exact = records.filter(F.col("title_exact") == strings.normalize_title(F.lit(title)))
            found = exact.orderBy(F.desc(F.col("title") == title), F.desc("primary"), "id").limit(1).collect()
        if not found:
            q = search.Query(title or id_, full_text=False, limit=5)
            near = [r["title"] for r in search.page(search.ranked(records, q, None, self.index([dataset])), q).select("title").collect()]
            raise KeyError(f"{title or id_} is not in {dataset}; near: {near}")
        row = found[0]
        text, ok = row["body"] or "", True
        heads, more = passages.outline(text) if outline and not offset else ([], False)
        if section:
            text, ok = standards.section(text, section) if row["provider"] == "rfc" else passages.markdown_section(text, section)
            if not ok:
                heads, more = passages.outline(row["body"] or "")
        end = (passages.line_end if row["provider"] == "rfc" else passages.readable_end)(text, offset, max_chars)
        ref = self.references.mint(row["provider"], dataset, row["id"], row["title"], section)
        content = self.references.rewrite(text[offset:end], row["provider"])
        hop_refs = self.references.mint_many([(row["provider"], dataset, "", h, "") for h in hops])
        return Document(row["id"], row["title"], dataset, content, offset, len(text), end < len(text), end if end < len(text) else None, ok, heads, more, hops, ref, hop_refs, section)

    def read_reference(self, ref: str, **options) -> Document:
        """By id, or else by the title that the reference carries, or else the best hit for that title."""
        route = self.references.resolve(ref)
        options.setdefault("section", route["section"])
        try:
            if route["id"]:
                return self.read(route["dataset"], id_=route["id"], **options)
        except KeyError:
            if not route["title"]:
                raise
        try:
            return self.read(route["dataset"], title=route["title"], **options)
        except KeyError:
            best = self.search(route["title"], route["dataset"], limit=1, snippets=False)[0].first()
            if best is None:
                raise
            return self.read(route["dataset"], id_=best["id"], **options)

    def update_settings(self, **changes) -> Settings:
        self.settings = Settings(**(vars(self.settings) | changes))
        write_json(f"{self.root}/settings.json", vars(self.settings))
        self.dispatcher.pump()
        return self.settings


def _bytes(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(folder) for n in names)
