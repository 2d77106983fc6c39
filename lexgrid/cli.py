"""Command line: python -m lexgrid.cli ROOT VERB ...; one JSON value on standard output."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from lexgrid.engine import Engine
from lexgrid.sources.registry import Registry


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexgrid")
    top.add_argument("root")
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list")
    verbs.add_parser("status")
    verbs.add_parser("jobs")
    verbs.add_parser("cleanup")
    job = verbs.add_parser("job")
    job.add_argument("id")
    job.add_argument("action", choices=["show", "pause", "resume", "cancel", "retry"], nargs="?", default="show")
    remove = verbs.add_parser("remove")
    remove.add_argument("dataset")
    find = verbs.add_parser("search")
    find.add_argument("query")
    find.add_argument("--dataset")
    find.add_argument("--mode", default="auto", choices=["auto", "title", "full"])
    find.add_argument("--sort", default="relevance", choices=["relevance", "newest", "oldest"])
    find.add_argument("--after")
    find.add_argument("--before")
    find.add_argument("--offset", type=int, default=0)
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--include-secondary", action="store_true")
    offered = verbs.add_parser("available")
    offered.add_argument("text", nargs="?", default="")
    offered.add_argument("--offset", type=int, default=0)
    offered.add_argument("--limit", type=int, default=20)
    offered.add_argument("--refresh", action="store_true")
    offered.add_argument("--language", default="")
    offered.add_argument("--source", default="")
    offered.add_argument("--hide-installed", action="store_true")
    for verb in ("download", "update"):
        get = verbs.add_parser(verb)
        get.add_argument("dataset")
        get.add_argument("--variant", default="")
        get.add_argument("--wait", type=float, default=24 * 3600.0, help="seconds to wait for the job")
    read = verbs.add_parser("read")
    read.add_argument("target", help="a reference, or dataset:id")
    read.add_argument("--section", default="")
    read.add_argument("--offset", type=int, default=0)
    read.add_argument("--max-chars", type=int, default=50_000)
    return top


def run(engine: Engine, a: argparse.Namespace) -> object:
    if a.verb == "list":
        return [r.asDict() for r in engine.list_local().collect()]
    if a.verb == "status":
        return engine.status() | {"jobs": len(engine.jobs.jobs)}
    if a.verb == "available":
        rows, total = engine.list_available(a.text, a.offset, a.limit, a.refresh, a.language, a.source, a.hide_installed)
        return {"total": total, "datasets": rows, "errors": engine.errors}
    if a.verb in ("download", "update"):
        job = engine.download(a.dataset, a.variant) if a.verb == "download" else engine.update(a.dataset)
        engine.dispatcher.wait(a.wait)
        return asdict(engine.jobs.jobs[job.id])
    if a.verb == "jobs":
        return [asdict(j) for j in engine.jobs.listed()]
    if a.verb == "cleanup":
        return engine.cleanup()
    if a.verb == "job":
        return asdict(engine.jobs.jobs[a.id] if a.action == "show" else engine.jobs.act(a.id, a.action))
    if a.verb == "remove":
        engine.remove(a.dataset)
        return {"removed": a.dataset}
    if a.verb == "search":
        hits, total = engine.search(a.query, a.dataset, a.mode, sort=a.sort, after=a.after, before=a.before, offset=a.offset, limit=a.limit, include_secondary=a.include_secondary)
        return {"total": total, "hits": [r.asDict() for r in hits.collect()]}
    options = {"offset": a.offset, "max_chars": a.max_chars} | ({"section": a.section} if a.section else {})
    if ":" in a.target:
        dataset, _, id_ = a.target.partition(":")
        return asdict(engine.read(dataset, id_=id_, **options))
    return asdict(engine.read_reference(a.target, **options))


def main(arguments: list[str] | None = None, registry: Registry | None = None) -> int:
    """registry: the providers that `available`, `download` and `update` ask."""
    a = parser().parse_args(arguments)
    try:
        out = run(Engine(SparkSession.builder.getOrCreate(), a.root, registry), a)
    except (KeyError, ValueError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    print(json.dumps(out, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
