import datetime

import pytest
from pyspark.sql import functions as F

from lexgrid.engine import Engine
from lexgrid.operators import catalog, changelog, fusion, redirects, search
from lexgrid.operators.jobs import Jobs, Settings
from lexgrid.operators.references import LIFETIME, References
from lexgrid.sources.records import as_records
from lexgrid.sources.registry import Provider, Registry


def records(spark, rows, dataset):
    """rows: (id, title, body) with optional identifiers, primary, published_at, deleted."""
    full = [(r[0], r[1], r[2], *(list(r[3:]) + [[], True, None, False][len(r) - 3 :]), i) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(full, "id string, title string, body string, identifiers array<string>, primary boolean, published_at timestamp, deleted boolean, seq long")
    return as_records(frame, "test", dataset, id="id", title="title", body="body", identifiers="identifiers", primary="primary", published_at="published_at", deleted="deleted", seq="seq", part=F.lit(0))


def ids(found):
    return [r["id"] for r in found[0].collect()]


def test_search_and_generations(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no dataset"):
        engine.search("anything")
    rows = [("http", "HTTP Semantics", "methods status codes fields", ["RFC 9110"]), ("mail", "Mail Status", "email delivery status codes"), ("talk", "Talk: HTTP", "status", [], False), ("empty", " ", "x"), ("gone", "Gone", "status"), ("gone", "Gone", "", [], True, None, True)]
    engine.install(records(spark, rows, "net"), "test", "net", "v1")
    assert engine.document_counts().first()["documents"] == 3
    assert ids(engine.search("HTTP semantics"))[0] == "http" and "talk" not in ids(engine.search("HTTP semantics"))
    assert ids(engine.search("RFC 9110")) == ["http"]
    assert "talk" in ids(engine.search("http", include_secondary=True))
    engine.build(records(spark, [("two", "Second", "wombat protocol")], "net"), "test", "net", "v2")
    assert engine.search("wombat")[1] == 0
    engine.activate("test", "net", "v2")
    assert ids(engine.search("wombat")) == ["two"] and engine.search("semantics")[1] == 0
    assert len(engine.cleanup()) == 1
    again = Engine(spark, str(tmp_path))
    again.install(records(spark, [("b", "Beta", "wombat token")], "beta"), "test", "beta", "v1")
    assert again.search("wombat")[1] == 2
    again.remove("net")
    assert again.search("wombat")[1] == 1
    with pytest.raises(ValueError, match="not active"):
        again.search("wombat", dataset="net")


def test_date_filter_and_sort(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    rows = [("old", "A", "evidence", [], True, datetime.datetime(2020, 1, 2)), ("new", "B", "evidence", [], True, datetime.datetime(2025, 3, 4)), ("none", "C", "evidence")]
    engine.install(records(spark, rows, "d"), "test", "d", "1")
    assert ids(engine.search("evidence", after="2024-01-01")) == ["new"]
    assert ids(engine.search("evidence", sort="newest")) == ["new", "old", "none"]
    assert ids(engine.search("evidence", sort="oldest")) == ["old", "new", "none"]


def test_reading(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    body = "Lead [go](corpus-read://read?dataset=d&id=b).\n\n## One\n\nText.\n\n## Two\n\nMore."
    engine.install(records(spark, [("a", "Alpha_page", body), ("b", "Beta", "b"), ("old", "Old", "")], "d"), "test", "d", "1")
    found = engine.read("d", title="alpha page", outline=True)
    assert found.id == "a" and [h["heading"] for h in found.outline] == ["One", "Two"]
    link = found.content.split("corpus-read://document/")[1][:8]
    assert engine.read_reference(link).title == "Beta" and engine.read_reference(found.ref).id == "a"
    assert engine.read("d", id_="a", section="one").content == "## One\n\nText."
    edges = spark.createDataFrame([("old", "b")], "src string, dst string")
    assert engine.read("d", id_="old", edges=edges).hops == ["old"]
    with pytest.raises(KeyError, match="near"):
        engine.read("d", title="beta gamma")
    with pytest.raises(ValueError):
        engine.read("d")


def test_query_validation():
    for bad in ({"text": " "}, {"text": "x", "sort": "best"}, {"text": "x", "limit": 51}, {"text": "x", "offset": -1}):
        with pytest.raises(ValueError):
            search.Query(**bad)
    assert search.candidate_window(0, 10) == 100 and search.candidate_window(300, 50) == 500


def test_compaction_is_idempotent(spark):
    events = spark.createDataFrame([(1, 1, "a", False), (1, 3, "c", False), (2, 1, "x", False), (2, 2, "", True), (1, 2, "b", False)], "k long, s long, v string, gone boolean")
    once = changelog.compact(events, "k", ["s"], F.col("gone"))
    assert [(r["k"], r["v"]) for r in once.collect()] == [(1, "c")]
    twice = changelog.compact(events.union(events).union(once.select(*events.columns)), "k", ["s"], F.col("gone"))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_fusion_and_redirects(spark):
    ranks = lambda *x: spark.createDataFrame([(i, r) for r, i in enumerate(x, 1)], "id long, rank int")
    assert [r["id"] for r in fusion.fuse(ranks(1, 2), ranks(2, 3)).orderBy("rank").collect()] == [1, 2, 3]
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 21), (21, 20)], "src long, dst long")
    found = {r["id"]: r for r in redirects.follow(spark.createDataFrame([(1,), (8,), (20,), (99,)], "id long"), edges).collect()}
    assert found[1]["exceeded"] and found[1]["hops"] == 8
    assert (found[8]["target"], found[8]["hops"], found[8]["exceeded"]) == (12, 4, False)
    assert found[20]["looped"] and found[99]["target"] == 99


def test_storage(spark):
    shares = changelog.storage_shares(spark.createDataFrame([("a", 37_000_000_000), ("b", 18_000_000_000)], "dataset string, bytes long"), 54_000_000_000)
    assert abs({r["dataset"]: r["share"] for r in shares.collect()}["a"] - 36_327_272_727) <= 1
    files = spark.createDataFrame([("raw", 11), ("metadata", 7), ("title", 13), ("body", 17), ("x", 5)], "kind string, size long")
    assert tuple(catalog.storage_breakdown(files, "kind", "size", ["raw", "metadata", "title", "body"]).first()) == (53, 11, 7, 13, 17, 5)


def test_jobs(tmp_path):
    now = [0.0]
    jobs = Jobs(str(tmp_path / "jobs.json"), lambda: now[0])
    job = jobs.submit("d")
    assert jobs.submit("d").id == job.id
    for action, state in (("pause", "paused"), ("resume", "queued"), ("cancel", "canceled"), ("retry", "queued")):
        assert jobs.act(job.id, action).state == state
    with pytest.raises(ValueError):
        jobs.act(job.id, "resume")
    jobs.progress(job.id, 2, 9, "downloading")
    assert jobs.progress(job.id, 1, 9).completed == 2
    assert Jobs(str(tmp_path / "jobs.json")).jobs[job.id].state == "queued"
    jobs.act(job.id, "pause")
    assert jobs.progress(job.id, 8, 9).completed == 2 and jobs.finish(job.id).state == "paused"
    for bad in ({"download_workers": 0}, {"update_hours": 721}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_job_order(tmp_path):
    jobs = Jobs(str(tmp_path / "jobs.json"), lambda: 0.0)
    for name, state, created, updated in (("new-done", "completed", 3, 9), ("old-active", "indexing", 1, 5), ("old-done", "failed", 1, 2), ("new-active", "queued", 2, 2)):
        j = jobs.submit(name)
        j.state, j.created_at, j.updated_at = state, created, updated
    assert [j.dataset for j in jobs.listed()] == ["old-active", "new-active", "new-done", "old-done"]


def test_references(tmp_path):
    now = [0.0]
    refs = References(str(tmp_path / "refs.json"), lambda: now[0])
    ref = refs.mint("p", "d", "1")
    assert len(ref) == 8 and ref.startswith("r_") and refs.mint("p", "d", "1") == ref
    now[0] = LIFETIME - 1
    assert refs.resolve(ref)["id"] == "1"
    now[0] = 2 * LIFETIME - 2
    assert References(str(tmp_path / "refs.json"), lambda: now[0]).resolve(ref)["dataset"] == "d"
    now[0] = 9 * LIFETIME
    with pytest.raises(KeyError):
        refs.resolve(ref)
    with pytest.raises(ValueError):
        refs.resolve("nonsense")
    assert refs.rewrite("[a](corpus-read://read?dataset=d&id=2) [b](corpus-read://read?dataset=d&id=", "p").endswith("[b](corpus-read://read?dataset=d&id=")


class Shelf(Provider):
    def __init__(self, id_, rows, owned=()):
        self.id, self.rows, self.owned = id_, rows, owned

    def owns(self, dataset):
        return dataset in self.owned

    def discover(self):
        if isinstance(self.rows, Exception):
            raise self.rows
        return self.rows

    def records(self, dataset, variant):
        raise NotImplementedError


def test_registry(tmp_path):
    row = {"id": "one", "description": "A set", "variants": [{"id": "v"}]}
    registry = Registry([Shelf("a", [row], ("one",)), Shelf("b", [row | {"id": "two"}], ("two",))], str(tmp_path))
    assert [r["id"] for r in registry.discover()[0]] == ["one", "two"] and registry.owner("two").id == "b"
    assert [r["id"] for r in registry.discover("TWO")[0]] == ["two"]
    broken = Registry([Shelf("a", OSError("down"), ("one",))], str(tmp_path), max_age=-1)
    rows, errors = broken.discover()
    assert [r["id"] for r in rows] == ["one"] and errors == {"a": "down"}
    with pytest.raises(ValueError):
        Registry([Shelf("a", []), Shelf("a", [])])
    with pytest.raises(ValueError, match="offered"):
        Registry([Shelf("a", [row]), Shelf("b", [row])]).discover()
    for bad in ({"id": "../x"}, {"description": ""}, {"variants": []}):
        assert Registry([Shelf("a", [row | bad])]).discover()[1]
    with pytest.raises(ValueError):
        Registry([Shelf("a", [], ("x",)), Shelf("b", [], ("x",))]).owner("x")


def test_command_line(spark, tmp_path, capsys):
    import json

    from lexgrid import cli

    Engine(spark, str(tmp_path)).install(records(spark, [("a", "Alpha", "first words")], "d"), "test", "d", "1")
    said = lambda *x: (cli.main([str(tmp_path), *x]), json.loads(capsys.readouterr().out or "null"))
    assert said("search", "words")[1]["hits"][0]["id"] == "a"
    code, document = said("read", "d:a")
    assert code == 0 and document["content"] == "first words"
    assert said("read", document["ref"])[1]["title"] == "Alpha"
    assert said("read", "r_000000")[0] == 1
    assert said("jobs")[1][0]["state"] == "completed" and said("list")[1][0]["dataset"] == "d"
