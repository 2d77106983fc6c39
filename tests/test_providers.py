"""Providers over files on disk, downloads as jobs, updates, notices, the tiered ranker, stream scans."""

import bz2
import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from lexgrid.engine import Engine
from lexgrid.operators import postings
from lexgrid.operators.dispatch import Dispatcher, Notices
from lexgrid.runtime import numbered
from lexgrid.sources import acquire, legal, providers, sites, wiki
from lexgrid.sources.registry import Registry

INDEX = """<rfc-index xmlns="http://y">{}</rfc-index>"""
ENTRY = """<rfc-entry><doc-id>RFC{0:04d}</doc-id><title>{1}</title><date><month>May</month><year>2001</year></date><format><file-format>TXT</file-format></format><current-status>UNKNOWN</current-status></rfc-entry>"""


@pytest.fixture
def shelf(tmp_path):
    top = tmp_path / "served"
    top.mkdir()

    def publish(entries):
        (top / "rfc-index.xml").write_text(INDEX.format("".join(ENTRY.format(n, t) for n, t, _ in entries)))
        for n, _, body in entries:
            (top / f"rfc{n}.txt").write_text(body)

    return top, publish


def fetch(url):
    import urllib.request

    with urllib.request.urlopen(url) as r:
        return r.read()


def test_download_update_and_catalog(spark, tmp_path, shelf):
    top, publish = shelf
    publish([(7, "Host names", "1. Intro\n\nnames of hosts\n")])
    engine = Engine(spark, str(tmp_path / "root"), Registry([providers.Standards(f"file://{top}", fetch)]))
    rows, total = engine.list_available("internet", language="EN")
    assert total == 1 and rows[0]["id"] == "rfc" and "closed" not in rows[0] and not rows[0]["installed"]
    assert engine.list_available(language="fr")[1] == 0 and engine.list_available(source="other")[1] == 0
    with pytest.raises(ValueError, match="bounds"):
        engine.list_available(limit=51)
    job = engine.download("rfc")
    assert engine.dispatcher.wait(120) and engine.job_status(job.id).state == "completed", engine.jobs.jobs[job.id].error
    assert engine.search("hosts")[1] == 1 and engine.check_updates(force=True) == []
    assert engine.list_available(hide_installed=True)[1] == 0
    local = engine.list_local().first()
    assert local["dataset"] == "rfc" and local["state"] == "ready" and local["bytes"] > 0
    publish([(7, "Host names", "1. Intro\n\nnames of hosts\n"), (8, "Second", "1. Intro\n\nwombats\n")])
    assert engine.check_updates() == [] and engine.check_updates(force=True) == ["rfc"]
    engine.update("rfc")
    assert engine.dispatcher.wait(120) and engine.search("wombats")[1] == 1
    assert engine.status()["active"] == ["rfc"] and len(engine.cleanup()) == 1
    with pytest.raises(ValueError):
        engine.update("other")
    with pytest.raises(ValueError, match="variant"):
        engine.registry.owner("rfc").latest("rfc", "nope")


def test_a_failed_download_is_a_failed_job(spark, tmp_path, shelf):
    top, publish = shelf
    publish([(7, "Host names", "text")])
    (top / "rfc7.txt").unlink()
    engine = Engine(spark, str(tmp_path / "root"), Registry([providers.Standards(f"file://{top}", fetch)]))
    acquire_waits, acquire._retried.__globals__["FIRST_WAIT"] = acquire.FIRST_WAIT, 0.0
    try:
        job = engine.download("rfc")
        assert engine.dispatcher.wait(60)
    finally:
        acquire._retried.__globals__["FIRST_WAIT"] = acquire_waits
    assert engine.jobs.jobs[job.id].state == "failed" and engine.manifest["datasets"] == {}
    assert Engine(spark, str(tmp_path / "root"), engine.registry).resume() == []


def test_dispatcher_and_notices():
    limit, gate, order = [1], threading.Event(), []
    d = Dispatcher(lambda: limit[0], 2)
    assert d.enqueue("a", gate.wait) and not d.enqueue("a", gate.wait)
    assert d.enqueue("b", lambda: order.append("b")) and d.enqueue("c", lambda: 1 / 0)
    with pytest.raises(ValueError):
        d.enqueue("d", lambda: None)
    assert not order
    limit[0] = 2
    d.pump()
    gate.set()
    assert d.wait(10) and order == ["b"] and "division" in d.errors["c"]
    state = {"n": 0}
    notices = Notices(lambda: dict(state), 0.02)
    q = notices.subscribe()
    assert q.get(timeout=1) == {"n": 0}
    for i in range(5):
        state["n"] = i + 1
        notices.changed()
    assert q.get(timeout=2) == {"n": 5} and q.empty()


def test_citation_and_act_releases():
    page = '<a href="x0001.xml.gz">x0001.xml.gz</a>   2024-05-06 10:00  3M\n'
    answers = {"b/baseline/": page, "b/updatefiles/": page.replace("x0001", "x0002").replace("05-06", "06-07")} | {f"b/{f}/x000{i}.xml.gz.md5": f"MD5(x)= {str(i) * 32}" for i, f in ((1, "baseline"), (2, "updatefiles"))}
    release = providers.Citations("b", lambda u: answers[u].encode()).latest("pubmed")
    assert [p.name for p in release.parts] == ["x0001.xml.gz", "x0002.xml.gz"] and release.parts[1].digest == "2" * 32 and release.date == "2024-06-07"
    assert len(providers.Citations("b", lambda u: answers[u].encode()).latest("pubmed", "baseline").parts) == 1

    def ask(url):
        from urllib.parse import parse_qs, urlsplit

        question = parse_qs(urlsplit(url).query)["query"][0]
        rows = [] if '"3B"' in question else [{k: {"value": v} for k, v in (("celex", c), ("expression", f"http://e/{c}/{f}"), ("format", f), ("title", c), ("date", "2020-01-02"))} for c, f in (("3A", "html"), ("3A", "xhtml"), ("3B", "xhtml"))]
        return json.dumps({"results": {"bindings": rows}}).encode()

    acts = providers.Acts("http://q", ask)
    acts.PAGE = 3
    release = acts.latest("eurlex", "de")
    assert [p.url for p in release.parts] == ["http://e/3A/xhtml", "http://e/3B/xhtml"] and "DE" in legal.query_text("de", "", 1)


def test_archive_feed_and_metalink():
    entry = lambda n, f, u: f'<entry><name>{n}</name><title>T {n}</title><summary>S</summary><language>eng</language><flavour>{f}</flavour><updated>{u}</updated><link type="application/x-zim" href="http://m/{n}{f}"/></entry>'
    first = '<feed xmlns="http://a">' + "".join(entry(*x) for x in (("A", "mini", "2024-01-01"), ("A", "", "2024-02-01"))) + "</feed>"
    second = '<feed xmlns="http://a">' + entry("b", "all_maxi", "2023-01-01") + "</feed>"
    meta = '<metalink xmlns="urn:x"><file name="a.zim"><size>42</size><hash type="sha-256">AB</hash><url priority="2">https://two</url><url priority="1">http://plain</url><url priority="3">https://three</url></file></metalink>'
    shelf = providers.Archives("f", lambda u: {"f/entries?start=0&count=2": first, "f/entries?start=2&count=2": second}.get(u, meta).encode())
    shelf.PAGE = 2
    rows = shelf.catalog()
    assert [(r["id"], [v["id"] for v in r["variants"]]) for r in rows] == [("a", ["default", "mini"]), ("b", ["all_maxi"])]
    assert rows[1]["variants"][0]["name"] == "All Maxi" and rows[0]["languages"] == [{"code": "en", "name": "English"}]
    part = shelf.latest("a", "mini").parts[0]
    assert (part.name, part.url, part.size, part.digest) == ("a.zim", "https://two", 42, "ab")
    with pytest.raises(ValueError):
        providers.metalink_part(b"<metalink><file><url>http://plain</url></file></metalink>")


def test_sites():
    matrix = {"sitematrix": {"count": 2, "0": {"code": "xx", "localname": "Xish", "site": [{"dbname": "xxwiki", "sitename": "Wikipedia", "url": "https://xx.w", "closed": ""}]}, "specials": [{"dbname": "metawiki", "sitename": "Meta", "lang": "en", "url": "https://m"}]}}
    known = sites.matrix_of(json.dumps(matrix))
    assert known["xxwiki"]["name"] == "Xish Wikipedia" and known["xxwiki"]["closed"] and known["metawiki"]["name"] == "Meta"
    assert sites.project_of("zh_yuewiktionary") == ("zh-yue", "Wiktionary", "dictionary entries") and sites.project_of("other")[1] == "other"
    assert sites.merged({"name": ""}, known["xxwiki"])["name"] == "Xish Wikipedia" and "encyclopedia" in sites.description(known["xxwiki"])
    head = b'<mediawiki xmlns="z"><siteinfo><sitename>W</sitename><dbname>frwiki</dbname><base>https://fr.w/wiki/Main</base></siteinfo><page>'
    assert sites.dump_head(head) == {"name": "W", "language": "fr", "project": "Wikipedia", "url": "https://fr.w"} and sites.dump_head(b"<x>") == {}
    assert sites.site_info('{"query": {"general": {"sitename": "W", "lang": "fr", "server": "//fr", "wikiid": "frwiki"}}}')["project"] == "Wikipedia"


def test_stream_scans(spark, tmp_path):
    page = lambda i: f"<page><title>T{i}</title><ns>0</ns><id>{i}</id><revision><text>b{i}</text></revision></page>"
    blobs = [bz2.compress("".join(page(i) for i in range(k, k + 3)).encode()) for k in (0, 3, 6)]
    (tmp_path / "m.bz2").write_bytes(b"".join(blobs))
    size, offsets = sum(map(len, blobs)), [0, len(blobs[0]), len(blobs[0]) + len(blobs[1])]
    lines = spark.createDataFrame([(offsets[i // 3], i, f"T{i}") for i in range(9)], "offset long, page_id long, title string")
    wanted = wiki.wanted_streams(lines, spark.createDataFrame([(1,), (7,), (8,)], "page_id long"), size)
    assert sorted((r["offset"], r["ids"]) for r in wanted.collect()) == [(0, [1]), (offsets[2], [7, 8])]
    assert sorted((r["id"], r["text"]) for r in wiki.selected(spark, str(tmp_path / "m.bz2"), wanted).collect()) == [(1, "b1"), (7, "b7"), (8, "b8")]
    ranges = sorted((r["offset"], r["end"]) for r in wiki.streams(lines, size).collect())
    scan = wiki.scan_bodies(spark, str(tmp_path / "m.bz2"), ranges, "", str(tmp_path / "out"), 1)
    assert next(scan) == "1"
    scan.close()
    assert list(wiki.scan_bodies(spark, str(tmp_path / "m.bz2"), ranges, "1", str(tmp_path / "out"), 1)) == ["2", "3"]
    assert spark.read.parquet(f"{tmp_path}/out/*").count() == 9


def test_numbers_of_a_whole_table(spark):
    rows = spark.range(500).select(((F.col("id") * 37) % 101).alias("a"), "id")
    got = [(r["a"], r["id"]) for r in sorted(numbered(rows, [F.col("a").asc(), F.col("id").asc()], "n").collect(), key=lambda r: r["n"])]
    assert got == sorted((i * 37 % 101, i) for i in range(500))
    assert numbered(rows.limit(0), ["a", "id"], "n").count() == 0


def test_postings_of_odd_records(spark, tmp_path):
    rows = [("1", "one two", "a b a b a"), ("2", None, None), ("3", "", "é b"), ("4", "twice", "a")]
    postings.write(spark.createDataFrame(rows, "id string, title string, body string"), ["title", "body"], str(tmp_path / "i"), 4)
    index = postings.Index(spark, [str(tmp_path / "i")], 4)
    assert index.documents == 4 and index.average["body"] == 8 / 4
    assert {(r["id"], r["tf"], tuple(r["positions"])) for r in index.rows(["a"], ["body"]).collect()} == {("1", 3, (0, 2, 4)), ("4", 1, (0,))}
    assert [(r["id"], r["n"]) for r in index.phrases(["a", "b"], ["body"]).collect()] == [("1", 2)]
    assert [(r["id"], r["n"]) for r in index.phrases(["a", "b", "a"], ["body"]).collect()] == [("1", 2)]
    assert index.matches(["absent"], ["title", "body"]).count() == 0
    for t in ("", "a", "é", "long term"):
        assert postings.shard_of(t, 4) == spark.range(1).select(postings.shard(F.lit(t), 4)).first()[0]
    postings.write(spark.createDataFrame([], "id string, title string, body string"), ["title", "body"], str(tmp_path / "e"), 4)
    assert postings.Index(spark, [str(tmp_path / "e")], 4).documents == 0


def test_tiered_search(spark, tmp_path):
    from tests.test_engine import records

    engine = Engine(spark, str(tmp_path))
    rows = [("1", "Mercury", "planet near the sun"), ("2", "Quick silver", "a liquid metal near nothing"), ("3", "Sun", "the sun is hot and the planet is near the sun"), ("4", "Old name", "", [], False), ("5", "Planet near the sun", "list"), ("6", "Talk", "planet near the sun planet near the sun", [], False)]
    edges = spark.createDataFrame([("old name", "quick silver", "Uses"), ("hydrargyrum", "quick silver", ""), ("loopx", "loopy", ""), ("loopy", "loopx", "")], "src string, dst string, fragment string")
    engine.install(records(spark, rows, "w"), "test", "w", "1", edges)
    said = lambda q, **o: [r["id"] for r in engine.search_tiered(q, "w", **o)[0].collect()]
    assert said("planet near the sun")[0] == "5" and "6" not in said("planet near the sun")
    assert "6" in said("planet near the sun", include_secondary=True)
    assert said("Old name")[0] == "2" and "4" not in said("old_name", include_secondary=True)
    assert said("loopx") == []
    assert said("hot metal hydrargyrum") != [] and engine.search_tiered("sun", "w")[0].first()["ref"].startswith("r_")
    found = engine.read("w", title="old name")
    assert found.id == "2" and found.hops == ["old name"] and found.section == "Uses" and not found.section_found
    with pytest.raises(ValueError, match="do not end"):
        engine.read("w", title="LoopX")


def test_ranges_survive_an_interruption(tmp_path):
    """Only the last range is there when a call is stopped: the next one fetches what is missing, and no hole is published."""
    data = bytes(range(256)) * 40
    asked = []

    def serve(broken):
        def get(url, first, last, write):
            asked.append((first, last))
            if broken and first < 6000:
                raise RuntimeError("stopped")
            write(first, data[first : len(data) if last is None else last + 1])
            return len(data) if last is None else last + 1

        return get

    part, kept = acquire.Part("x", "http://none/x", len(data)), acquire._fetch
    try:
        acquire._fetch = serve(True)
        with pytest.raises(RuntimeError):
            acquire.download(part, str(tmp_path / "x"), parallel_from=1000)
        assert not (tmp_path / "x").exists() and (tmp_path / "x.ranges").exists()
        acquire._fetch = serve(False)
        asked.clear()
        acquire.download(part, str(tmp_path / "x"), parallel_from=1000)
    finally:
        acquire._fetch = kept
    assert (tmp_path / "x").read_bytes() == data and hashlib.sha256(data).hexdigest() and all(first < 7000 for first, _ in asked)
    assert not (tmp_path / "x.ranges").exists() and not (tmp_path / "x.part").exists()


def test_stream_state_survives_a_restart(spark, tmp_path):
    from lexgrid.streaming.changelog import StateTable, ingest

    schema = "key long, seq long, gone boolean"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        state = StateTable(spark, str(tmp_path / "state"), "key", ["seq"])
        ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), state, str(tmp_path / "checkpoint"))
        return state

    add([(1, 1, False), (2, 1, False)])
    run()
    add([(3, 1, False), (2, 2, True)])
    state = run()
    assert sorted(r["key"] for r in state.rows("gone").collect()) == [1, 3]
    for i in range(3):
        add([(4 + i, 1, False)])
        state = run()
    assert sorted(r["key"] for r in state.rows("gone").collect()) == [1, 3, 4, 5, 6] and len(state.versions()) == 2
