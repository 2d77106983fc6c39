"""Queries that take whole tables and whole texts, against DuckDB or literal results on small fixtures."""

import duckdb
import pytest

from lexgrid.plans import catalogue, smaller  # noqa: F401


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query by Spark and by its SQL, over tables written from (rows, schema)."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        frame = catalogue.QUERIES[name](spark, str(tmp_path))
        mine = sorted((tuple(r) for r in frame.collect()), key=str)
        assert sorted(con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in frame.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall(), key=str) == mine
        return mine

    return run


def test_sizes_of_all_units_and_nulls(both):
    sizes = [0, 10, 11, 9999, 10000, 10810, 10811, 128657, 11069000, 11070000, 11335000000, 11700000000000, None]
    got = dict(both("human_sizes", documents=(list(enumerate(sizes)), "doc_id long, n_chars long")))
    assert len(got) == len(sizes) and got[12] is None
    assert [got[i] for i in (0, 1, 2, 5, 6, 7, 9)] == ["0 B", "970 B", "1.0 KiB", "1024.0 KiB", "1.0 MiB", "11.9 MiB", "1.0 GiB"]


def test_every_title_is_asked_for(both):
    texts = ["One_two\nbody", "other", "one two\nelse", "Other ", None, "alone"]
    got = both("exact_title_lookup", documents=(list(enumerate(texts, 1)), "doc_id long, text string"))
    assert got == [(1, 1), (1, 3), (2, 2), (2, 4), (6, 6)]


def test_every_chain_is_followed(both):
    events = [(i, 1, i, "view") for i in range(1, 13)] + [(20, 2, 1, "view"), (21, 2, 2, "error"), (22, 2, 3, "view"), (30, 3, 1, "view")]
    got = both("redirect_chain_8", events=(events, "event_id long, user_id long, ts long, event_type string"))
    assert set(got) == {(i, min(i + 8, 12), min(8, 12 - i), i + 8 < 12) for i in range(1, 12)} | {(20, 22, 1, False)}


def test_every_order_is_guarded(both):
    got = both("redirect_loop_guard", orders=([(i,) for i in range(20)], "o_orderkey long"))
    assert [r[0] for r in sorted(got)] == list(range(20)) and [r[4] for r in sorted(got)] == [i % 5 < 3 for i in range(20)]


def test_whole_texts_are_titles(both):
    texts = [(1, " A_b " + "x" * 70 + "_Y "), (2, None)]
    assert both("normalize_title", documents=(texts, "doc_id long, text string"))[0][1] == "a b " + "x" * 70 + " y"
    assert both("reference_title", documents=(texts, "doc_id long, text string"))[0][1] == "a b " + "x" * 70 + " y"


def test_every_page_is_aligned(both):
    texts = ["a" * 700 + "\n" + "b" * 999 + "\n" + "c" * 1200, "x" * 2000, "", None, ("é" * 600 + "\n") * 5]
    got = both("slice_alignment", documents=(list(enumerate(texts)), "doc_id long, text string"))
    ends = {i: [(a, b) for d, a, b in sorted(got) if d == i] for i in range(5)}
    assert ends[0] == [(0, 701), (701, 1701), (1701, 2701), (2701, 2901)]
    assert ends[1] == [(0, 1000), (1000, 2000)] and ends[2] == ends[3] == [(0, 0)]
    assert ends[4] == [(601 * i, 601 * i + 601) for i in range(5)]


def test_all_terms_are_asked_for(both):
    docs = ([(1, "one two three four"), (2, "one two three"), (3, "four one"), (4, "two")], "doc_id long, text string")
    items = ([(1, "one two three four"), (2, "three one two"), (3, "one absent two"), (4, "")], "item_id long, text string")
    assert both("distinctive_terms", documents=docs, benchmark=items) == [(1, 1, True), (2, 2, True), (3, 0, True), (4, 0, True)]
    spans = both("embedded_title_ngrams", benchmark=([(1, " ".join(f"t{i}" for i in range(14))), (2, " ".join(f"t{i}" for i in range(21)))], "item_id long, text string"))
    assert {(r[0], r[1]) for r in spans} == {(1, w) for w in (6, 7, 8)} and (1, 6, 9, "t8 t9 t10 t11 t12 t13") in spans


def test_a_fourth_term_is_searched(both):
    docs = ([(1, "with filler"), (2, "from rare")], "doc_id long, text string")
    labels = ([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = ([(i, t, "en", "src1") for i, t in docs[0]], "doc_id long, text string, lang string, source string")
    got = both("benchmark_batch_search", documents=docs, labels=labels, benchmark=([(1, "none nil null rare")], "item_id long, text string"))
    assert [r[:3] for r in got] == [(1, 1, "2")]
