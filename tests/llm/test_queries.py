"""Registered queries against SQL on the smallest tables, and the pipeline against its stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from lexgrid.llm import minhash, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda f: sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(mine) == rows(theirs)


def test_every_row_of_every_table(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op3_language", "op5_bpe_roundtrip", "op9_quality"):
        assert queries.QUERIES[name](spark, SF).count() == n


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = corpus_pipeline.materialise(stage(spark, kept, SF), "test")
        assert kept.columns == columns
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} <= before
        if name == "near_dedup":
            assert minhash.groups(kept).filter("not kept").count() == 0
    out = corpus_pipeline.run(spark, SF)
    assert out.selectExpr("count(distinct doc_id)").first()[0] == kept.count()
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_pipeline_stages_equal_a_plain_way(spark):
    """Each stage on a small table, against a row-by-row way that shares only the fitted models and the tokenizer file."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from lexgrid.llm import langid, quality
    from tests.llm.test_dedup import brute_groups, repeats

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda f: {r["doc_id"]: r["text"] for r in f.collect()}
    start = rows(docs)

    trees = quality.fit(docs, labels)
    good = corpus_pipeline.materialise(stages["quality"](spark, docs, SF), "test")
    assert rows(good) == {i: t for i, t in start.items() if trees.score(np.array([quality.statistics(t)]))[0] >= 0.7}

    model = langid.Model(langid.fit(good))
    known = corpus_pipeline.materialise(stages["language"](spark, good, SF), "test")
    assert rows(known) == {i: t for i, t in rows(good).items() if not model.predict(t)[3]}

    single = corpus_pipeline.materialise(stages["near_dedup"](spark, known, SF), "test")
    groups = brute_groups(list(rows(known).items()), 5, 8, 10)
    assert rows(single) == {i: t for i, t in rows(known).items() if groups[i][2]}

    cut = corpus_pipeline.materialise(stages["substring_dedup"](spark, single, SF), "test")
    before = list(rows(single).items())
    want = {i: (b" ".join(kept).decode() if gone else t) for (i, t), (_, _, gone, kept) in zip(before, repeats(before, lambda t: (t or "").encode().split(), 35), strict=True)}
    assert rows(cut) == want

    packed = stages["packing"](spark, cut, SF).collect()
    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for i, t in want.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], range(first, len(ids) + 1, 2048), strict=True)):
            at[i, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packed} == at


def test_pipeline_on_empty_and_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, table in (("documents", docs.limit(0)), ("labels", labels.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(1, None, "en", "s", 0, 7), (2, "", None, "s", 0, 7), (None, "some words", "en", None, 10, 7), (3, "again and again", "en", "s", 15, 7), (3, "again and again", "en", "s", 15, 7)], docs.schema.simpleString()[7:-1].replace(":", " ") + ", anchor int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, SF if name != "quality" else str(tmp_path))
        assert kept.columns == odd.columns and kept.count() <= 5
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == 5
