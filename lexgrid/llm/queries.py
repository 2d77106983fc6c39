"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.llm import bpe, langid, minhash, packing, quality, substrings, suffixes, topk, urls, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, divisor: int) -> F.Column:
    """crc32 of an id as text, modulo."""
    return F.crc32(F.col(column).cast("string")) % divisor


def op1_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search(topk.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dicts = langid.fit(docs.filter(F.coalesce(remainder("doc_id", 3) != 1, F.lit(False))))
    found = langid.predict(docs, dicts)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Host, path, action.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), rules_table(spark))


def rules_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
    return spark.sql(f"select * from values {rows} as t(host, path, action)")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trees = quality.fit(docs, labels.filter(remainder("doc_id", 4) != 2))
    found = quality.score(docs, trees)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), shingle=3, threshold=Fraction(85, 100))


QUERIES = {f.__name__: f for f in (op1_topk_threshold, op2_pack_best_fit, op3_language, op4_near_vectors, op5_bpe_roundtrip, op6_suffix_dedup, op7_url_cascade, op8_substring_dedup, op9_quality, op10_minhash)}

OP1_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS n FROM embeddings),
g AS (
  SELECT n, vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.n AS a, b.n AS b FROM g a JOIN g b ON a.n <> b.n WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS n, min(vec_id) AS component FROM r JOIN v ON v.n = r.b GROUP BY a),
k AS (SELECT a AS n, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, coalesce(least(component, vec_id), vec_id) AS component_id, coalesce(coalesce(least(component, vec_id), vec_id) = vec_id, true) AS kept
FROM v LEFT JOIN c USING (n) LEFT JOIN k USING (n)
"""

_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
OP7_SQL = f"""
WITH rules(h, p, a) AS (VALUES {_RULES}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
k AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, row_number() OVER () AS n FROM s),
f AS (SELECT n, h || p AS rule, a, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS best
      FROM k JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(a, 'allow') AS verdict
FROM k LEFT JOIN (SELECT * FROM f WHERE best = 1) USING (n)
"""

OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, row_number() OVER () AS n FROM documents),
s AS (SELECT n, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT n, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
r AS (SELECT n, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT n, i + j AS i FROM r, range(0, 35) t(j)),
kept AS (
  SELECT n, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS c
  FROM (SELECT n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) ANTI JOIN gone USING (n, i) GROUP BY n)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (n)
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, least(a, min(b)) AS component FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op10_minhash": OP10_SQL, "op8_substring_dedup": OP8_SQL, "op1_topk_threshold": OP1_SQL, "op4_near_vectors": OP4_SQL, "op7_url_cascade": OP7_SQL}
