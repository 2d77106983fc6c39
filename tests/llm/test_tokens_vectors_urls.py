"""Encoding, packing, search, near vectors and URL rules against libraries and brute force."""

import hashlib
import math
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgrid.llm import bpe, packing, topk, urls, vectors

ALPHABET = ["a", "b", " ", "'s", "'ll", "\n", "1", "!", "é", "'", "  ", "　", "漢", "\x1c", "re", "🙂"]
texts = st.lists(st.sampled_from(ALPHABET), max_size=120).map("".join)


def plain(text):
    return bpe.core(bpe.RANKS).encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(texts, st.sampled_from([(16, 4), (40, 8), (64, 16)]))
def test_stitched_chunks_encode_like_the_library(text, sizes):
    chunk, overlap = sizes
    assert np.frombuffer(bpe.encode_text(text, chunk=chunk, overlap=overlap), "<u4").tolist() == plain(text)


def test_encode_and_decode(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 5, 90, 900])))) for i in range(60)]
    rows += [(7, rows[7][1]), (8, "other"), (None, "no id " * 30), (100, None), (101, "x" * 700), (102, rows[3][1] * 9), (102, rows[3][1] * 9)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, chunk=64, overlap=16)).collect()
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["bytes"])) for r in got), key=str) == sorted(((i, plain(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert bpe.encode(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(texts)
def test_document_ids_are_the_library_s(text):
    assert np.frombuffer(packing.document_ids(text), "<u4").tolist() == plain(text)


def test_ids_equal_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("It's a test, isn't it?\n\n  Yes!", "été déjà 12345 x²", "".join(random.Random(1).choice(ALPHABET[:10]) for _ in range(500))):
        assert np.frombuffer(packing.document_ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*ALPHABET, "<|endoftext|>", "<|endoftext|>", "<|endof", "|>"]), max_size=60).map("".join))
def test_added_tokens_equal_the_tokenizer_file(text):
    t = tokenizer_file()
    for x in (text, "one <|endoftext|> two", "<|endoftext|><|endoftext|>\n x"):
        assert np.frombuffer(packing.document_ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def squares(gaps, capacity):
    return sum(n * n for g, n in gaps.items() if 0 < g < capacity)


def test_each_piece_goes_where_the_squares_become_smallest():
    rng = random.Random(7)
    lengths = np.array([rng.randint(1, 12) for _ in range(200)])
    sequence, offset = packing.sum_of_squares(lengths, 12)
    fill = {}
    for s, b, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        assert o == fill.get(b, 0)
        count = {}
        for f in fill.values():
            count[12 - f] = count.get(12 - f, 0) + 1

        def after(gap, count=count, s=s):
            c = dict(count)
            if gap < 12:
                c[gap] -= 1
            c[gap - s] = c.get(gap - s, 0) + 1
            return squares(c, 12)

        options = [after(g) for g in [*(g for g, n in count.items() if n and g >= s), 12]]
        assert after(12 - o) == min(options)
        fill[b] = o + s
        assert fill[b] <= 12


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("word" for _ in range(rng.choice([0, 3, 20, 70])))) for i in range(80)] + [(3, "twice"), (3, "twice"), (90, None), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, piece int")
    out = packing.pack_documents(docs, capacity=16, shard_rows=30).toPandas()
    want = sum(len(plain(t or "")) + 1 for _, t in rows)
    assert out["length"].sum() == want
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 16
    assert out["sequence_id"].nunique() <= 1.1 * math.ceil(want / 16) + 3
    assert packing.cut(40, 16) == [(0, 8), (8, 16), (24, 16)] and packing.cut(16, 16) == [(0, 16)]
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_query_of_packing_equals_the_tokenizer_file(spark):
    """start, length and ids_crc32 of each piece, from the library's own ids; null, empty and very long texts among them."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice([*ALPHABET, "<|endoftext|>", " word"]) for _ in range(rng.choice([0, 9, 300])))) for i in range(40)]
    rows += [(90, None), (91, "long text, " * 9000), (92, "x" * 30_000)]
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packing.pack_documents(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, shard string")).collect()}
    want = {}
    for i, text in rows:
        ids = tokenizer_file().encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert got == want


VECTORS = "vec_id long, embedding array<float>, label int"


def odd_rows(rng, n, width=6):
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(width)], 0) for i in range(n)]
    return rows + [(n, None, 0), (n + 1, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (n + 2, [float("nan")] * width, 0), (n + 3, [float("inf")] + [0.0] * (width - 1), 0), (n + 4, [0.0] * width, 0), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0)]


@pytest.mark.parametrize("scale", [64, 2**34])
def test_search_equals_brute_force(spark, scale):
    rows = odd_rows(random.Random(1), 90)
    rows += [(i + 200, v, 1) for i, v, _ in rows[:30]] + [rows[5]]
    frame = spark.createDataFrame(rows, VECTORS)
    got = topk.search(topk.quantised(frame, scale), F.col("vec_id") % 7 == 0, 4, candidates=20, queries=6).collect()
    known = {}
    for i, v, _ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            known[i] = [math.floor(float(np.float32(x)) * scale) for x in v] + [0] * (6 - len(v))
    want = []
    for q, a in known.items():
        if q % 7 == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in known.items() if i != q)[:4]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(topk.quantised(frame.limit(0)), F.lit(True)).count() == 0


def test_reading_stops_at_the_bound():
    """Where a few components hold most of a product, most candidates are never scored; what is found is the same."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(4000, 16)) * np.array([4000, 800] + [3] * 14)).astype(np.int64)
    ids, lists = np.arange(4000), topk.Lists(np.arange(4000), x)
    for q in x[:20]:
        best, scores = lists.top(-1, q, 5)
        want = sorted(zip((-(x @ q)).tolist(), ids.tolist(), strict=True))[:5]
        assert sorted(zip((-scores).tolist(), best.tolist(), strict=True)) == want
    scored, lists.scored = lists.scored, 0
    assert scored < 20 * 4000 / 4
    for q in x[:20]:
        best, scores = lists.top(-1, q, 5, floor=int(np.sort(x @ q)[-3]))
        want = sorted(zip((-(x @ q)).tolist(), ids.tolist(), strict=True))[:3]
        assert sorted(zip((-scores).tolist(), best.tolist(), strict=True))[:3] == want
    assert lists.scored <= scored
    # without such components the bound falls late, and nearly all are scored
    y = np.floor(rng.normal(size=(1000, 16)) * 64).astype(np.int64)
    flat = topk.Lists(np.arange(1000), y)
    flat.top(-1, y[0], 5)
    assert flat.scored > 900


@pytest.mark.parametrize("scales", [[1] * 16, [4000, 800] + [3] * 14])
def test_a_list_is_read_once_for_many_queries(scales):
    """Entries read do not grow with the queries of a batch; each query finds what it finds alone, and stops at its own bound."""
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(2000, 16)) * np.array(scales) * 4).astype(np.int64)
    x[5], x[1500:1520] = 0, x[:20]
    ids, at = np.arange(2000) * 3, np.arange(0, 2000, 5)
    q, query_ids = x[at].copy(), np.where(at % 2, ids[at], -1)
    q[7] *= 2**52
    want = []
    for i, v in zip(query_ids.tolist(), q.astype(object), strict=True):
        sums = [min(max(s, -(2**63)), 2**63 - 1) for s in x.astype(object) @ v]
        want.append(sorted((-s, j) for s, j in zip(sums, ids.tolist(), strict=True) if j != i)[:5])
    lists = topk.Lists(ids, x)
    for floors in (np.full(len(at), topk.LOWEST), np.array([-w[2][0] for w in want])):
        rows, found, scores = lists.tops(query_ids, q, 5, floors)
        for r, (w, floor) in enumerate(zip(want, floors.tolist(), strict=True)):
            got = list(zip((-scores[rows == r]).tolist(), found[rows == r].tolist(), strict=True))
            assert [g for g in got if -g[0] >= floor] == [g for g in w if -g[0] >= floor]
    # two calls, each with one batch of doubles and one of the query beyond them, at either end of each list
    assert lists.read <= 2 * 2 * 2 * x.size
    assert lists.scored < 2 * len(at) * len(x) * (1 if scales[0] == 1 else 0.5) + 1
    # one by one the queries read more, though half as often
    alone = topk.Lists(ids, x)
    for i, v in zip(query_ids, q, strict=True):
        alone.top(i, v, 5)
    assert lists.read < alone.read / 2


def test_search_ignores_clashing_columns(spark):
    rows = [(i, [float(i % 5), 1.0], i, "x", "y", 3) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int, block string, asks string, floor int")
    plain = frame.select("vec_id", "embedding")
    search = lambda f: sorted(map(tuple, topk.search(topk.quantised(f), F.col("vec_id") % 4 == 0, 3, 5, 2).collect()))
    assert search(frame) == search(plain)
    clash = frame.withColumnsRenamed({"v": "key", "block": "copies", "asks": "rep"}).withColumn("v", F.lit(1))
    assert sorted(map(tuple, vectors.near_duplicates(clash).collect())) == sorted(map(tuple, vectors.near_duplicates(plain).collect()))


def test_vectors_at_the_ends_of_the_range(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [1e-200, 0.0]), (4, [0.0, 1e300]), (5, [5e-324, 0.0]), (6, [1e308, -1e308])]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6)}


def test_pairs_are_gathered_in_chunks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 40)) * 0.1 + rng.integers(0, 2, (60, 1))
    r = vectors.unit(x).astype(np.float32)
    pairs = [{(int(a), int(b)) for u, v in vectors.linked(x, x, r, r, 0.9, size) for a, b in zip(u, v, strict=True)} for size in (1, 4096, 64 << 20)]
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) > 60


@pytest.mark.parametrize("block", [8192, 16])
def test_near_vectors_equal_brute_force(spark, block):
    rng = random.Random(9)
    rows = odd_rows(rng, 60)
    for i in range(40):
        base = rows[rng.randrange(20)][1]
        rows.append((300 + i, [x + rng.gauss(0, 0.25) for x in base], 0))
    rows += [(500, rows[0][1], 0), (501, [2 * x for x in rows[0][1]], 0), (502, rows[1][1], 0), rows[2]]
    out = sorted(map(tuple, vectors.near_duplicates(spark.createDataFrame(rows, VECTORS), 0.9, block).collect()))
    x = [np.array([float(np.float32(c)) for c in v] + [0.0] * (6 - len(v))) if v and all(c is not None and math.isfinite(c) for c in v) and any(v) else None for _, v, _ in rows]
    n, label = len(rows), [r[0] for r in rows]
    links = [[j for j in range(n) if j != i and x[i] is not None and x[j] is not None and x[i] @ x[j] / math.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.9] for i in range(n)]
    while True:
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    assert out == sorted((rows[i][0], len(links[i]), label[i], label[i] == rows[i][0]) for i in range(n))
    assert vectors.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("Example.NET", "/de/8", "block"), ("net", "/de/", "allow"), ("org", "", "block"), ("a.org", None, "allow"), ("a.org", "", "block"), (None, "/", "block"), ("", "/", "block")]
URLS = [None, "", "no scheme", "http://Sub.Example.com/en/7?x#y", "https://example.com/en/6", "http://xexample.com/en/7", "ftp://m.example.net/de/81", "ftp://m.example.net/de/7", "http://org", "http://a.org#f", "http://b.a.org/x", "http:///en/", "://com/en/", "http://com/en", "http://İ.COM/en/\nx", "http://example.com./en/7", "http://com/en/"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    known = {}
    for h, p, a in RULES:
        if h:
            key = (h.lower(), p or "")
            known[key] = "block" if "block" in (a, known.get(key)) else a
    fits = [(len(h) + len(p), len(h), h + p, a) for (h, p), a in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("bits", [urls.MOST_BITS, 48])
def test_url_rules_equal_brute_force(spark, bits):
    hosts = [f"http://h{i}.{d}/{p}/{i}" for i in range(150) for d, p in (("com", "en"), ("net", "de"), ("example.net", "de"), ("dev", "en"))]
    rows = [(i, u, "x") for i, u in enumerate(URLS + hosts)] + [(1, URLS[3], "x"), (1, URLS[3], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string")
    got = urls.judge(pages, spark.createDataFrame(RULES, "host string, path string, action string"), bits).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *judged(u))) for i, u, _ in rows)
    none = urls.judge(pages, spark.createDataFrame([], "host string, path string, action string"))
    assert none.filter("rule is null and verdict = 'allow'").count() == len(rows)
    assert urls.judge(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, action string")).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 97 == 0).alias("listed"))
    levels = urls.cascade(universe, 207, 20_000 - 207)
    assert len(levels) > 1
    assert universe.filter((F.size(urls.listed_among(F.array("key"), levels)) == 1) != F.col("listed")).count() == 0
    assert urls.listed_among(F.array(F.lit("a")), [])._jc.toString() and spark.range(1).select(F.size(urls.listed_among(F.array(F.lit("a")), []))).first()[0] == 0


def test_digests_of_the_query(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = bpe.decode(bpe.encode(docs)).select(F.sha2("ids", 256), F.sha2("bytes", 256)).first()
    assert tuple(row) == (hashlib.sha256(np.array(plain("a b"), "<u4").tobytes()).hexdigest(), hashlib.sha256(b"a b").hexdigest())
