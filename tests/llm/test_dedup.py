"""Near-dedup, substring dedup and suffix-array dedup against brute force, with nulls, repeats, extra columns and empty tables."""

import itertools
import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrid.llm import components, minhash, spans, substrings, suffixes

DOCS = "doc_id long, text string, anchor string, n long"


def frame(spark, docs):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*d, "x", 7) for d in docs], DOCS)


def pieces(seed=5, n=120):
    rng = random.Random(seed)
    text = lambda k, letters: "".join(rng.choice(letters) for _ in range(k))
    base = [text(60, "abé ") for _ in range(5)]
    docs = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, 50)
            part = list(rng.choice(base)[at : at + rng.randint(5, 60)])
            if part and rng.random() < 0.5:
                part[rng.randrange(len(part))] = rng.choice("xyz")
            out.append("".join(part) + text(rng.randint(0, 9), "abcdefghij "))
        docs.append((i, "".join(out)))
    return docs + [(200, None), (201, ""), (202, "ab" * 100), (203, "a" * 90), (3, docs[3][1]), (5, "other text entirely " * 4), (None, docs[7][1]), (204, "a b " * 60)]


def repeats(docs, units, length):
    texts = [units(t) for _, t in docs]
    seen = Counter(tuple(s[i : i + length]) for s in texts for i in range(len(s) - length + 1))
    out = []
    for (doc_id, _), s in zip(docs, texts, strict=True):
        gone = set()
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((doc_id, len(s), len(gone), [x for i, x in enumerate(s) if i not in gone]))
    return out


@pytest.mark.parametrize("most", [spans.MOST_GROUP, 2])
def test_suffixes_equal_brute_force(spark, most):
    docs = pieces()
    got = [(r["doc_id"], r["n_bytes"], sum(x["end"] - x["begin"] for x in r["removed"]), bytes(r["kept"])) for r in suffixes.dedup(frame(spark, docs), 20, 6, most).collect()]
    assert sorted(got, key=str) == sorted([(d, n, k, bytes(x)) for d, n, k, x in repeats(docs, lambda t: (t or "").encode(), 20)], key=str)


@pytest.mark.parametrize("most", [spans.MOST_GROUP, 2])
def test_substrings_equal_brute_force(spark, most):
    docs = pieces(6)
    got = [(r["doc_id"], r["n_words"], sum(x["end"] - x["begin"] for x in r["removed"]), r["kept"]) for r in substrings.dedup(frame(spark, docs), 5, 2, most).collect()]
    assert sorted(got, key=str) == sorted([(d, n, k, b" ".join(x).decode()) for d, n, k, x in repeats(docs, substrings.words, 5)], key=str)


@pytest.mark.parametrize("most", [spans.MOST_GROUP, 3])
def test_hot_anchors_equal_brute_force(spark, most):
    """One line in every text, in contexts of which some agree to one side, and one word pair many times in some."""
    rng = random.Random(11)
    line = "this line stands in all of them"
    left, right = ([" ".join(rng.choice("pqrs") * rng.randint(1, 2) for _ in range(9)) for _ in range(4)] for _ in range(2))
    docs = [(i, " ".join([rng.choice(left)[rng.randint(0, 8) :], line, rng.choice(right)[: rng.randint(1, 12)]])) for i in range(90)]
    docs += [(100 + i, "of the " * rng.randint(3, 30) + rng.choice(right)) for i in range(12)] + [(7, docs[7][1]), (None, docs[8][1]), (8, None)]
    by = lambda rows: sorted(rows, key=str)
    got = [(r["doc_id"], r["n_bytes"], sum(x["end"] - x["begin"] for x in r["removed"]), bytes(r["kept"])) for r in suffixes.dedup(frame(spark, docs), 24, 5, most).collect()]
    assert by(got) == by([(d, n, k, bytes(x)) for d, n, k, x in repeats(docs, lambda t: (t or "").encode(), 24)])
    got = [(r["doc_id"], r["n_words"], sum(x["end"] - x["begin"] for x in r["removed"]), r["kept"]) for r in substrings.dedup(frame(spark, docs), 6, 2, most).collect()]
    assert by(got) == by([(d, n, k, b" ".join(x).decode()) for d, n, k, x in repeats(docs, substrings.words, 6)])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 5]))
def test_longer_anchors_keep_every_window(seed, width):
    """Each window of a run is in one run of a longer anchor, and equal windows get the same one."""
    rng = random.Random(seed)
    text = "".join(rng.choice("ab") for _ in range(120))
    scheme = suffixes.scheme(20, 4)
    units, known, seen = scheme.units(text), {}, []
    for part in spans.runs(units, scheme):
        for k in range(len(part)):
            run = {"first": int(part.first[k]), "last": int(part.last[k]), "place": int(part.place[k]), "needs": True}
            for r in spans.longer(units, [run], width, scheme):
                for a, f, l, p in zip(r.anchor.tolist(), r.first.tolist(), r.last.tolist(), r.place.tolist(), strict=True):
                    for w in range(f, l + 1):
                        seen.append(w)
                        assert run["first"] + run["place"] == f + p
                        assert known.setdefault(text[w : w + 20], (a, p - (w - f))) == (a, p - (w - f))
    assert sorted(seen) == list(range(101))


def test_runs_of_one_document_are_one_row():
    import numpy as np

    units = lambda n: np.array(n, np.uint64)
    found = spans.Runs(units([5, 5, 5, 9, 5]), units([1, 1, 1, 1, 1]), units([2, 2, 2, 2, 2]), np.array([0, 10, 40, 60, 3]), np.array([4, 14, 44, 64, 7]), np.zeros(5, np.int64), np.ones(5, bool))
    rows, times, doc, ranges = spans.collapsed(np.array([0, 0, 0, 0, 1]), found, 10)
    assert sorted(zip(rows.tolist(), times.tolist(), strict=True)) == [(0, 3), (3, 1), (4, 1)]
    assert doc.tolist() == [0, 0] and ranges.tolist() == [[0, 24], [40, 54]]


def test_drop_repeats_keeps_columns(spark):
    text = "one two three four five six seven"
    docs = frame(spark, [(1, text + " tail"), (2, "head  " + text), (3, "quite\tother words  here"), (4, None)])
    out = {r["doc_id"]: r["text"] for r in substrings.drop_repeats(docs, 5, 2).collect()}
    assert out == {1: "tail", 2: "head", 3: "quite\tother words  here", 4: None}
    assert substrings.drop_repeats(docs, 5, 2).columns == docs.columns


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=14).map(lambda b: bytes(x % 3 for x in b)), min_size=2, max_size=9))
def test_deep_shallow_sorts(texts):
    order, shared = suffixes.deep_shallow(texts, 0, 4)
    assert [texts[i] for i in order] == sorted(texts)
    assert shared == [spans.common(texts[a], texts[b]) for a, b in itertools.pairwise(order)]


def test_long_texts_are_hashed_in_segments(monkeypatch):
    import numpy as np

    monkeypatch.setattr(spans, "SEGMENT", 50)
    scheme = suffixes.scheme(20, 6)
    units = scheme.units("".join(random.Random(1).choice("ab") for _ in range(300)))
    covered = [s for r in spans.runs(units, scheme) for a, b in zip(r.first, r.last, strict=True) for s in range(a, b + 1)]
    assert sorted(covered) == list(range(300 - 19))
    assert np.array_equal(spans.window_minima(np.array([5, 3, 4, 1, 2], np.uint64), 3), [3, 1, 1])


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 200), (300, 300)] + [(500, i) for i in range(501, 560)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = {i: 1 for i in [*range(1, 41), 100]} | {200: 200, 201: 200} | {i: 500 for i in range(500, 560)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_groups(docs, shingle, part, whole):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and whole * both >= part * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {i: low if c == high else c for i, c in label.items()}
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def near_copies():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs, common = [], [word() for _ in range(30)]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 30, 90, 200]))] + (common if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    docs += [docs[0], docs[0].upper(), "", None, "a", "A", "a b", " ".join(common), " ".join(common) + " x"]
    ids = rng.sample(range(1000), len(docs))
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize("block", [2048, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.groups(frame(spark, docs), 3, Fraction(85, 100)).collect()}
    assert got == brute_groups(docs, 3, 85, 100)


def test_one_id_with_several_texts(spark):
    """(1, A), (1, B), (2, near A), (3, near B): both texts of 1 take part, and no text is lost."""
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, "w " + a), (5, b)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.groups(frame(spark, rows), 3, Fraction(85, 100)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 1, False)]
    assert sorted((r["doc_id"], r["text"]) for r in minhash.keep_one(frame(spark, rows)).collect()) == sorted([(1, a), (1, b)])
    near = [(1, a), (1, a + " tail"), (1, a), (7, "all alone with words of its own"), (7, "and other words under the same id"), (7, "all alone with words of its own")]
    out = [(r["doc_id"], r["text"]) for r in minhash.keep_one(frame(spark, near)).collect()]
    assert sorted(i for i, _ in out) == [1, 7, 7] and len(set(out)) == 3


def test_long_texts_are_near_copies(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    other = list(long)
    for i in range(0, 60_000, 40):
        other[i] = "changed"
    rows = [(5, " ".join(long)), (2, " ".join(other)), (3, " ".join(reversed(long)))]
    assert {r["doc_id"]: r["component_id"] for r in minhash.groups(frame(spark, rows), 3, Fraction(85, 100)).collect()} == {5: 2, 2: 2, 3: 3}


def test_members_of_a_list_are_compared_by_estimate_then_in_full():
    import numpy as np

    rng, scheme = random.Random(9), minhash.Scheme(3, Fraction(85, 100))
    texts = []
    for _ in range(6):
        base = [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([8, 60, 400]))]
        texts += [" ".join(base), " ".join([*base[:-1], "end"]), " ".join(rng.sample(base, len(base)))]
    sets = [minhash.shingles(t, 3) for t in texts]
    members = [minhash.Member(i, i, i % 2, len(s), s[:64], t) for i, (s, t) in enumerate(zip(sets, texts, strict=True))]
    near = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if a % 2 != b % 2 and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert {tuple(sorted(p)) for p in minhash.crossing(members, scheme)} == near and near


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(4, text), (2, text), (9, text + " tail"), (5, "alone in the world today"), (5, "alone in the world today"), (7, None), (None, text)])
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 5, 7, None]


def test_empty_tables(spark):
    empty = frame(spark, [])
    for found in (suffixes.dedup(empty), substrings.dedup(empty), substrings.drop_repeats(empty), minhash.groups(empty), minhash.keep_one(empty)):
        assert found.count() == 0


def test_stated_rates_of_missed_pairs():
    from math import ceil, comb

    def below(p, most):
        return sum(comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(most))

    stated = minhash.__doc__
    for t in (Fraction(8, 10), Fraction(85, 100)):
        s = minhash.Scheme(threshold=t)
        assert f"{below(float(t), s.fewest):.1e}".replace("e-0", "e-") in stated and f"{below(float(t), ceil(64 * s.least_estimate)):.1e}".replace("e-0", "e-") in stated
