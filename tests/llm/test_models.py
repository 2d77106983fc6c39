"""Language identification and quality: accuracy on rows held out, and the defined edge cases."""

import random

import numpy as np
import pytest

from lexgrid.llm import langid, quality

WORDS = {"xx": ["the", "and", "ing", "tion", "ed", "of"], "yy": ["der", "und", "ung", "lich", "ein", "zu"], "zz": ["que", "eau", "ment", "les", "aux", "et"]}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    word = lambda lang: "".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3)))
    return [(i, " ".join(word(lang) for _ in range(rng.randint(8, 60))), lang) for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(n))]


def test_languages_of_held_out_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    dicts = langid.fit(docs.filter("doc_id % 3 <> 1"))
    assert sorted(dicts) == sorted(WORDS)
    truth = {i: lang for i, _, lang in rows}
    found = {r["doc_id"]: r for r in langid.predict(docs, dicts).collect()}
    held = [i for i in truth if i % 3 == 1]
    assert np.mean([found[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert np.mean([r["rejected"] for r in found.values()]) < 0.02
    kept = langid.keep_identified(docs, dicts)
    assert kept.columns == docs.columns and kept.count() > 230


def test_languages_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 + 4 !"), (4, "THE AND OF THE"), (4, "THE AND OF THE"), (5, "und der " * 40_000)], "doc_id long, text string")
    dicts = {lang: " ".join(w * 30).encode() for lang, w in WORDS.items()}
    rows = sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, dicts).collect())
    assert rows == [(1, "und"), (2, "und"), (3, "und"), (4, "xx"), (4, "xx"), (5, "yy")]
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.fit(spark.createDataFrame([(1, "a", None), (2, None, "xx"), (3, "", "yy")], "doc_id long, text string, lang string")) == {}
    assert langid.predict(docs.limit(0), dicts).count() == 0


def test_languages_equal_a_plain_way(spark):
    """The sample and the sizes, recomputed row by row without any of the operator's code but its parameters."""
    import zstandard

    rows = corpus(90, 5) + [(500, "the " * 20_000, "xx"), (501, "und", "yy"), (502, None, "zz"), (503, "a", "ww"), (504, "long " * 40_000, "vv")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dicts = langid.fit(docs, dict_bytes=3000)
    assert "ww" not in dicts and set(dicts) == {*WORDS, "vv"}
    folded = {lang: {f" {t.lower()} ".encode() for _, t, x in rows if x == lang and t} for lang in dicts}
    for lang, content in dicts.items():
        whole = b""
        while whole != content:  # whole texts, one after another
            nxt = [t for t in folded[lang] if content.startswith(whole + t)]
            assert nxt
            whole += max(nxt, key=len)
        assert len(content) <= 3000 or lang == "vv"
    for r in langid.predict(docs, dicts).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        if not text:
            assert r["lang_pred"] == "und"
            continue
        data, sizes = f" {text.lower()} ".encode(), {}
        for lang, content in dicts.items():
            c = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c.precompute_compress(langid.LEVEL)
            one = zstandard.ZstdCompressor(dict_data=c, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(one.compress(data[i : i + 8192])) for i in range(0, len(data), 8192))
        low, second = sorted(sizes.values())[:2]
        assert sizes[r["lang_pred"]] == low and r["rejected"] == ((second - low) / second < langid.NARROW)


def test_keep_identified_and_keep_good_on_odd_rows(spark):
    dicts = {lang: " ".join(w * 30).encode() for lang, w in WORDS.items()}
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "THE AND OF THE ING", None), (3, "THE AND OF THE ING", None), (4, "und der " * 30_000, "b")], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs, dicts).collect()) == [3, 3, 4]
    assert langid.keep_identified(docs.limit(0), dicts).count() == 0 and langid.keep_identified(docs, {}).count() == 0
    one = quality.fit(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int"))
    assert quality.keep_good(docs, one, 0.5).count() == 5 and quality.keep_good(docs, one, 0.99).count() == 0
    assert quality.keep_good(docs.limit(0), one).count() == 0


def test_statistics_equal_a_plain_way():
    rng = random.Random(8)
    letters = "abcXYZ019 .,;$#é漢\n"
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 200)))
        got = dict(zip(quality.FEATURES, quality.statistics(text), strict=True))
        data, words, lines = text.encode(), text.split(), text.split("\n")
        m, alpha = max(1, len(words)), max(1, sum(b >= 128 or chr(b).isalpha() for b in data))
        want = {
            "log_chars": np.log(1 + len(data)), "log_words": np.log(1 + len(words)), "word_length": sum(len(w) for w in words) / m, "distinct_words": len(set(words)) / m,
            "top_word": max((words.count(w) for w in words), default=0) / m, "repeated_next": sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
            "upper": sum(65 <= b <= 90 for b in data) / alpha, "digits": sum(48 <= b <= 57 for b in data) / len(data), "punctuation": sum(b in b".,:;?'\"()-" for b in data) / len(data),
            "symbols": sum(b in b"$#" for b in data) / len(data), "newlines": data.count(10) / m, "spaces": data.count(32) / len(data), "non_ascii": sum(b > 127 for b in data) / len(data),
            "bare_symbols": sum(w in ("$", "#") for w in words) / m, "symbol_end": sum(w[-1] in "$#" for w in words) / m, "distinct_lines": len(set(lines)) / len(lines), "line_words": len(words) / len(lines),
            "long_words": sum(len(w) > 12 for w in words) / m, "top_byte": max(data.count(b) for b in set(data)) / len(data), "upper_words": sum(w.isupper() for w in words) / m,
        }
        assert got == pytest.approx(want)


def test_histogram_trees_equal_a_plain_way():
    """Every split of the first tree is the best one of all features and cuts, found by trying each on the rows themselves."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 2] > 8) ^ (rng.random(300) < 0.1)).astype(float)
    trees = quality.grow(x, y, rounds=1, depth=3)
    share = (y.sum() + 0.5) / (len(y) + 1)
    grad, hess = share - y, np.full(len(y), share * (1 - share))
    gain = lambda rows: grad[rows].sum() ** 2 / (hess[rows].sum() + 1.0)

    def best(rows):
        return max(gain(rows & (x[:, f] <= c)) + gain(rows & (x[:, f] > c)) - gain(rows) for f in range(4) for c in np.unique(x[:, f]))

    at, rows = {0: np.ones(300, bool)}, None
    for node in range(7):
        rows, f, c = at[node], trees.feature[0, node], trees.threshold[0, node]
        left, right = rows & (x[:, f] <= c), rows & (x[:, f] > c)
        assert gain(left) + gain(right) - gain(rows) == pytest.approx(best(rows))
        at[2 * node + 1], at[2 * node + 2] = left, right
    for leaf in range(8):
        rows = at[7 + leaf]
        assert trees.value[0, leaf] == pytest.approx(-0.15 * grad[rows].sum() / (hess[rows].sum() + 1.0))


def test_one_row_of_a_repeated_id_is_learned_from(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "$$$")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.fit(docs, labels).base == pytest.approx(0.0)


def test_narrow_margins_are_rejected():
    model = langid.Model({"a": b" one two three " * 20, "b": b" one two three " * 20})
    assert model.predict("one two three") == ("a", 0.5, 0.0, True)


def labelled(n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w + "$$$" for w in words), int(good)))
    return rows


def test_quality_of_held_out_texts(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 4 != 2] + [(9999, 1), (None, 0)], "doc_id long, quality int")
    trees = quality.fit(docs, labels)
    found = {r["doc_id"]: r for r in quality.score(docs, trees).collect()}
    assert np.mean([found[i]["predicted"] == q for i, _, q in rows if i % 4 == 2]) > 0.97
    kept = quality.keep_good(docs, trees)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["predicted"]}


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "word " * 50_000), (None, "text")], "doc_id long, text string")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    one = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert all(r["score"] > 0.5 for r in quality.score(docs, one).collect()) and quality.score(docs, one).count() == 5
    assert quality.score(docs.limit(0), one).count() == 0


def test_flat_trees_follow_their_splits():
    x = np.array([[0.0, 5.0], [1.0, 5.0], [2.0, 5.0], [3.0, 5.0]] * 30)
    y = (x[:, 0] > 1.5).astype(float)
    trees = quality.grow(x, y, rounds=20, depth=2)
    assert ((trees.score(x) > 0.5) == y).all()

    def slow(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert trees.score(x)[:4] == pytest.approx([slow(r) for r in x[:4]])
