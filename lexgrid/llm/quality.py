"""Quality classifier: gradient-boosted trees over histograms of document statistics.

Statistics of each whole text are binned by quantiles; trees of a fixed depth are grown level by level from gradient
histograms and flattened into arrays, which numpy walks for many documents at once.

The fit reads a bounded sample of about `SAMPLE_ROWS` labelled documents.

Edge cases: a null text counts as empty; empty texts have all statistics 0 and get a score like any other. Labels
that are null, or whose document is missing, are not learned from. Without both labels every score is the share of
label 1, or 0.5 without labels. Repeated rows get repeated results; of an id that repeats one text is learned from. Other
columns are ignored by score() and kept by keep_good().
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrid.runtime import map_batches, map_rows, rows_of

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "repeated_next", "upper", "digits", "punctuation", "symbols",
    "newlines", "spaces", "non_ascii", "bare_symbols", "symbol_end", "distinct_lines", "line_words", "long_words", "top_byte", "upper_words",
)
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_POINT = np.isin(_BYTES, list(b".,;:?'\"()-"))
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~_DIGIT & ~_POINT
_ENDS = frozenset("!#$%&*+/<=>@[]^_`{|}~")


def statistics(text: str | None) -> list[float]:
    """The FEATURES of one whole text."""
    data = (text or "").encode("utf-8")
    if not data:
        return [0.0] * len(FEATURES)
    n = len(data)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    lines = text.split("\n")
    m = max(1, len(words))
    counts = Counter(words)
    again = sum(map(str.__eq__, words, words[1:]))
    letters = max(1, int(hist[_LETTER].sum()))
    lasts = [w[-1] for w in words]
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(map(len, words)) / m, len(counts) / m, max(counts.values(), default=0) / m, again / m,
        hist[_UPPER].sum() / letters, hist[_DIGIT].sum() / n, hist[_POINT].sum() / n, hist[_SYMBOL].sum() / n,
        hist[10] / m, hist[32] / n, hist[128:].sum() / n, sum(counts[c] for c in _ENDS) / m, sum(map(_ENDS.__contains__, lasts)) / m,
        len(set(lines)) / len(lines), len(words) / len(lines), sum(k for w, k in counts.items() if len(w) > 12) / m, hist.max() / n, sum(map(str.isupper, words)) / m,
    ]


class Trees:
    """Trees of one depth in arrays: node i has the children 2i+1 and 2i+2; a row goes right where its feature is above the threshold."""

    def __init__(self, base: float, depth: int, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> None:
        self.base, self.depth, self.feature, self.threshold, self.value = base, depth, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Fit trees to the rows of x with labels y (0 or 1)."""
    nodes, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    feature, threshold, value = np.zeros((rounds, nodes), np.int64), np.full((rounds, nodes), np.inf), np.zeros((rounds, leaves))
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, depth, feature[:0], threshold[:0], value[:0])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    total = np.full(len(y), base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grad, hess, at = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                key = local * bins + codes[:, f]
                g = np.bincount(key, grad, width * bins).reshape(width, bins).cumsum(1)
                h = np.bincount(key, hess, width * bins).reshape(width, bins).cumsum(1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                gain = gain[:, : len(cut)]
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best[better] = gain[np.arange(width), k][better]
                feature[t, first : first + width][better] = f
                threshold[t, first : first + width][better] = cut[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[t, at]] > threshold[t, at])
        leaf = at - nodes
        value[t] = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + ridge)
        total += value[t, leaf]
    return Trees(base, depth, feature, threshold, value)


def features(docs: DataFrame, *others: str) -> DataFrame:
    """x, the statistics of each text, and the other columns asked for."""

    def run(rows):
        for text, *rest in rows:
            yield statistics(text), *rest

    docs = docs.select("text", *others)
    return map_rows(docs, run, T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), *docs.schema.fields[1:]]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from docs (doc_id, text) and labels (doc_id, quality). About sample_rows labels are drawn by a hash of the id; those are broadcast."""
    labels = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    n = labels.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    drawn = labels.filter(place < min(1.0, sample_rows / max(1, n)))
    # one text of an id that repeats, so that no more rows come to the driver than labels were drawn
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    learned = features(texts, "y", "doc_id").groupBy("doc_id").agg(F.max(F.struct("x", "y")).alias("m")).select("m.x", "m.y").toPandas()
    if n == 0 or learned.empty:
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0))
    order = np.lexsort(np.array([*learned["x"]]).T[::-1])  # the same trees however the rows arrive
    return grow(np.array([*learned["x"]])[order], learned["y"].to_numpy(float)[order])


def _scored(batches, trees: Trees, text_at: int):
    """(batch, scores) for each batch; the statistics of a batch are one matrix."""
    for b in batches:
        x = np.array([statistics(t[0]) for t in rows_of([b.select([text_at])])], float).reshape(-1, len(FEATURES))
        yield b, trees.score(x)


def score(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row."""

    def run(batches):
        for b, s in _scored(batches, trees, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, that score at least the threshold."""
    at = docs.columns.index("text")

    def run(batches):
        for b, s in _scored(batches, trees, at):
            yield b.filter(pa.array(s >= threshold))

    return map_batches(docs, run, docs.schema)
