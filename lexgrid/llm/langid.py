"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of its texts. A text is compressed in blocks with the
dictionary of every language; the smallest total wins. Letters are folded to lower case first. A narrow margin between
the two smallest totals is a rejection.

The fit reads a bounded sample of labelled rows: whole texts, in an order drawn by a hash, up to `dict_bytes` a
language. A text that would exceed the bound is left out of the sample; where no text of a language fits, its shortest
one is the dictionary. Prediction covers whole texts, by the same way for every length.

Edge cases: a text that is null or has no letter gets `und`, score 0, and is rejected. Rows without a language are
no training rows. A language whose sample holds fewer than 8 bytes (zstandard takes no smaller dictionary) is never
predicted. With nothing to learn from, every text gets `und`. With one language a margin is 1. Repeated rows get
repeated results; predict() ignores other columns, keep_identified() keeps them.
"""

from __future__ import annotations

import math

import regex
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.runtime import map_rows

#: Rows of each language whose lengths the fit looks at, and bytes of whole texts that it learns from.
SAMPLE_DOCS = 1000
DICT_BYTES = 112 * 1024
BLOCK_BYTES = 1024
LEAST_BYTES = 8
#: A rejection: the second smallest total is not larger than the smallest by this share of it.
NARROW = 0.002
LEVEL = 6
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Language to dictionary, from the columns doc_id, text, lang. To the driver come the lengths of about sample_docs texts a language, then the texts chosen."""
    rows = labelled.filter("text is not null and lang is not null and length(text) > 0").select("doc_id", "text", "lang")
    # a place that depends on the row alone; 60 bits tell the rows apart
    rows = rows.withColumn("place", F.shiftright(F.xxhash64("doc_id", "text"), 4)).withColumn("size", F.octet_length("text"))
    seen = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.struct("size", "place")).alias("shortest")).collect()
    counts = {r["lang"]: r["n"] for r in seen}
    if not counts:
        return {}
    rates = [F.when(F.col("lang") == k, F.lit(min(1.0, sample_docs / n))) for k, n in counts.items()]
    drawn = rows.filter(F.pmod("place", F.lit(1_000_003)) / 1_000_003 < F.coalesce(*rates))
    lengths: dict[str, list[tuple[int, int]]] = {lang: [] for lang in counts}
    for r in drawn.select("lang", "place", "size").distinct().collect():
        lengths[r["lang"]].append((r["place"], r["size"]))
    for r in seen:
        if not any(size <= dict_bytes for _, size in lengths[r["lang"]]):
            lengths[r["lang"]] = [(r["shortest"]["place"], 0)]
    chosen: dict[str, list[int]] = {}
    for lang, found in lengths.items():
        left = dict_bytes
        for place, size in sorted(found):
            if size <= left:
                chosen.setdefault(lang, []).append(place)
                left -= size + 2
    wanted = F.col("place").isin([p for ps in chosen.values() for p in ps])
    texts = {(r["lang"], r["place"]): r["text"] for r in rows.filter(wanted).select("lang", "place", "text").distinct().collect()}
    dicts = {lang: b"".join(Model.folded(texts[lang, p]) for p in ps) for lang, ps in chosen.items()}
    # the most frequent language first: it wins ties
    return {lang: dicts[lang] for lang in sorted(dicts, key=lambda x: (-counts[x], x)) if len(dicts[lang]) >= LEAST_BYTES}


class Model:
    """A compressor for every language; made once in a task."""

    def __init__(self, dicts: dict[str, bytes], level: int = LEVEL) -> None:
        self.langs = list(dicts)
        self.compress = []
        for x in self.langs:
            d = zstd.ZstdCompressionDict(dicts[x], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level)
            self.compress.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    @staticmethod
    def folded(text: str) -> bytes:
        """Lower case between blanks, as words stand in the dictionaries."""
        return f" {text.lower()} ".encode()

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c(b)) for b in blocks) for c in self.compress]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score from 0 to 1, margin, rejected)."""
        if not self.langs or text is None or not LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0, True
        sizes = self.sizes(self.folded(text))
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / sizes[order[1]] if len(order) > 1 else 1.0
        score = 1 / sum(math.exp(max(-60.0, best - s)) for s in sizes)
        return self.langs[order[0]], score, margin, margin < NARROW


def predict(docs: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for every row."""

    def run(rows):
        model = Model(dicts)
        for doc_id, text in rows:
            yield doc_id, *model.predict(text)

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def keep_identified(docs: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """The rows of docs, with their columns, whose language is clear."""
    columns = docs.columns
    at = columns.index("text")

    def run(rows):
        model = Model(dicts)
        for row in rows:
            if not model.predict(row[at])[3]:
                yield row

    return map_rows(docs, run, docs.schema)
