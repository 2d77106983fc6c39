"""Substring dedup by seed and extend: removes every word covered by a run of 35 words that also starts anywhere else.

Documents meet at winnowed anchors of a few words (see spans). From an anchor that they share, texts are extended to
both sides as far as the words agree; matches of at least the length are kept. Texts that agree as far as the windows
around an anchor go are merged before, by a hash of 128 bits. Anchors that too many texts share are made longer.

Edge cases: words are runs of characters other than blanks and the controls 9 to 13, unchanged. A null text has no
words. Texts with fewer words lose nothing. Matches never cross documents. Repeated rows are copies of each other and
lose what they share, like any other. drop_repeats() keeps all other columns; dedup() ignores them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from lexgrid.llm import spans
from lexgrid.runtime import map_rows

LENGTH = 35
GRAM = 8


def words(text: str | None) -> list[bytes]:
    """bytes.split() cuts at exactly the blanks that words end at."""
    return (text or "").encode("utf-8").split()


def units(text: str) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words(text))), np.uint64)


def matches(contents: list[bytes], places: list[int], scheme: spans.Scheme) -> Iterator[tuple[int, int, int]]:
    size = scheme.size
    right = [c[p * size :] for c, p in zip(contents, places, strict=True)]
    left = [c[: p * size] for c, p in zip(contents, places, strict=True)]
    back = [np.frombuffer(x, np.uint64)[::-1].tobytes() for x in left]
    order = sorted(range(len(right)), key=right.__getitem__)
    shared = [spans.common(right[a], right[b]) // size for a, b in zip(order, order[1:], strict=False)]
    return spans.both_ways(order, shared, back, places, scheme)


def scheme(length: int = LENGTH, gram: int = GRAM) -> spans.Scheme:
    return spans.Scheme(length, gram, 8, units, lambda text, part, first: part.tobytes())


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_group: int = spans.MOST_GROUP) -> DataFrame:
    """docs with the column ranges, of words."""
    return spans.with_ranges(docs, spans.repeated_ranges(docs.select("doc_id", "text"), scheme(length, gram), matches, most_group))


def _kept(text: str | None, ranges: list[int] | None) -> tuple[int, list[tuple[int, int]], bytes]:
    found = words(text)
    cut, at, parts = spans.merged(ranges), 0, []
    for begin, end in cut:
        parts += found[at:begin]
        at = end
    return len(found), cut, b" ".join([*parts, *found[at:]])


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_group: int = spans.MOST_GROUP) -> DataFrame:
    """doc_id, n_words, removed (array of begin and end), kept (words joined by one blank) for every row."""

    def run(rows):
        for doc_id, text, ranges in rows:
            n, cut, kept = _kept(text, ranges)
            yield doc_id, n, [{"begin": a, "end": b} for a, b in cut], kept.decode("utf-8")

    return map_rows(repeats(docs.select("doc_id", "text"), length, gram, most_group), run, "doc_id long, n_words long, removed array<struct<begin: int, end: int>>, kept string")


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_group: int = spans.MOST_GROUP) -> DataFrame:
    """The rows of docs, with their columns; texts that lose words are their kept words joined by one blank, n_chars follows."""
    columns = docs.columns
    at = columns.index("text")

    def run(rows):
        for *row, ranges in rows:
            if ranges:
                row[at] = _kept(row[at], ranges)[2].decode("utf-8")
                if "n_chars" in columns:
                    row[columns.index("n_chars")] = len(row[at])
            yield tuple(row)

    return map_rows(repeats(docs, length, gram, most_group), run, docs.schema)
