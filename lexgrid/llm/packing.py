"""Best-fit packing by sums of squares.

A document becomes its ids and a closing id 0, cut into pieces of at most `capacity` ids of which only the first may
be shorter. A piece goes into the open sequence, or a new one, after which the sum over all residual gaps of the
squared number of open sequences with that gap is smallest. Pieces come longest first, so that the short ones
fill the gaps. A string that the tokenizer file adds to its vocabulary is one id, wherever it stands in a text.

Pieces are dealt evenly over shards of about `shard_rows` by a hash of document and place; each shard is packed by
itself, and its few open sequences are what a larger number of shards costs. Only lengths are shuffled.

Edge cases: a null text is empty and gives one piece of one id. Repeated rows are packed as often as they stand.
Other columns are ignored. An empty table gives no piece.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm import bpe
from lexgrid.runtime import map_rows, materialise

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
SHARD_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Unsafe(Exception):
    """Two blanks meet, so a blank is no sure boundary."""


class WordIds(dict):
    """A run of other characters after one blank, to the ids of blank and run; keeps a bounded number of them."""

    def __init__(self, path: str, most: int = 120_000) -> None:
        self.encode, self.most = bpe.core(path)._core_bpe.encode_ordinary, most

    def __missing__(self, run: str) -> bytes:
        if not run or run[0].isspace() or run[-1].isspace():
            raise Unsafe
        ids = np.array(self.encode(" " + run), "<u4").tobytes()
        if len(self) < self.most and len(run) <= 48:
            self[run] = ids
        return ids


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@lru_cache(maxsize=4)
def added_ids(path: str) -> dict[str, int]:
    """Strings that a tokenizer file adds to its vocabulary, to their ids."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that depend on their surroundings")
    return {t["content"]: t["id"] for t in added}


@lru_cache(maxsize=4)
def added_pattern(path: str) -> re.Pattern:
    """The added strings, longer ones first, as a group; a pattern that never matches if there are none."""
    return re.compile("(" + "|".join(map(re.escape, sorted(added_ids(path), key=len, reverse=True))) + ")" if added_ids(path) else "((?!))")


def document_ids(text: str, path: str = bpe.RANKS, tokenizer: str = TOKENIZER) -> bytes:
    """Ids of a text. Added strings are cut out first, and what lies between them is encoded alone."""
    parts = added_pattern(tokenizer).split(text)
    if len(parts) == 1:
        return ordinary_ids(text, path)
    added = added_ids(tokenizer)
    return b"".join(np.array([added[t]], "<u4").tobytes() if i % 2 else ordinary_ids(t, path) for i, t in enumerate(parts))


def ordinary_ids(text: str, path: str = bpe.RANKS) -> bytes:
    """Ids of a text without added strings. A pre-token never crosses a single blank between two other characters, so runs are encoded alone."""
    table = word_ids(path)
    head, *rest = text.split(" ")
    if head[-1:].isspace() or not head and rest:
        rest = [""]
    try:
        return np.array(table.encode(head), "<u4").tobytes() + b"".join(map(table.__getitem__, rest))
    except Unsafe:
        return np.array(table.encode(text), "<u4").tobytes()


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str = bpe.RANKS) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""

    def run(rows):
        for doc_id, text in rows:
            ids = document_ids(text, path) + b"\0\0\0\0"
            view = memoryview(ids)
            for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                yield doc_id, k, start, length, zlib.crc32(view[4 * start : 4 * (start + length)])

    return map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, taken in the order given."""
    open_with = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        best_gap, best = capacity, 2 * int(open_with[capacity - s]) + 1 if s < capacity else 0
        there = np.flatnonzero(open_with[s:capacity])
        if len(there):
            left = open_with[there]
            left[there == 0] = -1  # a full sequence is open no more and adds no square
            change = 2 * (left - open_with[there + s]) + 2
            change[there == 0] -= -2 + 1
            k = int(change.argmin())
            if change[k] <= best:
                best_gap = int(there[k]) + s
        if best_gap == capacity:
            b, made = made, made + 1
        else:
            b = bins[best_gap].pop()
            open_with[best_gap] -= 1
        sequence[i], offset[i] = b, capacity - best_gap
        if best_gap > s:
            open_with[best_gap - s] += 1
            bins[best_gap - s].append(b)
    return sequence, offset


def pack(found: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces with sequence_id and offset. `found` is read twice: once to count it, once to pack it."""
    shards = max(1, -(-found.count() // shard_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=sequence * shards + pdf["shard"].to_numpy(), offset=offset).drop(columns="shard")

    sharded = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str = bpe.RANKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    return pack(materialise(pieces(docs, capacity, path), "pieces"), capacity, shard_rows)
