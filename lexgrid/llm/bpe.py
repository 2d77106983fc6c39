"""Byte-level BPE encoding and decoding over overlapping chunks.

A text is cut into chunks that overlap. Each chunk is split into pre-tokens on its own; two neighbours are joined
at the first boundary that both found. The pre-token pattern looks only forward, so from a common boundary on both
splits are the split of the whole text. Pieces are then encoded by merge ranks; decoding concatenates raw bytes.

Edge cases: a null text counts as empty and has no ids. Repeated rows give repeated results. Columns other than
the id and the text are ignored. A text whose chunks share no boundary is split on from the last sure one.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.runtime import map_rows, ship

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHUNK_CHARS = 32768
OVERLAP_CHARS = 256
#: A match looks at most so far behind its start before it settles on an alternative ('ll, 've, 're).
LOOK = 3


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def core(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


class PieceIds(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers; keeps a bounded number of short pieces."""

    def __init__(self, path: str, most: int = 120_000) -> None:
        self.encode, self.most = core(path)._core_bpe.encode_single_piece, most

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(piece.encode("utf-8")), "<u4").tobytes()
        if len(self) < self.most and len(piece) <= 48:
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


@lru_cache(maxsize=4)
def id_bytes(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def chunk_starts(n: int, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Each chunk holds `chunk` characters and starts `overlap` before the end of the one before it."""
    return [0] if n <= chunk else list(range(0, n - overlap, chunk - overlap))


def boundaries(chunk: str, start: int) -> np.ndarray:
    """Starts of the pre-tokens of one chunk, and its end, as places in the text."""
    return np.fromiter(accumulate(map(len, pattern().findall(chunk)), initial=start), np.int64)


def stitch(text: str, found: list[np.ndarray]) -> np.ndarray:
    """Pre-token boundaries of the whole text from those of its overlapping chunks."""
    cuts, n = found[0], len(text)
    parts: list[np.ndarray] = []
    for nxt in found[1:]:
        end = cuts[-1]
        # the last pre-tokens of a chunk may have been cut short
        sure = cuts[:-1][(cuts[:-1] + LOOK <= end)]
        common = sure[np.isin(sure, nxt, assume_unique=True)]
        if len(common):
            meet = common[0]
            parts.append(cuts[: np.searchsorted(cuts, meet)])
            cuts = nxt[np.searchsorted(nxt, meet) :]
            continue
        at = int(sure[-1]) if len(sure) else int(cuts[0])
        parts.append(cuts[: np.searchsorted(cuts, at)])
        known, walked = set(nxt[:-1].tolist()), [at]
        while at < n and at not in known:
            at = pattern().match(text, at).end()
            walked.append(at)
        rest = nxt[np.searchsorted(nxt, at) :] if at in known else np.zeros(0, np.int64)
        parts.append(np.array(walked[:-1], np.int64))
        cuts = rest if len(rest) else np.array([at], np.int64)
    return np.concatenate([*parts, cuts])


def encode_pieces(pieces: list[str], path: str) -> bytes:
    return b"".join(map(piece_ids(path).__getitem__, pieces))


def encode_text(text: str, path: str = RANKS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> bytes:
    """Ids of one text as little-endian unsigned 32-bit integers."""
    if len(text) <= chunk:
        return encode_pieces(pattern().findall(text), path)
    cuts = stitch(text, [boundaries(text[s : s + chunk], s) for s in chunk_starts(len(text), chunk, overlap)]).tolist()
    return encode_pieces([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], path)


def encode(docs: DataFrame, path: str = RANKS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id and text to doc_id, ids (binary, 4 bytes an id). Texts over one chunk are split across tasks."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    step = chunk - overlap

    def whole(rows):
        for doc_id, text in rows:
            yield doc_id, encode_text(text, path, chunk, overlap)

    def split(rows):
        for doc_id, digest, start, text in rows:
            yield doc_id, digest, start, text, boundaries(text, start).astype("<i8").tobytes()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        # rows that repeat a document repeat each of its chunks
        copies = int((pdf["start"] == 0).sum())
        pdf = pdf.drop_duplicates("start").sort_values("start")
        text = "".join(t[: step if i < len(pdf) - 1 else None] for i, t in enumerate(pdf["text"]))
        cuts = stitch(text, [np.frombuffer(b, "<i8") for b in pdf["cuts"]]).tolist()
        ids = encode_pieces([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], path)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]] * copies, "ids": [ids] * copies})

    def chunked(rows):
        for doc_id, text in rows:
            digest = hashlib.sha256(text.encode("utf-8")).hexdigest()
            for s in chunk_starts(len(text), chunk, overlap):
                yield doc_id, digest, s, text[s : s + chunk]

    short = map_rows(docs.filter(F.length("text") <= chunk), whole, "doc_id long, ids binary")
    chunks = map_rows(docs.filter(F.length("text") > chunk), chunked, "doc_id long, digest string, start long, text string").repartition("doc_id", "digest", "start")
    cut = map_rows(chunks, split, "doc_id long, digest string, start long, text string, cuts binary")
    # a null doc_id is a key of its own, so such rows are joined by their text
    long = cut.groupBy("doc_id", "digest").applyInPandas(join, "doc_id long, ids binary")
    return short.unionByName(long)


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id and ids to doc_id, ids, bytes (the raw bytes of all ids, one after another)."""

    def run(rows):
        table = id_bytes(path)
        for doc_id, ids in rows:
            yield doc_id, ids, b"".join(map(table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, bytes binary")
