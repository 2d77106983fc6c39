"""Repeated windows of a corpus, exactly: what the suffix-array and the substring operators share.

A text is a sequence of units (bytes or words). Every window of `length` units selects the smallest hash among its
grams of `gram` units as its anchor; equal windows select the same anchor at the same place. Consecutive windows
with one anchor are a run. So a window that repeats lies in a run whose anchor repeats, and runs with an anchor of
their own drop out after one aggregation.

Runs with one anchor fall into classes of equal content, told apart by 128 bits of hash. All of a class that stands
twice repeats, and one run of each class stands for it in the anchor's group, where the operator finds the maximal
matches between classes around the anchor.

A group holds at most `most_group` runs. The runs of an anchor that has more get longer anchors: the places that an
anchor can have in a window are cut into intervals, and what all windows of an interval share around the anchor is the
interval's longer anchor. So runs become shorter, their contents fewer and their groups smaller; where an interval is a
single place, the longer anchor is the whole window and its runs are one class. This ends after a few levels, whatever
the data, and loses no window.

A document's runs of one class are one row with a count, and what repeats within a document is settled there. Rows
with one id and different texts are kept apart by a 64-bit hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.runtime import discard, map_batches, map_rows, materialise, rows_of

SEGMENT = 1 << 20
#: Runs that are sorted or extended together.
MOST_GROUP = 1024
#: Intervals into which one level cuts the places of an anchor.
FAN = 8
#: Two odd multipliers, for two hashes that are independent of each other.
_R = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_R_INVERSE = tuple(np.uint64(pow(int(r), -1, 1 << 64)) for r in _R)
_SALT = np.uint64(0xA0761D6478BD642F)
_PLACE = np.uint64(SEGMENT * 2 - 1)
#: Most bits of the filter that keeps texts without open runs out of a shuffle.
MOST_BITS = 1 << 24


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: list[np.ndarray] = []


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 12, 2 * len(_POWERS[0]) if _POWERS else 0)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, r, np.uint64))]) for r in (*_R, *_R_INVERSE)]
    return _POWERS[which][:n], _POWERS[2 + which][:n]


class Hashes:
    """Hashes of any range of units in constant time."""

    def __init__(self, units: np.ndarray, which: int = 0) -> None:
        up, self.down = powers(len(units) + 1, which)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mix(units ^ _SALT) if which else units) * up[: len(units)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive keys."""
    n = len(keys)
    padded = np.concatenate([keys, np.full(-n % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


@dataclass(frozen=True)
class Scheme:
    """units: a text's units as 64-bit numbers; content: the bytes of some units (size bytes each)."""

    length: int
    gram: int
    size: int
    units: Callable[[str], np.ndarray]
    content: Callable[[str, np.ndarray, int], bytes]


@dataclass
class Runs:
    """Runs as columns: anchor, two class hashes, first and last window, place of the anchor in the first window, whether a range is wanted."""

    anchor: np.ndarray
    high: np.ndarray
    low: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    needs: np.ndarray

    def __len__(self) -> int:
        return len(self.anchor)

    @classmethod
    def together(cls, parts: list[Runs]) -> Runs:
        return cls(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(cls)))


def classes_of(hashes: list[Hashes], first: np.ndarray, last: np.ndarray, place: np.ndarray, length: int) -> list[np.ndarray]:
    """Two hashes of the contents of runs and of the place of the anchor in them."""
    shape = mix((place * SEGMENT + (last - first)).astype(np.uint64) + np.uint64(1))
    return [mix(h.of(first, last + length) ^ shape) for h in hashes]


def runs(units: np.ndarray, scheme: Scheme) -> Iterator[Runs]:
    """All runs, segment by segment."""
    n, length, gram = len(units), scheme.length, scheme.gram
    for begin in range(0, n - length + 1, SEGMENT):
        part = units[begin : begin + SEGMENT + length - 1]
        at = np.arange(len(part) - gram + 1)
        hashes = [Hashes(part, 0), Hashes(part, 1)]
        grams = hashes[0].of(at, at + gram)
        # the left one of equal hashes
        keys = (grams & ~_PLACE) | at.astype(np.uint64)
        chosen = (window_minima(keys, length - gram + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.concatenate([first[1:], [len(chosen)]]) - 1
        place = chosen[first] - first
        yield Runs(grams[chosen[first]], *classes_of(hashes, first, last, place, length), first + begin, last + begin, place, np.ones(len(first), bool))


def levels(scheme: Scheme) -> list[int]:
    """Places in one interval of each level of longer anchors; at the last it is one."""
    out, width = [], scheme.length - scheme.gram + 1
    while width > 1:
        width = -(-width // FAN)
        out.append(width)
    return out


def longer(units: np.ndarray, open_runs: Iterable[dict], width: int, scheme: Scheme) -> Iterator[Runs]:
    """The runs of longer anchors that runs (first, last, place, needs) fall into: those of each interval of `width` places."""
    length = scheme.length
    for r in open_runs:
        begin, end = r["first"], r["last"] + length
        part, anchor, least = units[begin:end], r["place"], r["place"] - (r["last"] - r["first"])
        # places fall from window to window
        low = np.arange(least // width, anchor // width + 1) * width
        high = np.minimum(low + width - 1, length - scheme.gram)
        first, last = anchor - np.minimum(high, anchor), anchor - np.maximum(low, least)
        hashes = [Hashes(part, 0), Hashes(part, 1)]
        # what every window with a place in the interval holds
        core = hashes[0].of(anchor - low, anchor + length - high)
        place = anchor - first
        classes = classes_of(hashes, first, last, place, length)
        yield Runs(mix(core ^ mix(low.astype(np.uint64) + np.uint64(1))), *classes, first + begin, last + begin, place, np.full(len(low), r["needs"]))


RUN = "doc_id long, text_hash long, anchor long, high long, low long, first int, last int, place int, times int, needs boolean"
_RUN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("anchor", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("place", pa.int32()), ("times", pa.int32()), ("needs", pa.bool_())])


def hash_of_text() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), hash_of_text().alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))


def collapsed(doc: np.ndarray, found: Runs, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows that stand for a document's runs of one class, how often each stands there, documents and ranges that repeat within one)."""
    order = np.lexsort((found.first, found.low, found.high, found.anchor, doc))
    same = np.ones(len(order), bool)
    for column in (doc, found.anchor, found.high, found.low):
        x = column[order]
        same[1:] &= x[1:] == x[:-1]
    same[0] = False
    lead = np.flatnonzero(~same)
    times = np.diff(np.concatenate([lead, [len(order)]]))
    again = order[np.repeat(times > 1, times)]
    again = again[found.needs[again]]
    again = again[np.lexsort((found.first[again], doc[again]))]
    base = doc[again].astype(np.int64) << 33
    begin, end = base + found.first[again], np.maximum.accumulate(base + found.last[again] + length)
    new = np.ones(len(again), bool)
    new[1:] = begin[1:] > end[:-1]
    close = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(again) - 1]]) if len(again) else np.zeros(0, np.int64)
    return order[lead], times, doc[again][new], np.stack([begin[new] - base[new], end[close] - base[close]], 1) if len(again) else np.zeros((0, 2), np.int64)


def _batch(ids: list, hashes: list[int], doc: np.ndarray, found: Runs, length: int) -> pa.RecordBatch:
    """Runs as rows; a range that repeats within a document is a row with times 0 and its begin and end."""
    rows, times, local, spans = collapsed(doc, found, length)
    at = np.concatenate([doc[rows], local])
    none = np.zeros(len(local), np.int64)
    column = lambda x, y=none: np.concatenate([x[rows], y])
    absent = np.array([i is None for i in ids], bool)[at]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.array([i or 0 for i in ids], np.int64)[at], mask=absent), pa.array(np.array(hashes, np.int64)[at]),
            *(pa.array(column(x.view(np.int64))) for x in (found.anchor, found.high, found.low)),
            pa.array(column(found.first, spans[:, 0]).astype(np.int32)), pa.array(column(found.last, spans[:, 1]).astype(np.int32)), pa.array(column(found.place).astype(np.int32)),
            pa.array(np.concatenate([times, none]).astype(np.int32)), pa.array(np.concatenate([found.needs[rows] & (times == 1), none.astype(bool)])),
        ], schema=_RUN_SCHEMA,
    )


def _rows_of_runs(texts: DataFrame, cut: Callable[..., Iterator[Runs]], length: int) -> DataFrame:
    """Rows of RUN from doc_id, text_hash, text and what else `cut` takes of a row."""

    def run(batches):
        ids, hashes, docs, held, n = [], [], [], [], 0
        for doc_id, text_hash, *row in rows_of(batches):
            for part in cut(*row):
                docs.append(np.full(len(part), len(ids)))
                held.append(part)
                n += len(part)
                if n > 32_768:
                    yield _batch([*ids, doc_id], [*hashes, text_hash], np.concatenate(docs), Runs.together(held), length)
                    ids, hashes, docs, held, n = [], [], [], [], 0
            if held:
                ids.append(doc_id)
                hashes.append(text_hash)
        if held:
            yield _batch(ids, hashes, np.concatenate(docs), Runs.together(held), length)

    return map_batches(texts, run, RUN)


def all_runs(docs: DataFrame, scheme: Scheme) -> DataFrame:
    return _rows_of_runs(_keyed(docs), lambda text: runs(scheme.units(text), scheme), scheme.length)


def _filtered(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of docs that may have their key in keep: a Bloom filter of bounded size, so that a join after it shuffles few others."""
    n = keep.count()
    bits = 64 * max(1, min(MOST_BITS, 10 * n) // 64)
    hashes = [F.pmod(F.xxhash64(F.lit(i), "doc_id", "text_hash"), F.lit(bits)) for i in range(4)]
    found = keep.select(F.explode(F.array(*hashes)).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    words = np.zeros(bits // 64, np.uint64)
    table = found.toArrow()
    words[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)

    def run(batches):
        for b in batches:
            at = [b.column(i).to_numpy() for i in range(3, 7)]
            hit = np.logical_and.reduce([(words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1 for p in at])
            yield b.filter(pa.array(hit)).select([0, 1, 2])

    return map_batches(docs.select("doc_id", "text_hash", "text", *(h.alias(f"p{i}") for i, h in enumerate(hashes))), run, "doc_id long, text_hash long, text string")


def _same_document(a: DataFrame, b: DataFrame) -> F.Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def _open_runs(leads: DataFrame) -> DataFrame:
    """The open runs of each text that has one; rows that repeat have the same runs, which a set holds once."""
    return materialise(leads.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("anchor", "first", "last", "place", "needs")).alias("open")), "open")


def _open_texts(docs: DataFrame, by_doc: DataFrame) -> DataFrame:
    """doc_id, text_hash, text and the open runs of each text that has one."""
    texts = _filtered(_keyed(docs), by_doc.select("doc_id", "text_hash")).distinct()
    return texts.join(by_doc, _same_document(texts, by_doc)).select(texts["doc_id"], texts["text_hash"], "text", "open")


def _gathered(docs: DataFrame, by_doc: DataFrame, scheme: Scheme, matches: Callable) -> DataFrame:
    """Ranges of repeated units around shared anchors, from groups of class members."""

    def emit(rows):
        for doc_id, text_hash, text, found in rows:
            units = scheme.units(text)
            for r in found:
                yield r["anchor"], doc_id, text_hash, r["first"], r["place"], r["needs"], scheme.content(text, units[r["first"] : r["last"] + scheme.length], r["first"])

    def settle(rows):
        anchor, group = None, []
        for r in rows:
            if r[0] != anchor:
                yield from resolve(group)
                anchor, group = r[0], []
            group.append(r[1:])
        yield from resolve(group)

    def resolve(group):
        if len(group) > 1 and any(g[4] for g in group):
            for i, begin, end in matches([g[5] for g in group], [g[3] for g in group], scheme):
                doc_id, text_hash, first, _, needs, _ = group[i]
                if needs:
                    yield doc_id, text_hash, first + begin, first + end

    spans = map_rows(_open_texts(docs, by_doc), emit, "anchor long, doc_id long, text_hash long, first int, place int, needs boolean, content binary")
    return map_rows(spans.repartition("anchor").sortWithinPartitions("anchor"), settle, "doc_id long, text_hash long, begin int, end int")


def _longer(docs: DataFrame, by_doc: DataFrame, width: int, scheme: Scheme) -> DataFrame:
    """The runs of longer anchors that open runs fall into."""
    return _rows_of_runs(_open_texts(docs, by_doc), lambda text, found: longer(scheme.units(text), found, width, scheme), scheme.length)


def repeated_ranges(docs: DataFrame, scheme: Scheme, matches: Callable, most_group: int = MOST_GROUP) -> DataFrame:
    """doc_id, text_hash and ranges (begin, end in units) that windows which repeat anywhere cover; may overlap.

    matches(contents, places of the anchor, scheme) yields (member, begin, end) of the maximal matches between members."""
    found, ranges = materialise(all_runs(docs, scheme), "runs"), []
    for width in [*levels(scheme), 0]:
        # each result is written, so that a join stands alone and an anchor or class with very many rows is split
        rows = found.filter("times > 0")
        often = materialise(rows.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor"), "often")
        hits = materialise(rows.join(often, "anchor").withColumn("row", F.xxhash64("doc_id", "text_hash", "first")), "hits")
        local = materialise(found.filter("times = 0").select("doc_id", "text_hash", F.col("first").alias("begin"), F.col("last").alias("end")), "local")
        discard(found, often)
        key = ["anchor", "high", "low"]
        classes = materialise(hits.groupBy(*key).agg(F.sum("times").alias("copies"), F.min("row").alias("lead"), F.bool_or("needs").alias("asks")), "classes")
        marks = hits.join(classes, key).filter("needs and copies > 1 or row = lead").withColumns({"leads": F.col("row") == F.col("lead"), "open": F.col("needs") & (F.col("copies") == 1)})
        marks = materialise(marks.select("doc_id", "text_hash", "anchor", "first", "last", "place", "needs", "copies", "leads", "open"), "marks")
        groups = materialise(classes.groupBy("anchor").agg(F.count("*").alias("members"), F.count_if(F.col("asks") & (F.col("copies") == 1)).alias("open")).filter("members > 1 and open > 0").select("anchor", "members"), "groups")
        whole = materialise(marks.filter("needs and copies > 1").select("doc_id", "text_hash", F.col("first").alias("begin"), (F.col("last") + scheme.length).cast("int").alias("end")), "whole")
        leads = materialise(marks.filter("leads").select("doc_id", "text_hash", "anchor", "first", "last", "place", F.col("open").alias("needs")).join(groups, "anchor"), "leads")
        discard(hits, classes, marks, groups)
        few, many = _open_runs(leads.filter(F.col("members") <= most_group)), _open_runs(leads.filter(F.col("members") > most_group))
        ranges += [local, whole, materialise(_gathered(docs, few, scheme, matches), "matches")]
        discard(leads, few)
        if not width or many.isEmpty():
            break
        found = materialise(_longer(docs, many, width, scheme), "longer")
        discard(many)
    return reduce(DataFrame.unionByName, ranges)


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every row of docs with its own columns and `ranges`, null where it has none."""
    keyed = docs.select(*(F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)), F.col("doc_id").cast("long").alias("doc_id"), hash_of_text().alias("text_hash"))
    # one long per range: begin in the upper half
    packed = F.shiftleft(F.col("begin").cast("long"), 32).bitwiseOR(F.col("end").cast("long"))
    by_doc = ranges.groupBy("doc_id", "text_hash").agg(F.collect_set(packed).alias("ranges"))
    return keyed.join(by_doc, _same_document(keyed, by_doc), "left").select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)), "ranges")


def merged(ranges: list[int] | None) -> list[tuple[int, int]]:
    """Disjoint ranges in order; ranges that touch become one."""
    out: list[list[int]] = []
    for r in sorted(ranges or ()):
        begin, end = r >> 32, r & 0xFFFFFFFF
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def both_ways(order: list[int], shared: list[int], left: list[bytes], places: list[int], scheme: Scheme) -> Iterator[tuple[int, int, int]]:
    """Maximal matches of at least scheme.length units around the anchor, for each member.

    order: the members by what follows the anchor's start; shared: units that neighbours in it have in common;
    left: what stands before the anchor, backwards. Members are split by their left sides step by step; in each set a
    member's best partner to the right is a neighbour, so no pairs are made."""
    size, least = scheme.size, scheme.length
    todo = [(order, shared, 0)]
    while todo:
        members, right, depth = todo.pop()
        if max(right) + max(places[m] for m in members) < least:
            continue
        one = left[members[0]]
        depth = min(common(one[depth * size :], left[m][depth * size :]) // size + depth for m in members[1:])
        for k, m in enumerate(members):
            best = max(right[k - 1] if k else 0, right[k] if k < len(right) else 0)
            if depth + best >= least:
                yield m, places[m] - depth, places[m] + best
        if len(members) == 2:
            continue
        sets: dict[bytes, tuple[list[int], list[int]]] = {}
        bounds: dict[bytes, int] = {}
        for k, m in enumerate(members):
            if k:
                for c in bounds:
                    bounds[c] = min(bounds[c], right[k - 1])
            unit = left[m][depth * size : (depth + 1) * size]
            if unit:
                if unit in sets:
                    sets[unit][1].append(bounds[unit])
                    sets[unit][0].append(m)
                else:
                    sets[unit] = ([m], [])
                bounds[unit] = 1 << 30
        todo += [(ms, rs, depth) for ms, rs in sets.values() if len(ms) > 1]
