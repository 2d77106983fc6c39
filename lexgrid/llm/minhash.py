"""MinHash near-dedup with bottom-k sketches of one hash function.

A text's set is its distinct word shingles, hashed; its sketch is the k smallest hashes. Texts with equal sets form a
class and are handled once. Inverted lists of retained values bring classes together: of each sketch the rarest
values that a similar sketch must meet at least once (a prefix in the order of frequency), so that very common
shingles make no lists unless they are nearly all a text has. The smallest k values of the union of two sketches
estimate the similarity, and candidates near or above the threshold are confirmed on their full sets.

Lists are not turned into all their pairs. First each list's most central member (fewest values of its own) meets all
others. Components of the links found are formed. Only where members of one list are still in different components do
they then meet each other, in blocks: estimate first, exact check after, until their components are one. So no link
between components is missed but by the estimate. Up to `k * threshold` shingles prefixes and estimates are exact;
beyond, a pair just at the threshold shares too few retained values with a probability of 1.2e-6 at 0.8 and 2.4e-6
at 0.85, and is rejected by least_estimate with 1.4e-5 and 3.0e-5 (binomial, 64 values).

Edge cases: with fewer words than a shingle the whole sequence is the only one. A null or blank text has an empty
set, links with nothing and is kept. Rows without an id link with nothing and are kept. Repeated rows are copies of
each other; rows with one id and different texts are documents of their own under one id. groups() ignores other columns,
keep_one() keeps them. Of rows with the smallest id of a group keep_one() leaves one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.components import components
from lexgrid.llm.spans import hash_of_text, mix
from lexgrid.runtime import discard, map_batches, map_rows, materialise

K = 64
SHINGLE = 5
THRESHOLD = Fraction(8, 10)
#: Most bits of the filter that keeps other texts out of the shuffle before exact checks.
MOST_BITS = 1 << 24
#: Members of a bundle that are compared in one task, for each side.
BLOCK = 2048
_SALTS = mix((np.arange(64).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@dataclass(frozen=True)
class Scheme:
    shingle: int = SHINGLE
    threshold: Fraction = THRESHOLD
    k: int = K

    @property
    def spread(self) -> float:
        return math.sqrt(float(self.threshold) * (1 - float(self.threshold)) / self.k)

    @property
    def fewest(self) -> int:
        """Values that two full sketches at the threshold share, but for 5 deviations."""
        return max(1, math.floor(self.k * (float(self.threshold) - 5 * self.spread)))

    @property
    def least_estimate(self) -> float:
        return float(self.threshold) - 4.5 * self.spread


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    # bytes.lower() changes A-Z alone, bytes.split() cuts at blanks and the controls 9 to 13
    words = np.array(list(map(xxhash.xxh3_64_intdigest, (text or "").encode("utf-8").lower().split())), np.uint64)
    if not len(words):
        return words
    width = min(shingle, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = mix(total + words[i : i + len(total)] * _SALTS[i % 64])
    return np.unique(total)


def sketches(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, text_hash, n (size of the set), set_key (a 128-bit hash of the set), sketch (the k smallest hashes)."""

    def run(rows):
        for doc_id, text_hash, text in rows:
            found = shingles(text, scheme.shingle)
            yield doc_id, text_hash, len(found), xxhash.xxh3_128_hexdigest(found.tobytes()), found[: scheme.k].view(np.int64)

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), hash_of_text().alias("text_hash"), "text"), run, "doc_id long, text_hash long, n long, set_key string, sketch array<long>")


def estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the k smallest values of the union that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def prefixes(classes: DataFrame, scheme: Scheme) -> DataFrame:
    """node, own (values that no other class retains) and prefix (the rarest of the others that have to be met)."""
    values = classes.select("node", F.explode("sketch").alias("value"))
    # written, so that the join with it stands alone and a frequent value is split
    often = materialise(values.groupBy("value").count().filter("count > 1"), "often")
    met = values.join(often, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("met"))
    held = F.least("n", F.lit(scheme.k))
    part, whole = scheme.threshold.numerator, scheme.threshold.denominator
    exact = F.ceil(F.col("n") * part / whole)
    full = F.greatest(F.lit(1), F.floor(held * scheme.fewest / scheme.k))
    needed = F.when(F.col("n") * whole <= scheme.k * part, exact).otherwise(full)
    met = met.join(classes.select("node", "n"), "node")
    length = F.size("met") - needed + 1
    found = met.filter(length > 0).select("node", "n", (held - F.size("met")).alias("own"), F.slice(F.col("met.value"), F.lit(1), length.cast("int")).alias("prefix"))
    found = materialise(found, "prefixes")
    discard(often)
    return found


def texts_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """node and text of the classes in nodes. A Bloom filter of bounded size keeps most other texts out of the shuffle."""
    ids = materialise(nodes.distinct().join(classes.select("node", "rep", "set_key"), "node"), "wanted")
    bits = 64 * max(1, min(MOST_BITS, 10 * ids.count()) // 64)
    places = [F.pmod(F.xxhash64(F.lit(i), F.col("rep")), F.lit(bits)) for i in range(4)]
    found = ids.select(F.explode(F.array(*places)).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toArrow()
    filter_words = np.zeros(bits // 64, np.uint64)
    filter_words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)

    def sift(batches):
        for b in batches:
            at = [b.column(i).to_numpy() for i in range(2, 6)]
            hit = np.logical_and.reduce([(filter_words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1 for p in at])
            b = b.filter(pa.array(hit)).select([0, 1])
            keys = [xxhash.xxh3_128_hexdigest(shingles(t, scheme.shingle).tobytes()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), b.column(1)], ["rep", "set_key", "text"])

    likely = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), "text").select("rep", "text", *(p.alias(f"p{i}") for i, p in enumerate(places)))
    texts = map_batches(likely, sift, "rep long, set_key string, text string").join(ids, ["rep", "set_key"]).dropDuplicates(["node"]).select("node", "text")
    return materialise(texts, "texts")


def confirmed(texts: DataFrame, pairs: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (a, b of nodes) whose full sets are similar enough."""
    part, whole = scheme.threshold.numerator, scheme.threshold.denominator
    both = pairs.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")

    def check(rows):
        known, mine = None, None
        for a, b, text_a, text_b in rows:
            if a != known:
                known, mine = a, shingles(text_a, scheme.shingle)
            other = shingles(text_b, scheme.shingle)
            shared = len(np.intersect1d(mine, other, assume_unique=True))
            if whole * shared >= part * (len(mine) + len(other) - shared):
                yield a, b

    return map_rows(both.select("a", "b", "text_a", "text_b"), check, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """estimate() of two sorted sketches."""
    union = np.union1d(a, b)[:k]
    return len(np.intersect1d(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True)) / len(union)


@dataclass
class Member:
    node: int
    component: int
    side: int
    n: int
    sketch: np.ndarray
    text: str

    @cached_property
    def shingles(self) -> dict[int, np.ndarray]:
        return {}

    def of(self, shingle: int) -> np.ndarray:
        if shingle not in self.shingles:
            self.shingles[shingle] = shingles(self.text, shingle)
        return self.shingles[shingle]


def crossing(members: list[Member], scheme: Scheme) -> list[tuple[int, int]]:
    """Links between members of different components and, if both sides occur, of different sides.

    Only members outside the largest component ask. Sketches first say who may be similar; full sets decide. Components
    that get a link become one, so each needs no second."""
    part, whole = scheme.threshold.numerator, scheme.threshold.denominator
    names, label = np.unique([m.component for m in members], return_inverse=True)
    if len(names) < 2:
        return []
    sizes = np.array([m.n for m in members])
    held = np.array([len(m.sketch) for m in members])
    _, flat = np.unique(np.concatenate([m.sketch for m in members]), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(held)])
    sides = np.array([m.side for m in members])
    two = sides.min() != sides.max()
    mark, out = np.zeros(flat.max() + 1, bool), []
    for q in np.flatnonzero(label != np.bincount(label).argmax()):
        others = (label != label[q]) & (np.minimum(sizes, sizes[q]) * whole >= np.maximum(sizes, sizes[q]) * part)
        if two:
            others &= sides != sides[q]
        if not others.any():
            continue
        mine = flat[begin[q] : begin[q + 1]]
        mark[mine] = True
        shared = np.add.reduceat(mark[flat].astype(np.int64), begin[:-1])
        mark[mine] = False
        # the values that both hold are at least those that the estimate counts; the smallest union has as many as the longer sketch
        others &= shared >= scheme.least_estimate * np.maximum(held, held[q])
        for x in np.flatnonzero(others):
            if label[x] != label[q] and similar(members[q].sketch, members[x].sketch, scheme.k) >= scheme.least_estimate:
                both = len(np.intersect1d(members[q].of(scheme.shingle), members[x].of(scheme.shingle), assume_unique=True))
                if whole * both >= part * (sizes[x] + sizes[q] - both):
                    out.append((members[q].node, members[x].node))
                    label[label == label[x]] = label[q]
    return out


def links(docs: DataFrame, classes: DataFrame, scheme: Scheme) -> DataFrame:
    """a, b: links between classes (nodes) that are enough to form all components."""
    part, whole = scheme.threshold.numerator, scheme.threshold.denominator
    found = prefixes(classes, scheme)
    lists = found.select("node", "own", F.explode("prefix").alias("value"))
    centre = lists.groupBy("value").agg(F.min(F.struct("own", "node")).alias("centre"), F.count("*").alias("members")).filter("members > 1").select("value", F.col("centre.node").alias("centre"), "members")
    centre = materialise(centre, "centres")
    meets = materialise(lists.join(centre, "value").filter("node <> centre").select("centre", "node", "value", "members"), "meets")
    stars = meets.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    sketch_of = classes.select("node", "n", "sketch")
    stars = stars.join(sketch_of.withColumnsRenamed({"node": "b", "n": "n_b", "sketch": "sketch_b"}), "b").join(sketch_of.withColumnsRenamed({"node": "a", "n": "n_a", "sketch": "sketch_a"}), "a")
    sizes = F.least("n_a", "n_b") * whole >= F.greatest("n_a", "n_b") * part
    likely = materialise(stars.filter(sizes & (estimate(F.col("sketch_a"), F.col("sketch_b"), scheme.k) >= scheme.least_estimate)).select("a", "b"), "likely")
    texts = texts_of(docs, classes, likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))), scheme)
    first = materialise(confirmed(texts, likely, scheme), "first-links")
    discard(found, centre, likely, texts)
    # members of one list, beside its centre, that are still apart; lists with one centre are looked at together
    placed = meets.filter("members > 2").join(components(first, "a", "b").withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialise(placed, "placed")
    apart = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("value")
    # both written, so that a list with very many members is split in the join and merged before the next shuffle
    apart = materialise(apart, "apart")
    again = materialise(placed.join(apart, "value", "left_semi").select("centre", "node", "component"), "again")
    bundles = materialise(again.distinct(), "bundles")
    discard(meets, placed, apart, again)
    if bundles.isEmpty():
        return first
    return first.unionByName(materialise(_between(docs, classes, bundles, scheme), "second-links"))


def _between(docs: DataFrame, classes: DataFrame, bundles: DataFrame, scheme: Scheme) -> DataFrame:
    """Links within bundles (centre, node, component). A large bundle is dealt over blocks, and each pair of blocks is a task of bounded size."""
    texts = texts_of(docs, classes, bundles.select("node"), scheme)
    counts = bundles.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine")
    dealt = bundles.join(counts, "centre").select("centre", "node", "component", mine, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    known = texts.join(classes.select("node", "n", "sketch"), "node")
    tiles = dealt.join(known, "node").select("centre", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "node", "component", "mine", "n", "sketch", "text")

    def settle(rows):
        key, group = None, []
        for *at, node, component, side, n, sketch, text in rows:
            if at != key:
                yield from crossing(group, scheme)
                key, group = at, []
            group.append(Member(node, component, side, n, np.array(sketch, np.int64).view(np.uint64), text))
        yield from crossing(group, scheme)

    keys = ["centre", "low", "high"]
    return map_rows(tiles.repartition(*keys).sortWithinPartitions(*keys), settle, "a long, b long")


def placed_rows(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, text_hash, n, group (null without words or id) and component_id (smallest doc_id of the group) for every row."""
    made = materialise(sketches(docs, scheme), "sketches")
    full = made.filter("n > 0 and doc_id is not null")
    classes = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("m")).select("set_key", F.col("m.doc_id").alias("rep"), F.col("m.n").alias("n"), F.col("m.sketch").alias("sketch"))
    # ids may repeat with different texts, so classes get numbers of their own; they are settled by being written
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = links(docs, classes, scheme)
    placed = materialise(components(found, "a", "b").withColumnRenamed("id", "node").join(classes.select("node", "set_key", "rep"), "node"), "placed")
    lowest = materialise(placed.groupBy("component").agg(F.min("rep").alias("component_id")), "lowest")
    linked = placed.join(lowest, "component").select("set_key", F.col("component").alias("group"), "component_id")
    known = classes.select("set_key", "rep", "node").join(linked, "set_key", "left").select("set_key", F.coalesce("group", "node").alias("group"), F.coalesce("component_id", "rep").alias("component_id"))
    # written, so that the join stands alone and a set with very many copies is split
    known = materialise(known, "known")
    rows = made.select("doc_id", "text_hash", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(known, "set_key", "left")
    return rows.select("doc_id", "text_hash", "n", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def groups(docs: DataFrame, shingle: int = SHINGLE, threshold: Fraction = THRESHOLD, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept, for every row."""
    out = placed_rows(docs, Scheme(shingle, threshold, k))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, threshold: Fraction = THRESHOLD, k: int = K) -> DataFrame:
    """The rows of docs, with their columns, less all but one of each group."""
    rows = materialise(placed_rows(docs, Scheme(shingle, threshold, k)).filter("group is not null").select("doc_id", "text_hash", "group"), "rows")
    first = rows.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    shared = materialise(rows.join(materialise(first, "first"), "group").select("doc_id", "text_hash", (F.struct("doc_id", "text_hash") == F.col("first")).alias("stays")), "shared")
    gone = shared.filter("not stays").distinct()
    twice = materialise(shared.filter("stays").groupBy("doc_id", "text_hash").count().filter("count > 1"), "twice")
    columns, key = docs.columns, [F.col("doc_id").cast("long").alias("_id"), hash_of_text().alias("_hash")]
    keyed = docs.select("*", *key)

    def among(other: DataFrame, how: str, frame: DataFrame) -> DataFrame:
        return frame.join(other.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), ["_id", "_hash"], how)

    kept = among(gone, "left_anti", keyed)
    if not twice.isEmpty():
        kept = among(twice, "left_anti", kept).unionByName(among(twice, "left_semi", kept).dropDuplicates(["_id", "_hash", "text"]))
    return kept.select(*columns)
