"""Near-duplicate embeddings: a tiled comparison along principal components.

Unit vectors are rotated to the principal axes of the whole table, so that the leading dimensions hold most of each
product. Vectors are dealt over blocks; a pair of blocks is one task. There products are added up over leading
dimensions first; the product of the suffix norms bounds what is left, and a pair is dropped as soon as its bound is
below the threshold. The cosine of what remains is taken in double precision from the vectors themselves.

Equal vectors are compared once. Tiles return link counts and a spanning forest, never all pairs of a group.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept.
Shorter vectors count as filled with zeros. Each row is a vector, also where rows repeat: equal rows link with each
other. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.components import components, local_labels
from lexgrid.runtime import materialise, ship

THRESHOLD = 0.9
BLOCK = 8192
STRIP = 512
#: Slack of the single-precision bounds; pairs within it are decided in double precision.
SLACK = 1e-4
#: Bytes that the gathered components of some pairs may take, on either side.
CHUNK_BYTES = 64 << 20


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that neither huge nor tiny ones leave the range of doubles; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Columns: the axes, by falling share of the squared lengths. Partitions send one sum of outer products each."""

    def run(frames):
        total = np.zeros((width, width))
        for pdf in frames:
            x = unit(matrix(pdf["v"], width))
            total += x.T @ x
        yield pd.DataFrame({"at": np.arange(width * width), "s": total.ravel()})

    sums = vectors.select("v").mapInPandas(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toPandas()
    total = np.zeros(width * width)
    total[sums["at"].to_numpy()] = sums["s"].to_numpy()
    total = total.reshape(width, width)
    values, axes = np.linalg.eigh((total + total.T) / 2)
    return np.ascontiguousarray(axes[:, np.argsort(-values, kind="stable")])


def steps(width: int) -> list[int]:
    """Ends of the runs of dimensions that are added before each bound."""
    return sorted({min(width, x) for x in (8, 24)} | {width})


def linked(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float, chunk_bytes: int = CHUNK_BYTES):
    """Yields (rows of a, rows of b) with a cosine of at least the threshold. a, b: scaled vectors; ra, rb: rotated unit vectors in single precision.

    Pairs are gathered in chunks of bounded bytes, whatever the width."""
    ends = steps(ra.shape[1])
    norms = [(np.sqrt((ra[:, e:] ** 2).sum(1)), np.sqrt((rb[:, e:] ** 2).sum(1))) for e in ends]
    la, lb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))

    def chunks(n: int, width: int, size: int):
        step = max(1, chunk_bytes // max(1, width * size))
        return (slice(c, c + step) for c in range(0, n, step))

    for s in range(0, len(a), STRIP):
        part, begin, pairs = np.zeros((min(STRIP, len(a) - s), len(b)), np.float32), 0, None
        for end, (na, nb) in zip(ends, norms, strict=True):
            if pairs is None:
                part += ra[s : s + STRIP, begin:end] @ rb[:, begin:end].T
                alive = part + np.outer(na[s : s + STRIP], nb) >= threshold - SLACK
                if np.count_nonzero(alive) * 8 < alive.size or end == ends[-1]:
                    pairs = np.nonzero(alive)
                    sums = part[pairs]
            else:
                i, j = pairs
                more = [np.einsum("ij,ij->i", ra[s + i[c], begin:end], rb[j[c], begin:end]) for c in chunks(len(i), end - begin, 4)]
                sums = sums + np.concatenate([*more, np.zeros(0, np.float32)])
                alive = sums + na[s + i] * nb[j] >= threshold - SLACK
                pairs, sums = (i[alive], j[alive]), sums[alive]
            begin = end
        i, j = pairs
        for c in chunks(len(i), a.shape[1], 8):
            u, v = i[c] + s, j[c]
            cosine = np.einsum("ij,ij->i", a[u], b[v]) / (la[u] * lb[v])
            yield u[cosine >= threshold], v[cosine >= threshold]


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    ship(embeddings.sparkSession)
    good = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = materialise(embeddings.select("vec_id", F.when(good & F.col("vec_id").isNotNull(), v).alias("v")).withColumn("key", F.when(F.col("v").isNotNull(), F.format_string("%016x%016x", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))), "rows")
    classes = materialise(rows.filter("v is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks, width = max(1, -(-n // block)), max(1, width or 1)
    axes = principal_axes(classes, width)
    mine = classes.select("key", "rep", "copies", "v", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("mine"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    tiles = mine.select("*", other).select("*", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        x, copies, home = matrix(pdf["v"], width), pdf["copies"].to_numpy(), pdf["mine"].to_numpy()
        r = (unit(x) @ axes).astype(np.float32)
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        at, to = np.flatnonzero(home == low), np.flatnonzero(home == high)
        count, label = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        x = scaled(x)
        for u, v in linked(x[at], x[to], r[at], r[to], threshold):
            u, v = at[u], to[v]
            if low == high:
                u, v = u[u < v], v[u < v]
            np.add.at(count, u, copies[v])
            np.add.at(count, v, copies[u])
            label = local_labels(len(pdf), u, v, label)
        ids, some = pdf["rep"].to_numpy(), np.flatnonzero(count)
        key = pdf["key"].to_numpy()[some]
        return pd.DataFrame({"key": key, "rep": ids[some], "links": count[some], "root": ids[label[some]]})

    found = materialise(tiles.groupBy("low", "high").applyInPandas(run, "key string, rep long, links long, root long"), "tile-links")
    component = components(found, "rep", "root").select(F.col("id").alias("rep"), "component")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.select("key", "rep", "copies").join(counts, "key", "left").join(component, "rep", "left")
    known = known.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(component_id == F.col("vec_id"), F.lit(True)).alias("kept"))
