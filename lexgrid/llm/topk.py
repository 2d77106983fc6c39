"""Exact top-k search by inner product with a threshold algorithm.

Candidates are dealt over blocks, queries over rounds, and each pair of the two is one task. In a task every
dimension has a list of the candidates sorted by that component. The lists are read in step from the ends that the
signs of the queries favour; queries read in batches, so that a list is read once for many, and each new candidate is
scored in full for all queries of its batch that still read, by one matrix product. The products of a query with the
components read last bound the score of everything unread, and the query stops when that bound is below its k-th best
score. Each query meets one block first; its k-th best score there is a floor under the bound in all other blocks.

How much is left unread depends on the vectors. Where few components hold most of a product, reading stops early; with
many components of one size, as in the test tables, every candidate stands near the head of some list, so nearly all are
scored and the scores are as many as queries times candidates.

Edge cases: vectors that are null or hold null or non-finite components take no part. Shorter vectors count as
filled with zeros. Of rows that repeat a vec_id the one with the smallest vector counts. Ties go to the smaller
vec_id. Sums beyond 2^53 are added as whole numbers and held within 64 bits. Other columns are ignored. An empty
table, or one without queries, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.runtime import materialise, ship

K = 20
SCALE = 64
CANDIDATES, QUERIES = 4096, 16_384
#: Entries of each list that are read between two tests of the bound: at first, and as a share of those read.
FIRST_DEPTH, GROWTH = 8, 0.25
#: Queries that read the lists of a block together, and the room that a whole number of any size takes as a multiple of a double's.
BATCH, OBJECT_ROOM = 512, 16
#: Whole types and the bits of their largest values.
NARROW = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}
#: No floor: the smallest score there is.
LOWEST = -(2**63)


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component; rows that take no part are gone."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Lists:
    """The candidates of one block, sorted along each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.order = np.ascontiguousarray(x.argsort(axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(x.T, self.order, 1)
        self.most = int(np.abs(x.astype(float)).max(initial=0))
        self.doubles = x.astype(float)
        #: Entries of lists read and pairs of a query and a candidate scored so far.
        self.read = self.scored = 0

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Queries by rows. Weights are doubles where all sums are exact in them, else whole numbers of any size."""
        if weights.dtype == float:
            return weights @ self.doubles[rows].T
        sums = weights @ self.x[rows].astype(object).T
        return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums.ravel()], np.int64).reshape(sums.shape)

    def top(self, query_id: int, q: np.ndarray, k: int, floor: int = LOWEST) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of one query; see tops."""
        _, ids, best = self.tops(np.array([query_id]), q[None], k, np.array([floor], np.int64))
        return ids, best

    def tops(self, query_ids: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of queries, ids, scores) of the k best candidates of each query other than itself; those below its floor may be missing."""
        exact = np.abs(q.astype(float)).max(axis=1, initial=0) * self.most * q.shape[1] < 2**53
        found = [(np.zeros(0, np.int64),) * 3]
        # queries that favour the same ends come together, those of the largest components first
        order = np.lexsort((q > 0).T[np.abs(q.astype(float)).sum(axis=0).argsort()])
        for kind, number, size in ((exact, float, batch), (~exact, object, max(1, batch // OBJECT_ROOM))):
            at = order[kind[order]]
            for part in (at[s : s + size] for s in range(0, len(at), size)):
                rows, ids, best = self.together(query_ids[part], q[part].astype(number), k, floors[part])
                found.append((part[rows], ids, best))
        rows, ids, best = (np.concatenate(c) for c in zip(*found, strict=True))
        return rows, ids, best

    def together(self, query_ids: np.ndarray, weights: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """tops of one batch: what one of its queries reads is scored for all that still read, each stops at its own bound."""
        n = len(self.ids)
        above, below = np.maximum(weights, 0), np.minimum(weights, 0)
        least, active = floors.astype(np.int64), np.arange(len(weights))
        unseen, heads = np.ones(n, bool), np.full((len(weights), k), LOWEST)
        found = [(np.zeros(0, np.int64),) * 3]
        low, high = 0, min(n, FIRST_DEPTH)
        while len(active):
            up, down = (above[active] > 0).any(axis=0), (below[active] < 0).any(axis=0)
            # queries of zeros have no list to read and the same score everywhere
            fresh = np.full(n, not (up.any() or down.any()))
            fresh[self.order[up, n - high : n - low]] = True
            fresh[self.order[down, low:high]] = True
            new = np.flatnonzero(fresh & unseen)
            unseen[new] = False
            self.read += (high - low) * int(up.sum() + down.sum())
            self.scored += len(new) * len(active)
            if len(new):
                scores = self.scores(new, weights[active])
                own = np.minimum(np.searchsorted(self.ids[new], query_ids[active]), len(new) - 1)
                itself = np.flatnonzero(self.ids[new[own]] == query_ids[active])
                scores[itself, own[itself]] = LOWEST
                bare = np.flatnonzero(least[active] == LOWEST)
                if len(bare) and len(new) > k:
                    least[active[bare]] = np.partition(scores[bare], len(new) - k, axis=1)[:, len(new) - k].astype(np.int64)
                near = scores >= least[active].astype(scores.dtype)[:, None]
                near[itself, own[itself]] = False
                r, c = np.nonzero(near)
                found.append((active[r], self.ids[new[c]], scores[r, c].astype(np.int64)))
                wide = np.full((len(active), k + np.bincount(r, minlength=1).max()), LOWEST)
                wide[:, :k] = heads[active]
                wide[r, k + np.arange(len(r)) - np.searchsorted(r, r)] = found[-1][2]
                heads[active] = np.partition(wide, wide.shape[1] - k, axis=1)[:, -k:]
                least[active] = np.maximum(least[active], heads[active].min(axis=1))
            if not unseen.any():
                break
            bound = above[active] @ self.sorted[:, n - high].astype(weights.dtype) + below[active] @ self.sorted[:, high - 1].astype(weights.dtype)
            active = active[(least[active] == LOWEST) | (bound >= least[active])]
            low, high = high, min(n, high + max(FIRST_DEPTH, int(high * GROWTH)))
        rows, ids, best = (np.concatenate(c) for c in zip(*found, strict=True))
        near = np.flatnonzero(best >= least[rows])
        order = near[np.lexsort((ids[near], ~best[near], rows[near]))]
        order = order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order]) < k]
        return rows[order], ids[order], best[order]


def search(vectors: DataFrame, is_query: Column, k: int = K, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score from vec_id and v (array of long); every row is a candidate of every query but itself."""
    ship(vectors.sparkSession)
    vectors = materialise(vectors, "vectors")
    n, n_queries, width, low, high = vectors.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    # queries go to every block, so their components are dealt in the narrowest type that holds them all
    narrow = next(t for t, bits in NARROW.items() if max(high or 0, -1 - (low or 0)) < 2**bits)
    vectors = vectors.withColumn("v", F.col("v").cast(f"array<{narrow}>"))
    blocks, rounds, width = max(1, -(-n // candidates)), max(1, -(-n_queries // queries)), max(1, width or 1)

    def deal(column: str, count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(column)

    def place(seed: int, count: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(count)).cast("int")

    home = place(3, blocks)
    asked = vectors.filter(is_query).select("vec_id", "v", place(2, rounds).alias("round"), home.alias("home"))
    rows = vectors.select(F.lit(False).alias("asks"), "vec_id", "v", F.lit(LOWEST).alias("floor"), place(1, blocks).alias("block"), deal("round", rounds))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        mine, asks = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        if mine.empty or asks.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        lists, query_ids = Lists(mine["vec_id"].to_numpy(), matrix(mine["v"], width)), asks["vec_id"].to_numpy()
        rows, ids, best = lists.tops(query_ids, matrix(asks["v"], width), k, asks["floor"].to_numpy())
        return pd.DataFrame({"query_id": query_ids[rows], "vec_id": ids, "score": best})

    def meet(queries: DataFrame) -> DataFrame:
        cells = rows.unionByName(queries.select(F.lit(True).alias("asks"), "vec_id", "v", "floor", "round", "block"))
        return cells.groupBy("block", "round").applyInPandas(run, "query_id long, vec_id long, score long")

    best = meet(asked.withColumns({"floor": F.lit(LOWEST), "block": F.col("home")}))
    if blocks > 1:
        best = materialise(best, "home-scores")
        kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        others = asked.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "round", F.coalesce("floor", F.lit(LOWEST)).alias("floor"), "home", deal("block", blocks)).filter("block <> home")
        best = best.unionByName(meet(others))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
