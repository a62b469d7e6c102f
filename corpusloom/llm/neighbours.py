"""Approximate nearest neighbours by collision counting with query-centred windows.

Inner products become distances by one more component that gives all vectors the same length. Vectors lie in blocks
of bounded size; a block holds one sorted array for each projection. A query's windows open round its own places in
these arrays and widen by virtual rehashing (the same arrays, and only what a window gains is looked up). A vector
collides with the query once for each window that it lies in. Those that collide in half of the windows are verified
first; the distance of the k-th best of them says how often a vector as near as that must collide, and every vector
over this threshold is verified. So the verified share follows the data: little where neighbours stand out, much where
all vectors are nearly equally far, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Projections; share of the windows in which a vector as near as the k-th found must lie at least, by their last width;
#: standard deviations of its number of collisions that the threshold lies below the expected one; growth of a window
#: from one virtual rehashing to the next.
PROJECTIONS, INSIDE, BELOW, GROWTH = 64, 0.6, 1.0, 1.1
#: Vectors in a block and queries that meet it at once.
BLOCK, QUERIES = 1 << 14, 1 << 11
#: Queries whose collisions with a block are counted side by side.
ASIDE = 512
#: In spaces of fewer dimensions axes are drawn independently, else they are orthogonal in groups.
FEW = 24


def _axes(dim: int, seed: int) -> np.ndarray:
    """Directions whose projections of a vector are normal with its length as standard deviation."""
    rng = np.random.default_rng(seed)
    if dim < FEW:
        return rng.standard_normal((PROJECTIONS, dim))
    groups = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].T * np.sqrt(dim) for _ in range(-(-PROJECTIONS // dim))]
    return np.concatenate(groups)[:PROJECTIONS]


def _shrunk(vectors: np.ndarray) -> np.ndarray:
    """Vectors (rows) of any size at unit scale: divided by the largest component first, so that no square over- or underflows."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    small = vectors / np.where(top > 0, top, 1.0)
    return small / np.maximum(np.sqrt((small**2).sum(axis=1, keepdims=True)), 1e-300)


class Index:
    """Sorted projections of one block of vectors (unit length in one more dimension)."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        self.vectors = vectors
        small = vectors / np.abs(vectors).max()
        self.scaled = small / np.sqrt((small**2).sum(axis=1).max())
        rest = np.sqrt(np.maximum(0.0, 1.0 - (self.scaled**2).sum(axis=1)))
        self.axes = _axes(vectors.shape[1] + 1, seed)
        places = self.axes @ np.concatenate((self.scaled, rest[:, None]), axis=1).T
        self.order = np.argsort(places, axis=1)
        self.places = np.take_along_axis(places, self.order, axis=1)

    def _edges(self, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's (column's) windows begin and end in the sorted arrays."""
        left = np.array([p.searchsorted(x) for p, x in zip(self.places, at - width)])
        right = np.array([p.searchsorted(x, side="right") for p, x in zip(self.places, at + width)])
        return left, right

    def _collide(self, counts: np.ndarray, *windows: tuple[np.ndarray, np.ndarray]) -> None:
        """Adds one query's collisions in windows (one of each pair of edges for each array)."""
        found = [o[a:b] for left, right in windows for o, a, b in zip(self.order, left.tolist(), right.tolist())]
        counts += np.bincount(np.concatenate(found), minlength=len(counts)).astype(np.uint8)

    def search(self, queries: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """Numbers of the vectors to verify for each query: at least k (all, if there are fewer)."""
        begin = 0.0
        for start in range(0, len(queries), ASIDE):
            unit = _shrunk(queries[start : start + ASIDE])
            found, begin = self._verified(unit, k, begin)
            yield from found

    def _verified(self, unit: np.ndarray, k: int, begin: float) -> tuple[list[np.ndarray], float]:
        """The vectors to verify for each query, and the width at which the next queries may begin."""
        n, m = self.places.shape[1], PROJECTIONS
        some, least = min(n, 4 * k), m / 2
        at = self.axes[:, :-1] @ unit.T
        if not begin:  # the first query of a block feels its way
            begin, counts = 0.05, np.zeros(n, dtype=np.uint8)
            while (counts >= least).sum() < some:
                begin, counts = begin * GROWTH, np.zeros(n, dtype=np.uint8)
                left, right = self._edges(at[:, :1], np.array([begin]))
                self._collide(counts, (left[:, 0], right[:, 0]))
        counts = np.zeros((len(unit), n), dtype=np.uint8)
        width = np.full(len(unit), begin / GROWTH**0.5)
        left, right = self._edges(at, width)
        for q in range(len(unit)):
            self._collide(counts[q], (left[:, q], right[:, q]))

        def widen(which: np.ndarray) -> None:
            low, high = self._edges(at[:, which], width[which])
            for i, q in enumerate(which.tolist()):
                self._collide(counts[q], (low[:, i], left[:, q]), (right[:, q], high[:, i]))
            left[:, which], right[:, which] = low, high

        few = np.arange(len(unit))
        while len(few := few[[(counts[q] >= least).sum() < some for q in few]]):
            width[few] *= GROWTH
            widen(few)
        begin = float(np.median(width))
        first = [np.flatnonzero(counts[q] >= least) for q in range(len(unit))]
        # how far the k-th best of the first is
        best = [np.partition(self.scaled[x] @ unit[q], max(0, len(x) - k))[max(0, len(x) - k)] for q, x in enumerate(first)]
        far = np.sqrt(np.maximum(1e-12, 2 - 2 * np.array(best)))
        last = NormalDist().inv_cdf((1 + INSIDE) / 2) * far
        wider = np.flatnonzero(last > width)
        width[wider] = last[wider]
        if len(wider):
            widen(wider)
        share = np.array([erf(x) for x in width / far / sqrt(2)])
        enough = m * share - BELOW * np.sqrt(m * share * (1 - share))
        over = counts >= enough[:, None]
        for q, x in enumerate(first):
            over[q, x] = True
        return [np.flatnonzero(x) for x in over], begin


def _search(k: int):
    def run(key: tuple, block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if block.empty or queries.empty:
            return pd.DataFrame({c: [] for c in names}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        vectors = np.stack(block["v"].to_numpy()).astype(np.float64)
        ids = block["vec_id"].to_numpy()
        index = Index(vectors)
        out: list[tuple[np.ndarray, ...]] = []
        asked = np.stack(queries["v"].to_numpy()).astype(np.float64)
        for own, q, found in zip(queries["vec_id"].to_numpy(), asked, index.search(asked, k + 1)):
            found = found[ids[found] != own]
            with np.errstate(all="ignore"):
                score = vectors[found] @ q
            order = np.nan_to_num(-score, nan=np.inf, posinf=np.inf, neginf=-np.inf)
            if len(order) > k:  # only those not beyond the k-th are put in order
                near = np.flatnonzero(order <= np.partition(order, k - 1)[k - 1])
                found, score, order = found[near], score[near], order[near]
            best = np.lexsort((ids[found], order))[:k]
            out.append((np.full(len(best), own), ids[found][best], score[best]))
        return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*out)))))

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of vectors that aren't null or zero and hold only finite components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest found of each query: query_id, rank, vec_id, score (inner product in double precision).

    vectors has vec_id and embedding; other columns are ignored. Queries are the rows whose vec_id is divisible by
    `every`; candidates are all rows but those with the query's own vec_id. Nearest first, ties to the smaller vec_id;
    with fewer candidates, all of them. Null and zero vectors and those with null or non-finite components take no
    part, nor do rows without vec_id; vectors of another length than the most common one don't either. Rows that share
    a vec_id count as one, the smallest vector. Every vector is indexed: there are as many blocks as the table needs, and
    the stated queries meet all of them, block by block. A score that over- or underflows is what double precision
    gives; one that isn't a number ranks last. An empty table gives an empty result.
    """
    rows = usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = F.size("v").alias("d")
    head = rows.groupBy(size).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim, n = (head.d, head.n) if head else (0, 0)
    rows = rows.where(F.size("v") == dim)
    blocks = max(1, -(-n // BLOCK))
    query = rows.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-n // (every * QUERIES)))
    code = lambda seed, m: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    dealt = rows.withColumn("b", code(1, blocks)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = query.withColumn("p", code(2, parts)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = dealt.groupBy("b", "p").cogroup(asked.groupBy("b", "p"))
    found = pairs.applyInPandas(_search(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
