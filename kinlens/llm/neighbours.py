"""Approximate nearest neighbours by collision counting.

Every vector is projected on ``projections`` random lines; a block keeps each line's projections as a sorted array.
A query opens a window around its own projection on every line and counts how many windows each vector falls in.
Windows widen by virtual rehashing (the same arrays, a larger radius); a vector whose count reaches ``threshold`` is verified
by its exact distance. The search ends at a radius within which k verified vectors lie, where a vector at
exactly that distance falls in a window with probability 0.68, so that it stays under the threshold in about one of 25 cases
and nearer ones hardly ever; with windows that cover everything, all vectors are verified.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; rows of one
id are one vector (the smallest); vectors of other lengths than the query's are no candidates; ties go to the smaller id. Differences are
scaled by a power of two before they are squared where that would overflow or vanish; a distance beyond the largest double is infinite.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_ROWS, search_blocks

PROJECTIONS = 64
THRESHOLD = 38
#: The first radius as a share of the projections' spread, and how radii grow before and after the first find of k vectors.
FIRST, GROW, CREEP = 1 / 32, 2.0, 1.25
#: Queries whose counts are held at once.
QUERY_BATCH = 64


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows from a query."""
    half = vectors / 2 - query / 2  # half of the difference doesn't overflow
    top = np.abs(half).max(1)
    if len(top) and (top.max() > 1e150 or ((top > 0) & (top < 1e-150)).any()):
        scale = np.exp2(np.frexp(np.where(top > 0, top, 1))[1].astype(float) - 1)  # a power of two changes no digit
        with np.errstate(over="ignore"):
            return np.sqrt(((half / scale[:, None]) ** 2).sum(1)) * 2 * scale
    return np.sqrt(((vectors - query) ** 2).sum(1))


class CollisionIndex:
    """Sorted projections of vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, threshold: int = THRESHOLD, seed: int = 0) -> None:
        self.ids, self.vectors, self.threshold = ids, vectors, threshold
        self.lines = np.random.default_rng(seed).normal(size=(projections, vectors.shape[1]))
        # projections of vectors scaled to at most one, so that none overflows; windows are of projections alone
        top = np.abs(vectors).max(initial=0)
        self.unit = np.exp2(-float(np.frexp(top)[1])) if top > 1e100 or 0 < top < 1e-100 else 1.0
        keys = self.lines @ (vectors * self.unit).T
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, 1)
        self.spread = float(np.median(self.keys[:, -1] - self.keys[:, 0])) or 1.0

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """For each query its k nearest found, (distance, id) ascending, without the vector of its own id."""
        n, found = len(self.ids), []
        for start in range(0, len(queries), QUERY_BATCH):
            q, mine = queries[start : start + QUERY_BATCH], own[start : start + QUERY_BATCH]
            home = np.clip(q * self.unit, -1e200, 1e200) @ self.lines.T
            low = np.stack([np.searchsorted(keys, h) for keys, h in zip(self.keys, home.T)], 1)
            high = low.copy()
            counts = np.zeros((len(q), n), np.uint16)
            best = [(np.empty(0), np.empty(0, np.int64))] * len(q)
            radius = np.full(len(q), self.spread * FIRST)
            active = np.arange(len(q))
            while len(active):
                wide = radius[active]
                new_low = np.stack([np.searchsorted(keys, h - wide, "left") for keys, h in zip(self.keys, home[active].T)], 1)
                new_high = np.stack([np.searchsorted(keys, h + wide, "right") for keys, h in zip(self.keys, home[active].T)], 1)
                going = []
                for row, a in enumerate(active.tolist()):
                    l0, h0 = np.minimum(low[a], new_low[row]), np.maximum(high[a], new_high[row])
                    ring = [o[s:e] for o, s, e in zip(self.order, l0.tolist(), low[a].tolist()) if s < e] + [o[s:e] for o, s, e in zip(self.order, high[a].tolist(), h0.tolist()) if s < e]
                    low[a], high[a] = l0, h0
                    if ring:
                        more = np.bincount(np.concatenate(ring), minlength=n).astype(np.uint16)
                        fresh = np.flatnonzero((counts[a] < self.threshold) & (counts[a] + more >= self.threshold) & (self.ids != mine[a]))
                        counts[a] += more
                        if len(fresh):
                            d = distances(self.vectors[fresh], q[a])
                            d, ids = np.concatenate([best[a][0], d]), np.concatenate([best[a][1], self.ids[fresh]])
                            keep = np.lexsort((ids, d))[:k]
                            best[a] = d[keep], ids[keep]
                    d = best[a][0]
                    whole = (high[a] - low[a] == n).all()
                    far = d[k - 1] * self.unit if len(d) >= k else np.inf
                    if whole or far <= radius[a]:
                        continue
                    radius[a] = min(radius[a] * CREEP, far) if len(d) >= k else radius[a] * (GROW if radius[a] < self.spread / 8 else CREEP)
                    going.append(a)
                active = np.array(going, np.int64)
            found += [list(zip(d.tolist(), i.tolist())) for d, i in best]
        return found


def _arrays(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch by the vectors' length."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    out = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[size] = ids[at], flat[(ends[at] - size)[:, None] + np.arange(size)]
    return out


def _build(projections: int, threshold: int, batch: pa.RecordBatch) -> dict[int, CollisionIndex]:
    return {size: CollisionIndex(ids, v, projections, threshold) for size, (ids, v) in _arrays(batch).items()}


def _ask(k: int, index: dict[int, CollisionIndex], batch: pa.RecordBatch):
    for size, (ids, v) in _arrays(batch).items():
        if size in index:
            out = {"query_id": [], "vec_id": [], "score": []}
            for q, near in zip(ids.tolist(), index[size].search(ids, v, k)):
                for d, i in near:
                    for name, value in zip(out, (q, i, d)):
                        out[name].append(value)
            yield out


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, vector): one vector of doubles an id, without those that take no part."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, projections: int = PROJECTIONS, threshold: int = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found; both inputs as :func:`usable` gives them."""
    found = search_blocks(vectors, queries, partial(_build, projections, threshold), partial(_ask, k), "query_id long, vec_id long, score double", 8 * F.size("vector"), block_rows)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")  # k rows a block for each query
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
