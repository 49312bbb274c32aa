"""Similarity joins: Hamming distance by equal blocks, cosine distance by blocks of matrix products, nearest centroids.

Vector pairs never meet as a cross join of rows: rows are dealt into blocks, and a task multiplies one block by another and
gives back only the pairs under the limit. The number of blocks grows with the rows, so a task's memory does not; blocks too far apart to
hold a pair are never brought together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.images import hamming
from ..tables import ship, written
from .graph import components
from .order import numbered

MAX_HAMMING = 6
BITS = 64
#: Rows of a block of vectors; where a key would have more blocks than MOST_BLOCKS, its blocks grow instead, up to so many bytes, since every row is sent to as many.
#: A key has COPIES blocks without cells at most; it has these where its rows would be sent to more blocks each with cells, though far ones never meet.
BLOCK, MOST_BLOCKS, COPIES, BLOCK_BYTES = 2048, 32, 16, 64 << 20
#: Distances that a task has at once.
TILE = 2 << 20
#: Centroids up to this many bytes are sent to every task; more are joined in blocks.
BROADCAST_BYTES = 64 << 20
#: Faces of a task that meet a block of centroids.
FACES = 16_384
#: Pivots of a length of vectors (twice MOST_BLOCKS, so that a cell of twice the mean is one block), the lengths that have some, and the sample that they are
#: chosen from, at most; rows for each pivot, at least.
PIVOTS, DIMS, SAMPLE_ROWS, SAMPLE_BYTES, PIVOT_ROWS = 64, 8, 4096, 8 << 20, 16
#: By how much computed angles (radians) and distances can be off, with room.
SLACK = 1e-6
#: Pivots closer than this have no plane between them that rows could be told apart by.
SAME = 1e-3


def hamming_keys(n: int, most: int) -> tuple[int, int]:
    """(blocks, equal ones): into how many blocks to cut the bits for ``n`` hashes, and how many of them make a key.

    Hashes within ``most`` bits agree on r of most + r blocks at least, so every choice of r blocks as a key finds all pairs. More blocks
    mean more keys a hash and fewer hashes a key; the choice costs least where hashes are spread evenly.
    """
    def cost(r: int) -> float:
        blocks = most + r
        return comb(blocks, r) * (1 + n / 2 ** (r * (BITS // blocks)) / 2)

    r = min((r for r in range(1, 7) if most + r <= BITS), key=cost)
    return most + r, r


def hamming_pairs(hashes: DataFrame, most: int = MAX_HAMMING) -> DataFrame:
    """(a, b, distance) of distinct hashes (phash) within ``most`` bits, a < b.

    Candidates agree on the blocks of a key (:func:`hamming_keys`), whose size grows with the number of hashes; each pair is kept at the
    first key that it shares. Equal hashes are one row here, so a hot hash costs nothing.
    """
    distinct = written(hashes.select(F.col("phash").alias("h")).where("h IS NOT NULL").distinct(), "hashes")
    blocks, equal = hamming_keys(distinct.count(), most)
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    # the bits of a block, in place: all of a key's blocks fit one mask
    mask = lambda s, e: sum(1 << k for k in range(s, e))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [mask(s, e) for s, e in zip(edges, edges[1:])]
    keys = list(combinations(range(blocks), equal))
    pieces = F.array(*[F.struct(F.lit(k).alias("key"), F.col("h").bitwiseAND(F.lit(signed(sum(masks[i] for i in c)))).alias("bits")) for k, c in enumerate(keys)])
    cut = distinct.select("h", F.explode(pieces).alias("p")).select("h", "p.key", "p.bits")
    left, right = cut.toDF("a", "key", "bits"), cut.toDF("b", "key", "bits")
    pairs = left.join(right, ["key", "bits"]).where(F.col("a") < F.col("b"))
    found = pairs.withColumn("distance", hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= most)
    # the first key of a pair: the first ``equal`` of the blocks on which it agrees
    x = F.col("a").bitwiseXOR(F.col("b"))
    agreed = F.slice(F.filter(F.array(*[F.when(x.bitwiseAND(F.lit(signed(m))) == 0, F.lit(i)) for i, m in enumerate(masks)]), lambda i: i.isNotNull()), 1, equal)
    first = F.array(*[F.array(*[F.lit(i) for i in c]) for c in keys])
    return found.where(F.get(first, F.col("key")) == agreed).select("a", "b", "distance")


def duplicate_sets(photos: DataFrame, most: int = MAX_HAMMING) -> DataFrame:
    """Members of sets of two or more near-equal photos: (set_id, rank_in_set, id, size, set_size).

    ``photos`` has id, phash, width, height, size and state. Within a set larger areas come first, then larger files, then
    smaller ids; the id of the best is the set's. Sets of equal hashes are ranked by a window, which spills rather than collects.
    """
    rows = photos.where(F.col("phash").isNotNull() & (F.col("state") != "missing")).select("id", "phash", "size", (F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0))).alias("area"))
    rows = written(rows, "hashed")
    linked = components(hamming_pairs(rows, most))
    labelled = rows.join(linked.select(F.col("id").alias("phash"), "component"), "phash", "left").withColumn("component", F.coalesce("component", "phash"))
    return ranked_sets(labelled)


def ranked_sets(labelled: DataFrame) -> DataFrame:
    """Sets of ``component`` with their order; the window is over one set, and the sets are numbered by their one best row."""
    order = Window.partitionBy("component").orderBy(F.col("area").desc(), F.col("size").desc(), "id")
    sizes = labelled.groupBy("component").agg(F.count("*").alias("set_size"), F.min_by("id", F.struct(-F.col("area"), -F.col("size"), F.col("id"))).alias("set_id")).where("set_size > 1")
    members = labelled.join(sizes, "component").withColumn("rank_in_set", F.row_number().over(order))
    return members.select("set_id", "rank_in_set", "id", "size", "set_size")


def set_positions(members: DataFrame) -> DataFrame:
    """(set_id, set_size, position) of the sets, larger ones first, then by best photo's id."""
    best = members.where("rank_in_set = 1").select("set_id", "set_size")
    return numbered(best, [F.col("set_size").desc(), F.col("set_id")], 1, "position")


def shown_sets(members: DataFrame, photos: DataFrame, offline_roots: DataFrame, pins: DataFrame) -> DataFrame:
    """Sets as they are shown: photos of offline roots go, then sets under two; a pinned photo leads its set."""
    here = photos.join(offline_roots.select(F.col("id").alias("root_id")), "root_id", "left_anti").select("id")
    rest = members.join(here, "id", "left_semi")
    sizes = rest.groupBy("set_id").agg(F.count("*").alias("n")).where("n > 1").select("set_id")
    marked = rest.join(sizes, "set_id", "left_semi").join(pins.select("id", F.lit(1).alias("pinned")), "id", "left")
    order = Window.partitionBy("set_id").orderBy(F.coalesce("pinned", F.lit(0)).desc(), "rank_in_set")
    return marked.withColumn("rank_in_set", F.row_number().over(order)).select("set_id", "rank_in_set", "id", "size", F.count("*").over(Window.partitionBy("set_id")).alias("set_size"))


def _matrix(vectors: pd.Series | np.ndarray) -> np.ndarray:
    m = vectors if isinstance(vectors, np.ndarray) else np.stack([np.asarray(v, np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n > 1e-12, m / np.maximum(n, 1e-300), m)


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) of a boolean matrix of links that connect what all of them connect: fewer than it has rows and columns."""
    n, m = near.shape
    rows, columns = np.arange(n), n + np.arange(m)
    while True:  # the smallest label that a row or column reaches
        new_rows = np.minimum(rows, np.where(near, columns, n + m).min(1))
        new_columns = np.minimum(columns, np.where(near, new_rows[:, None], n + m).min(0))
        if (new_rows == rows).all() and (new_columns == columns).all():
            break
        rows, columns = new_rows, new_columns
    # a breadth-first tree of each component: every node but the root links to one of the level before
    links: list[tuple[np.ndarray, np.ndarray]] = []
    level_rows, seen_rows, seen_columns = rows == np.arange(n), rows == np.arange(n), np.zeros(m, bool)
    while level_rows.any():
        at = np.flatnonzero(level_rows)
        fresh = ~seen_columns & near[at].any(0)
        c = np.flatnonzero(fresh)
        links.append((at[near[np.ix_(at, c)].argmax(0)], c))
        seen_columns |= fresh
        level_rows = ~seen_rows & near[:, c].any(1)
        r = np.flatnonzero(level_rows)
        if len(r):
            links.append((r, c[near[np.ix_(r, c)].argmax(1)]))
        seen_rows |= level_rows
    return np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links])


class _Links:
    """Links (a, b, distance) of a task that connect what all links given connect: no more than there are ids."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.kept: list[tuple[int, int, float]] = []

    def __len__(self) -> int:
        return len(self.kept)

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def add(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> None:
        for link in zip(a.tolist(), b.tolist(), distance.tolist()):
            x, y = self.root(link[0]), self.root(link[1])
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.kept.append(link)

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, distance = zip(*self.kept)
        return np.array(a, np.int64), np.array(b, np.int64), np.array(distance, float)


def farthest_first(m: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the unit rows of ``m`` that cover it: half are the first ones, so that where rows are dense there are some, the others each the
    farthest from those before."""
    first = max(1, n // 2)
    chosen = list(range(min(first, len(m))))
    near = (m @ m[chosen].T).max(1)
    while len(chosen) < n:
        k = int(near.argmin())
        if near[k] > 1 - 1e-9:
            break
        chosen.append(k)
        near = np.maximum(near, m @ m[k])
    return m[chosen]


def centred(m: np.ndarray, pivots: np.ndarray, rounds: int = 4) -> np.ndarray:
    """The pivots, moved to the middle of the unit rows of ``m`` that they are nearest to."""
    for _ in range(rounds):
        best = (m @ pivots.T).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, best, m)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norms > 1e-3, sums / np.maximum(norms, 1e-3), pivots)
    return pivots


def _units(vectors: pd.Series) -> np.ndarray:
    """As :func:`_matrix`, with null rows (NaN) for what has no direction."""
    m = _matrix(vectors)
    with np.errstate(invalid="ignore"):
        m[~(np.abs((m * m).sum(1) - 1) < 1e-6)] = np.nan
    return m


def _pivots(base: DataFrame, large: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by length of vectors: no more than PIVOTS each, from SAMPLE_ROWS rows and SAMPLE_BYTES at most, for the DIMS lengths of most rows; other lengths go
    without, and all their blocks meet."""
    lengths = large.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").limit(DIMS).collect()
    out = {}
    for r in lengths:
        wanted = max(2, min(PIVOTS, r["n"] // PIVOT_ROWS))
        most = max(wanted, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * r["dim"])))
        rows = base.where(F.col("dim") == r["dim"]).join(large, [c for c in large.columns if c not in ("n", "size")], "left_semi")
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("vec").toPandas()
        m = _units(sample["vec"])
        m = m[~np.isnan(m).any(1)]
        if len(m):
            out[r["dim"]] = centred(m, farthest_first(m, wanted))
    return out


def blocks_that_meet(base: DataFrame, full: list[str], limit: float, block: int) -> DataFrame:
    """Rows (full, id, vec) in groups (full, i, j) of two blocks i <= j of a key, or one with itself (``side`` tells them apart), such that every pair
    with a cosine distance up to ``limit`` is together in one group.

    Rows of keys beyond one block are dealt into cells by the nearest of some pivots, and cells into blocks by a hash. A block has ``block`` rows, or a
    share of 1 / MOST_BLOCKS of its key's (1 / COPIES where cells don't help), so that the copies of a row don't grow with the rows. Angles obey the triangle
    inequality: with D between two pivots, and the angles of the cells' rows to their own pivots from lo to hi, two rows are D - hi - hi' apart at least, and
    lo - D - hi' (or the other way round). And the plane between two pivots keeps rows of their cells as far apart at least as the distances of both to it, so
    a row of one cell goes to another only if its own distance and the other cell's least one leave room for a pair. Cells that can't hold a pair under the
    limit never meet, whatever they hold; rows without a direction are a cell that meets all.
    """
    base = base.withColumn("cell", F.lit(0).cast("long")).withColumn("angle", F.lit(None).cast("double")).withColumn("margins", F.lit(None).cast("array<float>"))
    counts = base.groupBy(*full).agg(F.count("*").alias("n"))
    size = lambda blocks: F.greatest(F.lit(block), F.least(F.ceil(F.col("n") / blocks), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))).cast("long")
    large = written(counts.where(F.col("n") > block).withColumn("size", size(MOST_BLOCKS)), "large-keys")
    if large.isEmpty():
        return base.select(*full, "id", "vec", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"))
    pivots = _pivots(base, large)
    gaps = {dim: np.linalg.norm(m[:, None] - m[None], axis=2) for dim, m in pivots.items()}
    held = base.sparkSession.sparkContext.broadcast((pivots, gaps))  # DIMS * SAMPLE_BYTES at most, and DIMS * PIVOTS ** 2 numbers

    most = max(map(len, pivots.values()), default=0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, gaps = held.value
        for batch in batches:
            dims, flat = batch.column("dim").to_numpy(), batch.column("vec").flatten().to_numpy(zero_copy_only=False)
            cell, angle, margins, starts = np.zeros(len(dims), np.int64), np.full(len(dims), np.nan), np.full((len(dims), most), np.nan, np.float32), np.cumsum(dims) - dims
            for dim in set(dims.tolist()) & set(pivots):
                at = np.flatnonzero(dims == dim)
                u = _units(flat[starts[at][:, None] + np.arange(dim)])
                cos = u @ pivots[dim].T
                lost = np.isnan(cos).any(1)
                best = np.where(lost[:, None], 0.0, cos).argmax(1)
                own, gap = cos[np.arange(len(cos)), best], gaps[dim][best]
                cell[at], angle[at] = np.where(lost, -1, best), np.where(lost, np.nan, np.arccos(np.clip(own, -1, 1)))
                margins[at, : len(gaps[dim])] = np.where(gap > SAME, (own[:, None] - cos) / np.maximum(gap, SAME), 0.0)
            own = {"cell": pa.array(cell), "angle": pa.array(angle, from_pandas=True), "margins": pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1) * most, pa.int32()), pa.array(margins.ravel(), from_pandas=True))}
            yield pa.RecordBatch.from_arrays([own.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    moved = written(base.join(large, full, "left_semi").select(*base.columns).mapInArrow(place, schema), "placed")
    rest = base.join(large, full, "left_anti").select(*base.columns)
    nearest = F.array(*[F.min(F.get("margins", F.lit(k))) for k in range(most)]).cast("array<double>")
    cells = moved.groupBy(*full, "cell").agg(F.count("*").alias("rows"), F.min("angle").alias("lo"), F.max("angle").alias("hi"), nearest.alias("near")).join(large, full)
    cells = cells.select(*full, "cell", F.ceil(F.col("rows") / F.col("size")).cast("int").alias("subs"), "lo", "hi", "near")
    cells = written(cells, "cells")  # PIVOTS + 1 a key at most
    apart = [(int(dim), p, q, float(np.arccos(np.clip(m[p] @ m[q], -1, 1)))) for dim, m in pivots.items() for p in range(len(m)) for q in range(len(m)) if p != q]
    columns = pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("other", pa.int64()), ("between", pa.float64())])
    between = base.sparkSession.createDataFrame(pa.Table.from_pylist([dict(zip(columns.names, x)) for x in apart], schema=columns))
    other = cells.select(*full, F.col("cell").alias("other"), F.col("subs").alias("other_subs"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"), F.col("near").alias("other_near"))
    met = cells.join(other, full).join(F.broadcast(between), ["dim", "cell", "other"], "left").withColumn("between", F.coalesce("between", F.lit(0.0)))
    reach = float(np.arccos(np.clip(1 - limit, -1, 1))) + SLACK
    least = F.greatest(F.col("between") - F.col("hi") - F.col("other_hi"), F.col("lo") - F.col("between") - F.col("other_hi"), F.col("other_lo") - F.col("between") - F.col("hi"))
    all_meet = (F.col("cell") == F.col("other")) | F.col("lo").isNull() | F.col("other_lo").isNull() | F.lit(limit >= 2)
    # how far from the plane a row of the cell may be (null: anywhere)
    room = F.when(~all_meet, F.lit(float(np.sqrt(max(0.0, 2 * limit))) + SLACK) - F.get("other_near", F.col("cell").cast("int")))
    met = met.withColumn("room", room).where(all_meet | ((least <= reach) & (F.get("near", F.col("other").cast("int")) <= F.col("room"))))
    met = met.groupBy(*full, "cell").agg(F.collect_list(F.struct("other", F.col("other_subs").alias("subs"), "room")).alias("others"), F.max("subs").alias("subs"))
    met = written(met, "met")  # the square of a key's cells at most
    reached = F.filter("others", lambda o: o["room"].isNull() | (F.get("margins", o["other"].cast("int")) <= o["room"]))
    sent = moved.select(*full, "cell", "margins").join(met, [*full, "cell"]).groupBy(*full).agg(F.sum(F.aggregate(reached, F.lit(0).cast("long"), lambda n, o: n + o["subs"])).alias("copies"))
    alike = sent.join(large, full).withColumn("subs", F.ceil(F.col("n") / size(COPIES)).cast("int")).where(F.col("copies") > F.col("subs") * F.col("n"))
    alike = written(alike.select(*full, "subs"), "alike")
    met = met.join(alike, full, "left_anti")
    none = F.lit(0).cast("long")
    met = met.unionByName(alike.select(*full, none.alias("cell"), "subs", F.array(F.struct(none.alias("other"), "subs", F.lit(None).cast("double").alias("room"))).alias("others")))
    moved = moved.join(alike, full, "left").withColumn("cell", F.when(F.col("subs").isNotNull(), none).otherwise(F.col("cell"))).drop("subs")
    name = lambda cell, sub: cell * F.lit(1 << 32) + sub
    # a cell can hold a third of all rows; where the cells are too many to broadcast, the join deals it out in pieces
    dealt = moved.join(met, [*full, "cell"]).withColumn("at", name(F.col("cell"), F.pmod(F.xxhash64("id"), F.col("subs"))))
    dealt = dealt.withColumn("o", F.explode(reached)).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("o.subs") - 1))).withColumn("to", name(F.col("o.other"), F.col("to")))
    dealt = dealt.select(*full, "id", "vec", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), (F.col("at") > F.col("to")).cast("int").alias("side"))
    return dealt.unionByName(rest.select(*full, "id", "vec", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side")))


def cosine_pairs(rows: DataFrame, limit: float, inclusive: bool = False, keys: tuple[str, ...] = ("kind",), block: int = BLOCK, spanning: dict[str, float] | None = None) -> DataFrame:
    """(keys, a, b, distance) of pairs a < b of one key and length with cosine distance under (or at) the limit.

    ``rows``: keys, id, vec. A task takes pairs of blocks that can hold such a pair (:func:`blocks_that_meet`) one after another: it holds one block and streams
    the other past it, so its memory grows with neither the rows nor the pairs. With ``spanning``, limits by the first key's value ("" for others), a task gives back only as many of its pairs under that as connect what they all connect, fewer than
    it has rows: all that components need, however dense the pairs are.
    """
    ship(rows.sparkSession)
    full = [*keys, "dim"]
    # a null key is a key; vectors are only held against vectors of their length
    base = written(rows.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], "id", F.col("vec").cast("array<double>").alias("vec"), F.size("vec").alias("dim")).where("dim > 0"), "vectors")

    names = [*keys, "a", "b", "distance"]
    schema = pa.schema([(k, pa.string()) for k in keys] + [("a", pa.int64()), ("b", pa.int64()), ("distance", pa.float64())])

    def met(at: tuple, own: np.ndarray, u: np.ndarray, ids: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of some rows with a block (where they are its last rows: with those before them)."""
        d = 1 - u @ block.T
        keep = (d <= limit) if inclusive else (d < limit)
        if spanning is None:
            keep &= own[:, None] != ids[None]
            if at[-2] == at[-1]:
                keep &= np.arange(len(ids))[None] < np.arange(len(ids) - len(own), len(ids))[:, None]
            x, y = np.nonzero(keep)
        else:
            keep &= (d < spanning.get(at[0], spanning[""])) & (own[:, None] != ids[None])
            x, y = _spanning(keep)
        return np.minimum(own[x], ids[y]), np.maximum(own[x], ids[y]), d[x, y]

    def told(at: tuple, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(at[k], pa.string()), len(a)) for k in range(len(keys))] + [pa.array(a), pa.array(b), pa.array(distance)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, links, filled, ids, block = None, _Links(), 0, np.empty(0, np.int64), np.empty((0, 0))
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in (*full, "i", "j", "side"))))
            own_ids, flat, start = batch.column("id").to_numpy(), batch.column("vec"), 0
            while start < len(marks):
                at, side = marks[start][:-1], marks[start][-1]
                if at != place:
                    if len(links):
                        yield told(place, *links.all())
                    place, links, filled = at, _Links(), 0
                end, most = start + 1, max(64, min(BLOCK, TILE // max(1, filled)))
                while end < len(marks) and end - start < most and marks[end] == marks[start]:
                    end += 1
                own = own_ids[start:end]
                u = _matrix(flat.slice(start, end - start).flatten().to_numpy(zero_copy_only=False).reshape(end - start, -1))
                if side == 0:
                    if not filled or filled + len(own) > len(ids) or block.shape[1] != u.shape[1]:  # room for twice as many
                        more = max(BLOCK, 2 * (filled + len(own)))
                        ids, block = np.concatenate([ids[:filled], np.empty(more - filled, np.int64)]), np.concatenate([block[:filled].reshape(filled, u.shape[1]), np.empty((more - filled, u.shape[1]))])
                    ids[filled : filled + len(own)], block[filled : filled + len(own)] = own, u
                    filled += len(own)
                if filled and (side or at[-2] == at[-1]):
                    found = met(at, own, u, ids[:filled], block[:filled])
                    if spanning is not None:
                        links.add(*found)
                    elif len(found[0]):
                        yield told(at, *found)
                start = end
        if len(links):
            yield told(place, *links.all())

    types = ", ".join(f"{k} string" for k in keys)
    group = [*full, "i", "j"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks_that_meet(base, full, limit, block).select(*group, "side", "id", "vec").repartition(tasks, *group).sortWithinPartitions(*group, "side")
    return dealt.mapInArrow(run, f"{types}, a long, b long, distance double").select(*names)


def nearest_two(faces: DataFrame, persons: DataFrame, by_model: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, person_id, best, runner_up): each face's nearest person of its kind and length, and the next distance (null for none).

    ``faces``: id, kind, vec[, model]; ``persons``: id, kind, centroid[, model]. Centroids are broadcast up to ``broadcast_bytes``;
    beyond that faces meet blocks of centroids and the two best of each block are merged.
    """
    ship(faces.sparkSession)
    keys = ["kind", "model"] if by_model else ["kind"]
    clean = lambda df, v: df.select("id", *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], F.col(v).cast("array<double>").alias("vec"), F.size(v).alias("dim")).where("dim > 0")
    f, p = clean(faces, "vec"), clean(persons, "centroid")
    p = written(p, "centroids")
    bytes_ = p.agg(F.coalesce(F.sum(F.col("dim") * 8 + 32), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(bytes_) // broadcast_bytes))
    schema = "id long, person_id long, best double, runner_up double"

    def top(fv: pd.DataFrame, pv: pd.DataFrame) -> pd.DataFrame:
        d = 1 - _matrix(fv["vec"]) @ np.stack([np.asarray(v, np.float64) for v in pv["vec"]]).T
        order = np.lexsort((np.broadcast_to(pv["id"].to_numpy(), d.shape), d), axis=1)
        rows = np.arange(len(fv))
        second = d[rows, order[:, 1]] if d.shape[1] > 1 else np.full(len(fv), np.nan)
        return pd.DataFrame({"id": fv["id"].to_numpy(), "person_id": pv["id"].to_numpy()[order[:, 0]], "best": d[rows, order[:, 0]], "runner_up": second})

    if blocks == 1:
        held = faces.sparkSession.sparkContext.broadcast({k: g for k, g in p.toPandas().groupby([*keys, "dim"])})  # at most broadcast_bytes

        def stream(batches):
            for pdf in batches:
                for k, g in pdf.groupby([*keys, "dim"]):
                    if k in held.value:
                        yield top(g, held.value[k])

        return f.mapInPandas(stream, schema)
    placed = p.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    salts = max(1, -(-f.count() // FACES))  # as many as keep a task at FACES faces, whatever their kinds
    spread = f.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    salted = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def pair(key, fv: pd.DataFrame, pv: pd.DataFrame) -> pd.DataFrame:
        if fv.empty or pv.empty:
            return pd.DataFrame({"id": [], "person_id": [], "best": [], "runner_up": []})
        return top(fv, pv)

    full = [*keys, "dim", "block", "salt"]
    each = spread.groupBy(*full).cogroup(salted.groupBy(*full)).applyInPandas(pair, schema)
    best = F.min(F.struct("best", "person_id")).alias("first")
    merged = each.groupBy("id").agg(best, F.array_sort(F.concat(F.collect_list("best"), F.filter(F.collect_list("runner_up"), lambda x: ~F.isnan(x)))).alias("all"))
    return merged.select("id", "first.person_id", "first.best", F.get("all", F.lit(1)).alias("runner_up"))

