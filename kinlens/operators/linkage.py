"""Average linkage of a component that is too large for one task, in rounds over blocks.

The average cosine distance of two clusters is one less the product of their sums of unit vectors over the product of their sizes, so a cluster is
its sum and its size, and no matrix of distances is kept. Average linkage is reducible (a merged cluster is no nearer to a third than the nearer of
its parts), also with barred pairs at an infinite distance, which a merged cluster inherits. So every pair of clusters that are each other's
nearest may merge at once, in one round, and the groups are those of merging the closest pair of all again and again. Only clusters that merged,
or whose nearest did, look for a nearest one again.

A component of no more clusters than a block goes through all of its rounds in one task. Of a larger one, that happens first to its parts that no pair under
half of its limit connects, up to that half; rounds over blocks go on only while it has more clusters than a block.

A search holds one block of clusters in a task and streams those that ask past it. Ties go to the smaller id, so there is always a pair to merge while
any distance is under the limit; among equal distances the order of merges can differ from that of one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalized
from ..tables import discard, ship, written
from .graph import components

#: Clusters of a block, and of those that ask at once.
BLOCK_ROWS, ASKING = 8192, 512
#: Share of its limit up to which parts of a large component are grouped by themselves.
PART = 0.5


def held_together(must: list[tuple[int, int]], cannot: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the ``must`` pairs, in their order, that no ``cannot`` pair of what they would join bars."""
    parent: dict[int, int] = {}
    barred: dict[int, set[int]] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in cannot:
        if a != b:
            barred.setdefault(a, set()).add(b)
            barred.setdefault(b, set()).add(a)
    out = []
    for a, b in must:
        x, y = root(a), root(b)
        if x == y or y in {root(k) for k in barred.get(x, ())}:
            continue
        out.append((a, b))
        parent[y] = x
        barred[x] = barred.get(x, set()) | barred.pop(y, set())
    return out


def must_merges(constraints: DataFrame) -> DataFrame:
    """(a, b) of the must-links that hold. Those that one chain of them connects are looked at together where a cannot-link is among them; their
    order matters only there, and there are as many as were made by hand."""
    must = constraints.where("link = 'mustLink' AND face_a <> face_b").select("id", "face_a", "face_b")
    chains = components(must.select(F.col("face_a").alias("a"), F.col("face_b").alias("b")))
    of = lambda c: chains.select(F.col("id").alias(c), F.col("component").alias(f"chain_{c}"))
    cannot = constraints.where("link = 'cannotLink'").select("id", "face_a", "face_b").join(of("face_a"), "face_a").join(of("face_b"), "face_b").where("chain_face_a = chain_face_b")
    links = must.join(of("face_a"), "face_a").select(F.col("chain_face_a").alias("chain"), "id", "face_a", "face_b", F.lit(True).alias("must"))
    bars = written(cannot.select(F.col("chain_face_a").alias("chain"), "id", "face_a", "face_b", F.lit(False).alias("must")), "bars")
    disputed = bars.select("chain").distinct()

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        pairs = lambda p: list(zip(p["face_a"].tolist(), p["face_b"].tolist()))
        return pd.DataFrame(held_together(pairs(pdf[pdf["must"]]), pairs(pdf[~pdf["must"]])), columns=["a", "b"]).astype("int64")

    plain = links.join(disputed, "chain", "left_anti").select(F.col("face_a").alias("a"), F.col("face_b").alias("b"))
    return plain.union(links.join(disputed, "chain", "left_semi").unionByName(bars).groupBy("chain").applyInPandas(settle, "a long, b long"))


def _sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., total, n): vectors (total, n) summed up, position by position."""
    parts = rows.select(*by, "n", F.posexplode("total").alias("at", "x")).groupBy(*by, "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return parts.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("total"), F.max("n").alias("n"))


FOUND = "id long, near long, distance double"


def nearest_clusters(clusters: DataFrame, asking: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, near, distance): for each of ``asking`` (component, id, n, total, barred) its nearest of the ``clusters`` (component, id, n, total) of
    its component, without itself and those that it is barred from."""
    ship(clusters.sparkSession)
    count = clusters.groupBy("component").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    held = clusters.join(count, "component").select("component", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "id", "n", "total", F.array().cast("array<long>").alias("barred"))
    asked = asking.join(count, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "id", "n", "total", "barred")
    tasks = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.unionByName(asked).repartition(tasks, "component", "block").sortWithinPartitions("component", "block", "side", "id")
    schema = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("distance", pa.float64())])

    def means(b: pa.RecordBatch) -> np.ndarray:
        flat = b.column("total").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        return flat / b.column("n").to_numpy()[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, block = None, np.empty(0, np.int64), None
        for b in batches:
            marks = list(zip(*(b.column(c).to_pylist() for c in ("component", "block", "side"))))
            start = 0
            while start < len(marks):
                end = start + 1
                while end < len(marks) and end - start < ASKING and marks[end] == marks[start]:
                    end += 1
                part, at = b.slice(start, end - start), marks[start][:2]
                if at != place:
                    place, ids, block = at, np.empty(0, np.int64), None
                own = part.column("id").to_numpy()
                if marks[start][2] == 0:
                    ids, block = np.concatenate([ids, own]), means(part) if block is None else np.concatenate([block, means(part)])
                elif block is not None:
                    d = 1 - means(part) @ block.T
                    for k, barred in enumerate(part.column("barred").to_pylist()):
                        d[k, np.isin(ids, [own[k], *barred])] = np.inf
                    near = d.argmin(1)  # ids ascend, so the first of equals is the smallest
                    least = d[np.arange(len(own)), near]
                    some = np.isfinite(least)
                    yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(ids[near[some]]), pa.array(least[some])], schema=schema)
                start = end

    each = dealt.mapInArrow(run, FOUND)
    return each.groupBy("id").agg(F.min(F.struct("distance", "near")).alias("best")).select("id", "best.near", "best.distance")


class _Clusters:
    """Clusters of one component in a task: sums, sizes, ids that ascend, and those that each is barred from."""

    def __init__(self, ids: np.ndarray, totals: np.ndarray, n: np.ndarray, barred: list[set[int]]) -> None:
        self.ids, self.totals, self.n = ids, totals, n.astype(float)
        at = {v: k for k, v in enumerate(ids.tolist())}
        self.barred = [{at[x] for x in b if x in at} for b in barred]
        self.alive = np.ones(len(ids), bool)
        self.near, self.distance = np.full(len(ids), -1), np.full(len(ids), np.inf)

    def look(self, asking: np.ndarray, limit: float) -> None:
        """The nearest under the limit of each of ``asking``, the first of equals."""
        alive = np.flatnonzero(self.alive)
        place = np.full(len(self.ids), -1)
        place[alive] = np.arange(len(alive))
        means = self.totals[alive] / self.n[alive, None]
        for start in range(0, len(asking), ASKING):
            some = asking[start : start + ASKING]
            d = 1 - means[place[some]] @ means.T
            d[np.arange(len(some)), place[some]] = np.inf
            for k, i in enumerate(some.tolist()):
                if self.barred[i]:
                    d[k, place[list(self.barred[i])]] = np.inf
            at = d.argmin(1)
            least = d[np.arange(len(some)), at]
            self.near[some], self.distance[some] = np.where(least < limit, alive[at], -1), np.where(least < limit, least, np.inf)

    def merge(self, i: int, j: int) -> None:
        self.totals[i] += self.totals[j]
        self.n[i] += self.n[j]
        self.alive[j] = False
        for k in self.barred[j]:
            self.barred[k].discard(j)
            self.barred[k].add(i)
        self.barred[i] |= self.barred[j]
        self.barred[j] = set()

    def rounds(self, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a, b) where b has become part of a, after all merges under the limit."""
        into = np.arange(len(self.ids))
        asking = np.flatnonzero(self.alive)
        while len(asking):
            self.look(asking, limit)
            rows = np.flatnonzero(self.alive & (self.near >= 0))
            pairs = [(i, j) for i, j in zip(rows.tolist(), self.near[rows].tolist()) if i < j and self.near[j] == i]
            if not pairs and len(rows):  # equal distances that were computed with different last digits
                i = int(rows[self.distance[rows].argmin()])
                pairs = [(min(i, int(self.near[i])), max(i, int(self.near[i])))]
            changed = np.zeros(len(self.ids), bool)
            for i, j in pairs:
                self.merge(i, j)
                into[j] = i
                changed[[i, j]] = True
            asking = np.flatnonzero(self.alive & (changed | ((self.near >= 0) & changed[self.near]))) if pairs else rows[:0]
        while (into != into[into]).any():
            into = into[into]
        gone = np.flatnonzero(~self.alive)
        return self.ids[into[gone]], self.ids[gone]


def _with_bars(clusters: DataFrame, barred: DataFrame | None) -> DataFrame:
    """Clusters with the ids that each is ``barred`` from."""
    none = F.array().cast("array<long>")
    if barred is None:
        return clusters.withColumn("barred", none)
    return clusters.join(barred.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("barred")), "id", "left").withColumn("barred", F.coalesce("barred", none))


def merges_in_tasks(clusters: DataFrame, barred: DataFrame | None) -> DataFrame:
    """(a, b), where b becomes part of a, after all merges of each component of the ``clusters`` (component, id, limit, n, total), a task for a component."""
    ship(clusters.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        bars = [set(x.tolist() if isinstance(x, np.ndarray) else x) for x in pdf["barred"]]
        a, b = _Clusters(pdf["id"].to_numpy(), np.stack(pdf["total"].tolist()), pdf["n"].to_numpy(), bars).rounds(float(pdf["limit"].iat[0]))
        return pd.DataFrame({"a": a, "b": b})

    return _with_bars(clusters, barred).groupBy("component").applyInPandas(run, "a long, b long")


def _into(pairs: DataFrame) -> DataFrame:
    """(id, into) of all clusters of merges (a, b), where no a is another's b."""
    return pairs.select(F.col("b").alias("id"), F.col("a").alias("into")).union(pairs.select("a", "a").distinct())


def _all_rounds(clusters: DataFrame, barred: DataFrame | None, block_rows: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """``clusters`` (component, id, limit, n, total) and ``barred`` (a, b) after all merges under their limits, and the tables of merges (a, b)."""
    merges = []  # a table a round
    near, done, rest = None, None, clusters
    while True:
        sizes = written(rest.groupBy("component").agg(F.count("*").alias("clusters")), "sizes")
        large = sizes.where(F.col("clusters") > block_rows).select("component")
        small = sizes.where(f"clusters <= {block_rows}")
        if not small.isEmpty():
            few, rest = rest.join(small.select("component"), "component", "left_semi"), rest.join(large, "component", "left_semi")
            pairs = written(merges_in_tasks(few.join(small.where("clusters > 1").select("component"), "component", "left_semi"), barred), "merges")
            if not pairs.isEmpty():
                merges.append(pairs)
                few, barred = _merged(few, barred, _into(pairs))
            done = few if done is None else done.unionByName(few)
        if large.isEmpty():
            break
        # clusters that merged, or whose nearest did, ask again
        asking = rest if near is None else rest.join(near.select("id"), "id", "left_anti")
        found = nearest_clusters(rest, _with_bars(asking, barred).select("component", "id", "n", "total", "barred"), block_rows)
        # one without a nearest under its limit has none from now on: merged clusters are no nearer
        found = asking.select("id", "limit").join(found, "id", "left").select("id", F.when(F.col("distance") < F.col("limit"), F.col("near")).alias("near"), "distance")
        near = written(found if near is None else near.unionByName(found), "nearest")
        back = near.select(F.col("id").alias("near"), F.col("near").alias("back"))
        pairs = written(near.where("id < near").join(back, "near").where("back = id").select(F.col("id").alias("a"), F.col("near").alias("b")), "merges")
        if pairs.isEmpty():
            # equal distances that were computed with different last digits
            closest = near.where("near IS NOT NULL").join(rest, "id", "left_semi").orderBy("distance", "id").limit(1)
            pairs = written(closest.select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")), "merges")
            if pairs.isEmpty():
                done = rest if done is None else done.unionByName(rest)
                break
        merges.append(pairs)
        rest, barred = _merged(rest, barred, _into(pairs))
        gone = written(_into(pairs).select("id"), "gone")
        near = near.join(gone, "id", "left_anti").join(gone.toDF("near"), "near", "left_anti").select("id", "near", "distance")
    return done, barred, merges


def average_linkage_by_rounds(members: DataFrame, constraints: DataFrame | None, limit: Column, block_rows: int = BLOCK_ROWS, parts: DataFrame | None = None) -> DataFrame:
    """(id, grp): ``grp`` is the smallest id of the average-linkage group of each of ``members`` (component, id, kind, vec), whose components
    stay apart, under ``limit`` (of ``kind``) and ``constraints`` (face_a, face_b, link, id). ``parts`` (id, part) of components, which no pair under PART of the
    limit and no must-link connects, are grouped up to that first."""
    faces = written(members.select("component", "id", limit.alias("limit"), l2_normalized(F.col("vec")).alias("total"), F.lit(1).cast("long").alias("n")), "linkage-faces")
    merges = []  # tables of (a, b)
    clusters, barred = faces, None
    if constraints is not None:
        known = faces.select("id")
        inside = lambda df: df.join(known.toDF("face_a"), "face_a", "left_semi").join(known.toDF("face_b"), "face_b", "left_semi")
        own = written(inside(constraints), "linkage-constraints")
        first = written(must_merges(own), "merges")
        barred = own.where("link = 'cannotLink' AND face_a <> face_b").select(F.col("face_a").alias("a"), F.col("face_b").alias("b"))
        barred = written(barred.union(barred.select("b", "a")).distinct(), "barred")
        if not first.isEmpty():
            merges.append(first)
            clusters, barred = _merged(clusters, barred, components(first).select("id", F.col("component").alias("into")))
    if parts is not None:
        own_parts = clusters.join(parts, "id").select(F.col("part").alias("component"), "id", (F.col("limit") * PART).alias("limit"), "total", "n")
        clusters, barred, made = _all_rounds(written(own_parts, "parts"), barred, block_rows)
        clusters = written(clusters.select("id", "total", "n").join(faces.select("component", "id", "limit"), "id"), "clusters")
        merges += made
    merges += _all_rounds(clusters, barred, block_rows)[2]
    if not merges:
        return faces.select("id", F.col("id").alias("grp"))
    edges = merges[0]
    for m in merges[1:]:  # as many as there were rounds
        edges = edges.union(m)
    return faces.select("id").join(components(edges), "id", "left").select("id", F.coalesce("component", "id").alias("grp"))


def _merged(clusters: DataFrame, barred: DataFrame | None, moved: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Clusters and barred pairs after what is in ``moved`` (id, into) has become one with what it moved into."""
    moved = written(moved, "moved")
    by = ["component", "id", "limit"]
    parts = clusters.join(moved, "id").select("component", F.col("into").alias("id"), "limit", "total", "n")
    out = written(clusters.join(moved, "id", "left_anti").select(*by, "total", "n").unionByName(_sums(parts, by).select(*by, "total", "n")), "clusters")
    if barred is not None:
        x, y = moved.toDF("a", "new_a"), moved.toDF("b", "new_b")
        barred = written(barred.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b")).distinct(), "barred")
    discard(moved)
    return out, barred
