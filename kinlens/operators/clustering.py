"""Constraint-aware grouping of face vectors into people with stable ids.

Average linkage is exact though distributed: an average under the threshold needs one pair under it, so no merge leaves a
connected component of the graph of such pairs and of must-links. Components come from block products and label propagation;
each is clustered by itself, in the order of face ids: in one task, or in rounds over blocks where it is large. Centroid merges go by components of close centroids, too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import centroids
from ..tables import ship, written
from .browse import majority
from .graph import components
from .linkage import BLOCK_ROWS, PART, average_linkage_by_rounds
from .order import numbered
from .similarity import cosine_pairs, nearest_two

# Fixed values.
THRESHOLD, PET_THRESHOLD = 0.4, 0.5
MERGE_RATIO, MARGIN_RATIO = 0.7, 0.25
FULL_LIMIT = 2000
#: Faces of a component that one task clusters, with a matrix of their distances; larger ones go by rounds.
LARGE = 2048
KEYS = ("kind", "model")


@dataclass(frozen=True)
class Config:
    """Thresholds of humans and pets, and the least size of a human group (pets: 1)."""

    threshold: float = THRESHOLD
    pet_threshold: float = PET_THRESHOLD
    min_group: int = 2


def _as_key(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("human" if c == "kind" else "")).alias(c)


def usable(faces: DataFrame) -> DataFrame:
    """(id, photo_id, kind, model, dim, vec, person_id) of faces with an id and a vector."""
    return faces.where(F.col("id").isNotNull() & (F.size("embedding") > 0)).select("id", "photo_id", _as_key("kind"), _as_key("model"), F.size("embedding").alias("dim"), F.col("embedding").alias("vec"), "person_id")


class _Nearest:
    """Each row's nearest later row of a symmetric distance matrix with barred pairs at infinity; the first of equals."""

    def __init__(self, d: np.ndarray) -> None:
        self.d = d
        self.at = np.zeros(len(d), np.int64)
        self.best = np.full(len(d), np.inf)
        for i in range(len(d) - 1):
            self.look(i)

    def look(self, i: int) -> None:
        if i + 1 < len(self.d):
            self.at[i] = i + 1 + int(np.argmin(self.d[i, i + 1 :]))
            self.best[i] = self.d[i, self.at[i]]

    def closest(self) -> tuple[int, int, float]:
        i = int(np.argmin(self.best))
        return i, int(self.at[i]), float(self.best[i])

    def merged(self, i: int, j: int) -> None:
        """Row i has new distances and row j is gone."""
        self.best[j] = np.inf
        self.look(i)
        for k in np.flatnonzero(np.isfinite(self.best)).tolist():
            if k != i and (self.at[k] == i or self.at[k] == j):
                self.look(k)
        before = np.arange(i)
        closer = before[(self.d[:i, i] < self.best[:i]) | ((self.d[:i, i] == self.best[:i]) & (self.at[:i] > i))]
        closer = closer[np.isfinite(self.d[closer, i])]
        self.best[closer], self.at[closer] = self.d[closer, i], i


def average_linkage(vectors: np.ndarray, threshold: float, must: list[tuple[int, int]] = (), cannot: list[tuple[int, int]] = ()) -> np.ndarray:
    """Labels 0, 1, ... of greedy average linkage over cosine distances strictly under the threshold.

    Must-links merge first unless a cannot-link bars them; pairs that name no row are skipped. The closest pair merges, the
    first in row order of equals, and stays in the place of its first row; labels follow the order of places.
    """
    v = np.asarray(vectors, float)
    n = len(v)
    if not n:
        return np.empty(0, np.int64)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.where(norm > 1e-12, v / np.maximum(norm, 1e-300), v)
    mean = 1 - v @ v.T
    barred = np.zeros((n, n), bool)
    for a, b in cannot:
        if a != b and 0 <= a < n and 0 <= b < n:
            barred[a, b] = barred[b, a] = True
    size, place = np.ones(n), np.arange(n)
    alive = np.ones(n, bool)

    def join(i: int, j: int) -> None:
        row = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        mean[i], mean[:, i] = row, row
        barred[i] |= barred[j]
        barred[:, i] = barred[i]
        size[i] += size[j]
        alive[j] = False
        place[place == j] = i

    for a, b in must:
        if 0 <= a < n and 0 <= b < n:
            i, j = sorted((int(place[a]), int(place[b])))
            if i != j and not barred[i, j]:
                join(i, j)
    d = np.where(barred | ~alive[:, None] | ~alive[None], np.inf, mean)
    np.fill_diagonal(d, np.inf)
    near = _Nearest(d)
    while n > 1:
        i, j, best = near.closest()
        if not best < threshold:
            break
        join(i, j)
        row = np.where(barred[i] | ~alive, np.inf, mean[i])
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        near.merged(i, j)
    return np.unique(place, return_inverse=True)[1]


def merge_by_centroid(sums: np.ndarray, threshold: float, cannot: list[tuple[int, int]] = ()) -> np.ndarray:
    """Group number of each group after greedily merging the closest centroids strictly under the threshold.

    ``sums`` are sums of unit vectors: a merged centroid is the direction of all members' sum. Memory grows with the groups, not
    their square: each group keeps its nearest later one.
    """
    s = np.asarray(sums, float).copy()
    n = len(s)

    def unit(x: np.ndarray) -> np.ndarray:
        k = np.linalg.norm(x, axis=-1, keepdims=True)
        return np.where(k > 1e-12, x / np.maximum(k, 1e-300), x)

    c = unit(s)
    barred: list[set[int]] = [set() for _ in range(n)]
    for a, b in cannot:
        if a != b and 0 <= a < n and 0 <= b < n:
            barred[a].add(b)
            barred[b].add(a)
    place, alive = np.arange(n), np.ones(n, bool)
    at, best = np.zeros(n, np.int64), np.full(n, np.inf)

    def look(i: int) -> None:
        d = np.where(alive[i + 1 :], 1 - c[i + 1 :] @ c[i], np.inf)
        for k in barred[i]:
            if k > i:
                d[k - i - 1] = np.inf
        if len(d):
            at[i] = i + 1 + int(np.argmin(d))
            best[i] = d[at[i] - i - 1]

    for i in range(n):
        look(i)
    while n > 1:
        i = int(np.argmin(best))
        j = int(at[i])
        if not best[i] < threshold:
            break
        s[i] += s[j]
        c[i] = unit(s[i])
        alive[j], best[j] = False, np.inf
        place[place == j] = i
        for k in barred[j]:
            barred[k].discard(j)
            barred[k].add(i)
        barred[i] |= barred[j]
        look(i)
        for k in np.flatnonzero(np.isfinite(best)).tolist():
            if k != i and at[k] in (i, j):
                look(k)
        d = 1 - c[:i] @ c[i]
        closer = np.flatnonzero(alive[:i] & ((d < best[:i]) | ((d == best[:i]) & (at[:i] > i))))
        for k in closer.tolist():
            if i not in barred[k]:
                best[k], at[k] = d[k], i
    return np.unique(place, return_inverse=True)[1]


def threshold_of(kind: Column, config: Config, ratio: float = 1.0) -> Column:
    return F.when(kind == "human", config.threshold * ratio).otherwise(config.pet_threshold * ratio)


def cluster(faces: DataFrame, constraints: DataFrame | None, config: Config, large: int = LARGE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, kind, model, dim, grp) of usable faces: ``grp`` is the smallest face id of its average-linkage group. Components of more than
    ``large`` faces go by rounds, where no task has more than ``block_rows`` of their clusters at once."""
    ship(faces.sparkSession)
    base = written(faces.select("id", *KEYS, "dim", "vec"), "faces")
    most = max(config.threshold, config.pet_threshold)
    close = cosine_pairs(base, most, keys=KEYS, spanning={"human": config.threshold, "": config.pet_threshold})
    edges = close.where(F.col("distance") < threshold_of(F.col("kind"), config)).select("a", "b")
    where = base.select("id", F.struct(*KEYS, "dim").alias("space"))
    if constraints is not None:
        a, b = where.toDF("face_a", "space_a"), where.toDF("face_b", "space_b")
        # a constraint across spaces is inert
        own = written(constraints.join(a, "face_a").join(b, "face_b").where("space_a = space_b").select("face_a", "face_b", F.col("kind").alias("link"), "id"), "constraints")
        edges = edges.union(own.where("link = 'mustLink'").select("face_a", "face_b"))
    found = components(edges)
    alone = base.join(found, "id", "left_anti").select("id", *KEYS, "dim", F.col("id").alias("grp"))
    rows = base.join(found, "id").select("component", "id", *KEYS, "dim", "vec")
    giants = written(found.groupBy("component").count().where(F.col("count") > large), "giants")
    if not giants.isEmpty():
        many = written(rows.join(giants.select("component"), "component", "left_semi"), "giant-faces")
        rows, found = rows.join(giants, "component", "left_anti"), found.join(giants, "component", "left_anti")
        parts = None
        if not giants.where(F.col("count") > block_rows).isEmpty():
            closer = {"human": config.threshold * PART, "": config.pet_threshold * PART}
            tight = cosine_pairs(many, most * PART, keys=(*KEYS, "component"), spanning=closer).select("a", "b")
            linked = components(tight if constraints is None else tight.union(own.where("link = 'mustLink'").select("face_a", "face_b")))
            parts = many.select("id").join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("part"))
        grouped = average_linkage_by_rounds(many, None if constraints is None else own, threshold_of(F.col("kind"), config), block_rows, parts)
        alone = alone.unionByName(many.join(grouped, "id").select("id", *KEYS, "dim", "grp"))
    schema = "id long, kind string, model string, dim int, grp long"

    def label(pdf: pd.DataFrame, links: pd.DataFrame | None) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        at = {v: k for k, v in enumerate(pdf["id"].tolist())}
        must, cannot = [], []
        if links is not None:
            for r in links.sort_values("id").itertuples():
                if r.face_a in at and r.face_b in at:
                    (must if r.link == "mustLink" else cannot).append((at[r.face_a], at[r.face_b]))
        limit = config.threshold if pdf["kind"].iat[0] == "human" else config.pet_threshold
        labels = average_linkage(np.stack(pdf["vec"].tolist()), limit, must, cannot)
        pdf["grp"] = pdf.groupby(labels)["id"].transform("min")
        return pdf[["id", "kind", "model", "dim", "grp"]]

    if constraints is None:
        grouped = rows.groupBy("component").applyInPandas(lambda pdf: label(pdf, None), schema)
    else:
        links = own.join(found.toDF("face_a", "component"), "face_a").select("component", "face_a", "face_b", "link", "id")
        empty = pd.DataFrame({"id": [], "kind": [], "model": [], "dim": [], "grp": []})
        grouped = rows.groupBy("component").cogroup(links.groupBy("component")).applyInPandas(lambda p, q: label(p, q) if len(p) else empty, schema)
    return grouped.unionByName(alone)


def unit_sums(faces: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, kind, model, dim, total, n): sums of unit vectors by group, position by position."""
    from ..functions.vectors import l2_normalized

    rows = faces.select("id", l2_normalized(F.col("vec")).alias("u")).join(groups, "id")
    keys = ["grp", *KEYS, "dim"]
    parts = rows.select(*keys, F.posexplode("u").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("total"), F.max("n").alias("n"))


def centroid_merged(faces: DataFrame, groups: DataFrame, constraints: DataFrame | None, config: Config) -> DataFrame:
    """(id, grp): groups whose centroids are close are one.

    Greedy within each connected component of the graph of close centroids, so a group that is close to none never reaches a task, and
    components run in parallel. A merged centroid can come close to a group outside its component; rounds go on until none does. The
    result is that of one greedy pass over a whole space, unless such a newcomer would have come in before the component was done.
    """
    groups = written(groups, "groups")
    keys = [*KEYS, "dim"]
    current = written(unit_sums(faces, groups), "sums")
    if constraints is not None:
        a = groups.select(F.col("id").alias("face_a"), F.col("grp").alias("grp_a"), *keys)
        b = groups.select(F.col("id").alias("face_b"), F.col("grp").alias("grp_b"), *[F.col(k).alias(f"{k}_b") for k in keys])
        links = constraints.where("kind = 'cannotLink'").select("face_a", "face_b").join(a, "face_a").join(b, "face_b")
        links = written(links.where(" AND ".join(f"{k} = {k}_b" for k in keys)).select("grp_a", "grp_b").distinct(), "group-links")
    limits = {"human": config.threshold * MERGE_RATIO, "": config.pet_threshold * MERGE_RATIO}
    named = groups.select("id", "kind", "grp")
    empty = pd.DataFrame({"old": [], "new": []})

    def merge(pdf: pd.DataFrame, links: pd.DataFrame | None) -> pd.DataFrame:
        pdf = pdf.sort_values("grp", ignore_index=True)
        at = {v: k for k, v in enumerate(pdf["grp"].tolist())}
        cannot = [] if links is None else [(at[a], at[b]) for a, b in zip(links["grp_a"], links["grp_b"]) if a in at and b in at]
        limit = limits["human" if pdf["kind"].iat[0] == "human" else ""]
        labels = merge_by_centroid(np.stack(pdf["total"].tolist()), limit, cannot)
        return pd.DataFrame({"old": pdf["grp"], "new": pdf.groupby(labels)["grp"].transform("min")})

    while True:
        rows = current.select(*KEYS, F.col("grp").alias("id"), F.col("total").alias("vec"))
        edges = written(cosine_pairs(rows, max(limits.values()), keys=KEYS, spanning=limits).select("a", "b"), "close")
        if edges.isEmpty():
            return named
        found = components(edges)
        members = current.join(found.withColumnRenamed("id", "grp"), "grp")
        if constraints is None:
            moved = members.groupBy("component").applyInPandas(lambda pdf: merge(pdf, None), "old long, new long")
        else:
            own = links.join(found.toDF("grp_a", "component"), "grp_a")
            moved = members.groupBy("component").cogroup(own.groupBy("component")).applyInPandas(lambda p, q: merge(p, q) if len(p) else empty, "old long, new long")
        moved = written(moved.where("old <> new"), "moved")
        if moved.isEmpty():  # what is close is bound to differ
            return named
        to = moved.select(F.col("old").alias("grp"), "new")
        named = written(named.join(to, "grp", "left").select("id", "kind", F.coalesce("new", "grp").alias("grp")), "merged")
        # sums of what moved and of what it moved to, position by position
        touched = current.join(to, "grp", "left").join(moved.select(F.col("new").alias("grp"), F.lit(True).alias("into")).distinct(), "grp", "left")
        parts = touched.where("new IS NOT NULL OR into").select(F.coalesce("new", "grp").alias("grp"), *keys, "n", F.posexplode("total").alias("at", "x"))
        summed = parts.groupBy("grp", *keys, "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).groupBy("grp", *keys)
        summed = summed.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("total"), F.max("n").alias("n"))
        current = written(touched.where("new IS NULL AND into IS NULL").select(*summed.columns).unionByName(summed), "sums")
        if constraints is not None:
            x, y = to.toDF("grp_a", "new_a"), to.toDF("grp_b", "new_b")
            renamed = links.join(x, "grp_a", "left").join(y, "grp_b", "left")
            links = written(renamed.select(F.coalesce("new_a", "grp_a").alias("grp_a"), F.coalesce("new_b", "grp_b").alias("grp_b")).distinct(), "group-links")


def identities(faces: DataFrame, groups: DataFrame, persons: DataFrame, config: Config, next_id: int) -> DataFrame:
    """(id, person_id, grp, reused): faces of kept groups with their person.

    A group's candidate is the person most of its faces had, ties to the smaller id. The largest group takes it, of equals
    the one with the smallest face; other groups get new ids from ``next_id`` in that order. Groups under the least size have
    no person.
    """
    groups = written(groups, "merged")
    sizes = groups.groupBy("grp", "kind").agg(F.count("*").alias("n"))
    kept = sizes.where(F.col("n") >= F.when(F.col("kind") == "human", config.min_group).otherwise(1))
    votes = groups.join(faces.select("id", "person_id"), "id")
    top = majority(votes, "grp", "person_id").join(persons.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    claim = kept.join(top.select("grp", F.col("person_id").alias("wanted")), "grp", "left")
    first = claim.where("wanted IS NOT NULL").groupBy("wanted").agg(F.min(F.struct((-F.col("n")).alias("fewer"), "grp")).alias("first"))
    claim = claim.join(first.select(F.col("first.grp").alias("grp"), F.lit(True).alias("reused")), "grp", "left")
    claim = written(claim.withColumn("reused", F.coalesce("reused", F.lit(False))), "claims")
    new = numbered(claim.where(~F.col("reused")), [F.col("n").desc(), F.col("grp")], next_id, "person_id")
    named = claim.where("reused").select("grp", F.col("wanted").alias("person_id"), "reused").unionByName(new.select("grp", "person_id", "reused"))
    return groups.join(named, "grp", "left").select("id", "person_id", "grp", F.coalesce("reused", F.lit(False)).alias("reused"), "kind")


def recluster(faces: DataFrame, constraints: DataFrame, persons: DataFrame, config: Config = Config(), next_id: int = 1, large: int = LARGE) -> DataFrame:
    """The full pass: (id, person_id, grp, reused, kind) of all usable faces; a null person for dropped groups."""
    base = written(usable(faces), "usable")
    groups = centroid_merged(base, cluster(base, constraints, config, large), constraints, config)
    return identities(base, groups, persons, config, next_id)


def attach(new_faces: DataFrame, persons: DataFrame, config: Config = Config(), by_model: bool = False) -> DataFrame:
    """(id, person_id, best, runner_up) of the faces that clearly belong to a person: under the threshold, and nearer than any other by the margin."""
    p = persons.where(F.size("centroid") > 0).select("id", _as_key("kind"), "centroid", _as_key("model") if by_model else F.lit("").alias("model"))
    near = nearest_two(new_faces, p, by_model).join(new_faces.select("id", "kind"), "id")
    limit = threshold_of(F.col("kind"), config)
    clear = F.coalesce(F.col("runner_up"), F.lit(float("inf")))
    clear = F.when(F.isnan(clear), float("inf")).otherwise(clear)
    return near.where((F.col("best") < limit) & (clear - F.col("best") >= limit * MARGIN_RATIO)).select("id", "person_id", "best", "runner_up")


def assign_new(faces: DataFrame, persons: DataFrame, config: Config = Config(), next_id: int = 1, by_model: bool = False) -> DataFrame:
    """The incremental pass: (id, person_id, is_new) of faces without a person; those under the least size stay without.

    Assigned faces don't move and constraints don't apply; what is left over is grouped by itself, without centroid merges.
    """
    fresh = written(usable(faces).where(F.col("person_id").isNull()), "fresh")
    attached = written(attach(fresh, persons, config, by_model), "attached")
    rest = fresh.join(attached, "id", "left_anti")
    groups = written(cluster(rest, None, config), "leftover")
    sizes = groups.groupBy("grp", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(F.col("kind") == "human", config.min_group).otherwise(1))
    named = numbered(sizes, [F.col("n").desc(), F.col("grp")], next_id, "person_id").select("grp", "person_id")
    made = groups.join(named, "grp", "left").select("id", "person_id", F.col("person_id").isNotNull().alias("is_new"))
    return attached.select("id", "person_id", F.lit(False).alias("is_new")).unionByName(made)


def person_centroids(faces: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(person_id, centroid, n) of people with vectors, or of those in ``only`` (person_id)."""
    rows = faces.where(F.col("person_id").isNotNull() & (F.size("embedding") > 0)).select("id", "person_id", F.col("embedding").alias("vec"))
    if only is not None:
        rows = rows.join(only.select("person_id").distinct(), "person_id", "left_semi")
    return centroids(rows, ["person_id"])


def full_pass_due(n_persons: int, n_faces: int, limit: int = FULL_LIMIT) -> bool:
    return n_persons == 0 or n_faces <= limit
