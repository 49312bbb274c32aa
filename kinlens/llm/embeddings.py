"""Near-duplicate vectors by cross-polytope hashing.

A vector is flipped by random signs and turned by a fast Hadamard transform, three times; the coordinate of largest magnitude, with its sign, is a
vertex of the cross-polytope. A bucket is the vertices of several rotations together, of so many that unrelated vectors seldom share
one. In every table a vector is in its own bucket and in the next likely ones, where a vertex is another of its largest coordinates (multiprobe); vectors
that share any bucket are candidates, and are verified by their cosine in double precision. A pair at a cosine of 0.98 shares a bucket of a table with
a probability of 0.95 or more, so four tables miss it in one of 100,000 cases or less; nearer pairs are missed less.

Equal vectors of a label are one class from the start, with a count. Buckets of one class are dropped before vectors are shuffled. A bucket of
more than BLOCK classes is compared in pairs of blocks, each of which is a group of its own, so a task holds two blocks however many vectors
a bucket has; S classes of a bucket cost S * S / BLOCK rows, which the number of a vector's links asks for, as each pair has to be told. A pair counts at the
first bucket that it shares; a group yields sums a vector, and for components as few links as connect what it links, not its pairs.

Defined results: vectors that are null, zero or hold null or non-finite components, or whose label is null, link with nothing; vectors of other
lengths, too; rows of one id are one vector (of several that can be used, the smallest by label, then components); a null id is one row, linked with
nothing, and its component is null; very long vectors are padded to a power of two for the transform alone; an empty table gives no rows; other columns are
left behind.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import map_batches, mix64, written
from .neardup import in_groups

COSINE = 0.98
TABLES = 4
#: Rotations of a bucket at least and at most, and the classes of a label that share a bucket by chance from which more are taken.
LEAST_ROTATIONS, MOST_ROTATIONS, CHANCE = 2, 6, 0.25
#: Coordinates of a rotation that probes choose from.
TOP = 3
#: Classes of a bucket that are held against each other in one place.
BLOCK = 1024
#: Vectors that are turned at once.
TURNED = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows (a power of two of columns), in log2 passes."""
    width = x.shape[1]
    h = 1
    while h < width:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), width)
        h *= 2
    return x / np.sqrt(width)


def buckets(vectors: np.ndarray, rotations: int, tables: int = TABLES, seed: int = 0) -> np.ndarray:
    """Keys (rows, tables * probes) of the buckets of rows: in every table 2 ** rotations buckets, of the largest coordinates."""
    n, dim = vectors.shape
    width = 1 << max(1, (dim - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :dim] = vectors
    x /= np.linalg.norm(x, axis=1)[:, None]
    top, probes = min(TOP, width), 1 << rotations
    choices = np.array(list(itertools.product(range(top), repeat=rotations)))
    probes = min(probes, len(choices))
    rng, out = np.random.default_rng([seed, width]), []
    for t in range(tables):
        penalty, vertices = np.zeros((n, len(choices))), []
        for r in range(rotations):
            w = x
            for _ in range(3):
                w = hadamard(w * rng.choice([-1.0, 1.0], width))
            size = np.abs(w)
            order = np.argsort(-size, axis=1, kind="stable")[:, :top]
            largest = np.take_along_axis(size, order, 1)
            vertices.append(order.astype(np.uint64) * np.uint64(2) + (np.take_along_axis(w, order, 1) > 0))
            penalty += ((largest[:, :1] - largest) ** 2)[:, choices[:, r]]
        taken = np.argsort(penalty, axis=1, kind="stable")[:, :probes]
        key = np.full((n, probes), (t + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for r in range(rotations):
            key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + np.take_along_axis(vertices[r], choices[taken, r], 1) + np.uint64(1))
        out.append(key)
    return np.concatenate(out, 1)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotations_for(classes: DataFrame) -> int:
    """So many rotations that unrelated classes seldom share a bucket, by the label and length with most classes."""
    each = classes.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    sums = each.groupBy("dim").agg(F.max("n").alias("n")).collect()  # a row for each length of vectors
    enough = LEAST_ROTATIONS
    for s in sums:
        width = 1 << max(1, (s.dim - 1).bit_length())
        while enough < MOST_ROTATIONS and s.n * 2**enough / (2 * width) ** enough > CHANCE:
            enough += 1
    return enough


def hashed(classes: DataFrame, rotations: int, tables: int = TABLES) -> DataFrame:
    """(id, w, vector, keys) of classes: the vector as doubles scaled by a power of two, and its keys, both binary."""

    def run(batches):
        for b in batches:
            by: dict[int, list[int]] = {}
            for k, v in enumerate(b["vector"]):
                by.setdefault(len(v), []).append(k)
            for dim, rows in by.items():
                for s in range(0, len(rows), TURNED):
                    at = rows[s : s + TURNED]
                    v = np.array([b["vector"][k] for k in at], np.float64)
                    v /= np.exp2(np.frexp(np.abs(v).max(1))[1].astype(float) - 1)[:, None]  # changes no digit, and squares can't overflow
                    own = mix64(np.array([b["label"][k] for k in at], np.int64).view(np.uint64) + np.uint64(dim) * np.uint64(0xA0761D6478BD642F))
                    keys = np.sort(mix64(buckets(v, rotations, tables) ^ own[:, None]), 1)
                    yield {"id": [b["id"][k] for k in at], "w": [b["w"][k] for k in at], "vector": [x.astype("<f8").tobytes() for x in v], "keys": [x.astype("<u8").tobytes() for x in keys]}

    return map_batches(classes.select("id", "label", "w", "vector"), run, "id long, w long, vector binary, keys binary")


def _exploded(rows: DataFrame) -> DataFrame:
    """(key, id) for each bucket of a class."""

    def run(batches):
        for b in batches:
            keys = [np.frombuffer(x, "<i8") for x in b["keys"]]
            yield {"key": np.concatenate(keys).tolist(), "id": np.repeat(np.array(b["id"], np.int64), [len(x) for x in keys]).tolist()}

    return map_batches(rows.select("id", "keys"), run, "key long, id long")


def in_pairs_of_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (key, id, size, ...) in groups (key, i, j) of two blocks i <= j of a bucket, or one with itself; ``side`` tells them apart."""
    count = F.ceil(F.col("size") / block).cast("int")
    rows = rows.withColumn("blocks", count).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = {"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}
    return dealt.withColumns(at).drop("own", "other", "blocks", "size")


def _links(group: dict[str, list], cosine: float) -> dict[str, list]:
    """Of a group: (a, null, n) with the number of vectors that a pair of its own first counts here for, and (a, b, 0) of links that connect what is linked."""
    out: dict[str, list] = {"a": [], "b": [], "n": []}
    ids, w, key = np.array(group["id"], np.int64), np.array(group["w"], np.int64), np.int64(group["key"][0]).view(np.uint64)
    side, within = np.array(group["side"]), group["i"][0] == group["j"][0]
    v = np.frombuffer(b"".join(group["vector"]), "<f8").reshape(len(ids), -1) if len({len(x) for x in group["vector"]}) == 1 else None
    if v is None or len(ids) < 2:  # a chance meeting of lengths
        return out
    keys = np.frombuffer(b"".join(group["keys"]), "<u8").reshape(len(ids), -1)
    earlier = np.where(keys < key, keys, np.uint64(0))
    norm = np.linalg.norm(v, axis=1)
    total, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for k in range(len(ids) - 1):
        if not within and side[k]:
            continue
        others = np.arange(k + 1, len(ids)) if within else np.flatnonzero(side)
        at = others[(v[others] @ v[k]) / (norm[others] * norm[k]) >= cosine]
        if not len(at):
            continue
        roots = {root(x): x for x in np.unique(parent[at]).tolist()}
        for r, x in roots.items():
            if r != root(k):
                out["a"].append(int(ids[k]))
                out["b"].append(int(ids[x]))
                out["n"].append(0)
                parent[r] = root(k)
        mine = keys[k][keys[k] < key]
        if len(mine):
            e = earlier[at]
            place = np.minimum(np.searchsorted(mine, e), len(mine) - 1)
            at = at[~((mine[place] == e) & (e > 0)).any(1)]
        np.add.at(total, at, w[k])
        total[k] += w[at].sum()
    some = np.flatnonzero(total)
    out["a"] += ids[some].tolist()
    out["b"] += [None] * len(some)
    out["n"] += total[some].tolist()
    return out


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one a vector: how many other vectors link with it directly, and the smallest id that links reach."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), v.alias("vector"))
    fit = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    one = rows.groupBy("vec_id").agg(F.min(F.when(fit, F.struct("label", "vector"))).alias("of"))
    twin = F.sha2(F.concat_ws(",", F.col("of.label").cast("string"), F.transform("of.vector", lambda x: x.cast("string"))), 256)
    one = written(one.withColumn("twin", F.when(F.col("of").isNotNull(), twin)), "vectors")
    classes = one.where("twin IS NOT NULL").groupBy("twin").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("of").alias("of"))
    classes = written(classes.select("twin", "id", "w", "of.label", "of.vector"), "classes")
    rows = written(hashed(classes, rotations_for(classes), tables), "hashed")
    keys = _exploded(rows)
    counts = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = keys.hint("merge").join(counts, "key").hint("merge").join(rows, "id")
    found = written(in_groups(in_pairs_of_blocks(shared, block), partial(_links, cosine=cosine), "a long, b long, n long"), "links")
    sums = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    reached = components(found.where("b IS NOT NULL"))
    named = classes.select("twin", "id", "w").join(sums, "id", "left").join(reached, "id", "left")
    # a class can hold a third of all rows; the join deals such a class out in pieces
    out = one.select("vec_id", "twin").hint("merge").join(named, "twin", "left")
    component = F.coalesce("component", "id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("w") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


#: DuckDB SQL of the query's rows: all pairs of a label.
SQL = rf"""
WITH RECURSIVE o AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS v, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS s FROM embeddings),
u AS (SELECT * FROM o WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND s > 0 AND isfinite(s) AND len(list_filter(v, lambda x: x IS NULL)) = 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= {COSINE}),
n AS (SELECT a, count(DISTINCT b) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS id, vec_id AS reached FROM o UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT DISTINCT o.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, coalesce(o.vec_id = c.component_id, true) AS kept
FROM o LEFT JOIN n ON n.a = o.vec_id LEFT JOIN c ON c.id IS NOT DISTINCT FROM o.vec_id
"""
