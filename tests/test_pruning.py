"""Blocks of vectors that can't hold a near pair never meet, and no near pair is lost by it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlens.operators import similarity as S


def rows_of(spark, vectors, kinds=None):
    return spark.createDataFrame([(k, "human" if kinds is None else kinds[k], [float(x) for x in v]) for k, v in enumerate(vectors)], "id long, kind string, vec array<double>")


def clustered(rng, clusters, each, dim, spread):
    centres = rng.normal(size=(clusters, dim))
    return np.concatenate([c / np.linalg.norm(c) + rng.normal(0, spread, (each, dim)) for c in centres])


def brute(vectors, kinds, limit, inclusive):
    m = np.asarray(vectors, float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.where(n > 1e-12, m / np.maximum(n, 1e-300), m)
    d = 1 - m @ m.T
    keep = d <= limit if inclusive else d < limit
    return {(i, j) for i, j in zip(*np.nonzero(np.triu(keep, 1))) if kinds[i] == kinds[j]}


@pytest.mark.parametrize(("shape", "limit", "inclusive"), [("random", 0.6, False), ("clusters", 0.3, False), ("line", 0.02, True), ("odd", 1.0, True), ("odd", 2.0, True), ("copies", 0.0, True)])
def test_pairs_are_all_there(spark, shape, limit, inclusive):
    rng = np.random.default_rng(len(shape) + int(100 * limit))
    if shape == "random":
        v = rng.normal(size=(240, 6))
    elif shape == "clusters":
        v = clustered(rng, 6, 50, 24, 0.05)
    elif shape == "line":  # a chain around the circle: every cell has neighbours
        t = np.linspace(0, 2 * np.pi, 300, endpoint=False)
        v = np.stack([np.cos(t), np.sin(t)], 1)
    elif shape == "copies":  # powers of two, so that copies have a distance of exactly nothing
        v = np.eye(4)[rng.integers(0, 4, 120)] * 2.0 ** rng.integers(0, 5, (120, 1))
    else:  # no direction, opposite ones, and lengths far apart
        v = np.concatenate([rng.normal(size=(100, 4)), np.zeros((3, 4)), -np.eye(4), 1e9 * np.eye(4)])
    kinds = np.where(rng.random(len(v)) < 0.8, "human", "pet")
    got = [(r["a"], r["b"]) for r in S.cosine_pairs(rows_of(spark, v, [str(k) for k in kinds]), limit, inclusive, block=16).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(v, kinds, limit, inclusive)


def work(df, limit, block):
    """Rows times rows of all products."""
    base = df.withColumn("dim", F.size("vec"))
    met = S.blocks_that_meet(base, ["kind", "dim"], limit, block).groupBy("kind", "i", "j").agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("q"))
    return met.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("p") * F.col("p")).otherwise(F.col("p") * F.col("q")))).first()[0]


def test_far_blocks_never_meet(spark):
    rng = np.random.default_rng(8)
    v = clustered(rng, 30, 60, 64, 0.02)
    n = len(v)
    assert work(rows_of(spark, v), 0.2, 40) * 10 <= n * n / 2
    assert work(rows_of(spark, rng.normal(size=(400, 64))), 0.9, 40) >= 400 * 400 / 2  # nothing to prune where all are alike


def test_lengths_and_null_vectors(spark):
    rows = [(k, None, [1.0, float(k % 3)]) for k in range(30)] + [(100 + k, None, [1.0, 0.0, float(k % 3)]) for k in range(30)] + [(200, "x", None), (201, "x", []), (202, "x", [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, kind string, vec array<double>")
    got = {(r["a"], r["b"]) for r in S.cosine_pairs(df, 1e-9, block=8).collect()}
    assert got == {(i, j) for i in range(30) for j in range(i + 1, 30) if i % 3 == j % 3} | {(100 + i, 100 + j) for i in range(30) for j in range(i + 1, 30) if i % 3 == j % 3}
    assert S.cosine_pairs(df.limit(0), 0.5).isEmpty()


@pytest.mark.parametrize("n", [600, 1200])
def test_copies_of_a_row_do_not_grow_with_the_rows(spark, n):
    v = np.random.default_rng(3).normal(size=(n, 8))
    base = rows_of(spark, v).withColumn("dim", F.size("vec"))
    assert S.blocks_that_meet(base, ["kind", "dim"], 1.9, 4).count() <= S.COPIES * n


def test_a_task_streams_its_blocks(spark, monkeypatch):
    """Pieces of a few rows against blocks of many: all pairs once, and links that connect what all pairs connect, fewer than the rows of each pair of blocks."""
    monkeypatch.setattr(S, "TILE", 1)
    rng = np.random.default_rng(6)
    v = clustered(rng, 5, 80, 12, 0.04)
    kinds = ["human"] * len(v)
    df = rows_of(spark, v)
    got = [(r["a"], r["b"]) for r in S.cosine_pairs(df, 0.3, block=150).collect()]
    want = brute(v, kinds, 0.3, False)
    assert len(got) == len(want) and set(got) == want
    links = [(r["a"], r["b"]) for r in S.cosine_pairs(df, 0.3, spanning={"": 0.3}).collect()]
    assert len(links) == len(v) - 5 and set(links) <= want


@pytest.mark.parametrize("each", [40, 80])
def test_planes_between_pivots_keep_spread_clusters_apart(spark, each):
    """Clusters whose rows are as far from their pivots as a pair may be from each other: no row goes to more than a few blocks, and no pair is lost."""
    rng = np.random.default_rng(12)
    v = clustered(rng, 20, each, 64, 0.05)
    v[:3] = [np.zeros(64), np.full(64, np.inf), np.eye(64)[0] * 1e-200]
    kinds = ["human"] * len(v)
    df = rows_of(spark, v, kinds)
    base = df.withColumn("dim", F.size("vec"))
    # those without a direction meet every block, so they are left out here
    assert S.blocks_that_meet(base.where("id > 2"), ["kind", "dim"], 0.4, 16).count() <= 6 * len(v)
    got = [(r["a"], r["b"]) for r in S.cosine_pairs(df.where("id <> 1"), 0.4, block=16).select("a", "b").collect()]
    want = {(a, b) for a, b in brute(np.where(np.isinf(v), 0, v), kinds, 0.4, False) if 1 not in (a, b)}
    assert len(got) == len(want) and set(got) == want


def test_pivots_that_coincide_or_lie_outside_keep_all_pairs(spark, monkeypatch):
    """Planes are bounds whatever the pivots are."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(200, 5))
    m = rng.normal(size=(6, 5))
    m[3] = m[2] * (1 + 1e-9)
    monkeypatch.setattr(S, "_pivots", lambda base, large: {5: m / np.linalg.norm(m, axis=1, keepdims=True)})
    got = [(r["a"], r["b"]) for r in S.cosine_pairs(rows_of(spark, v), 0.1, block=8).select("a", "b").collect()]
    want = brute(v, ["human"] * len(v), 0.1, False)
    assert len(got) == len(want) and set(got) == want
