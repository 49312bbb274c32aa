"""Grouping, review and constraints."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from kinlens.operators import clustering as C
from kinlens.operators import linkage as L
from kinlens.operators import review as R
from kinlens.operators import similarity as S
from kinlens.operators.graph import components
from kinlens.tables import empty, schema

HOT = np.eye(8)


def unit(k, jitter=0.0):
    v = HOT[k].copy()
    v[(k + 1) % 8] += jitter
    return v


def naive(v, t, must=(), cannot=()):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    d, n = 1 - v @ v.T, len(v)
    groups, barred, size, active = [[i] for i in range(n)], {frozenset(p) for p in cannot}, [1] * n, list(range(n))
    d = d.copy()
    blocked = lambda a, b: any(frozenset((x, y)) in barred for x in groups[a] for y in groups[b])

    def join(a, b):
        for k in active:
            if k not in (a, b):
                d[a, k] = d[k, a] = (size[a] * d[a, k] + size[b] * d[b, k]) / (size[a] + size[b])
        groups[a] += groups[b]
        size[a] += size[b]
        active.remove(b)

    for a, b in must:
        x, y = sorted(next(k for k in active if z in groups[k]) for z in (a, b))
        if x != y and not blocked(x, y):
            join(x, y)
    while True:
        pairs = [(d[i, j], i, j) for p, i in enumerate(active) for j in active[p + 1 :] if d[i, j] < t and not blocked(i, j)]
        if not pairs:
            break
        join(*min(pairs)[1:])
    out = np.zeros(n, int)
    for k, a in enumerate(active):
        out[groups[a]] = k
    return out


@given(st.integers(0, 10_000))
@settings(deadline=None, max_examples=80)
def test_average_linkage_is_naive(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 22))
    v = rng.normal(size=(4, 4))[rng.integers(0, 3, n)] + rng.normal(size=(n, 4)) * 0.5
    links = [[tuple(int(x) for x in rng.integers(0, n, 2)) for _ in range(rng.integers(0, 4))] for _ in range(2)]
    must, cannot = [[p for p in x if p[0] != p[1]] for x in links]
    got = C.average_linkage(v, 0.4, must, cannot)
    assert (got == naive(v, 0.4, must, cannot)).all()
    assert all(got[a] != got[b] for a, b in cannot)


def test_linkage_cases():
    three = np.array([unit(0), unit(0, 0.02), unit(1), unit(1, 0.01), unit(2), unit(2, 0.03)])
    assert C.average_linkage(three, 0.4).tolist() == [0, 0, 1, 1, 2, 2]
    pair = np.array([unit(0), unit(0, 0.01)])
    assert C.average_linkage(pair, 0.4, cannot=[(0, 1)]).tolist() == [0, 1]
    assert C.average_linkage(np.array([unit(0), unit(1)]), 0.4, must=[(0, 1)]).tolist() == [0, 0]
    assert C.average_linkage(np.array([unit(0), unit(1)]), 0.4, must=[(0, 1), (0, 9)], cannot=[(0, 1)]).tolist() == [0, 1]
    assert C.average_linkage(np.empty((0, 3)), 0.4).tolist() == []


def test_centroid_merge_cases():
    sums = np.array([[2.0, 0, 0, 0], [1.9, 0.3, 0, 0], [0, 0, 2.0, 0]])
    assert C.merge_by_centroid(sums, 0.3).tolist() == [0, 0, 1]
    assert C.merge_by_centroid(sums, 0.3, [(0, 1)]).tolist() == [0, 1, 2]
    # a merged centroid comes closer to a third group than either of its parts was
    a, b, c = [1.0, 0.6, 0], [1.0, -0.6, 0], [1.0, 0, 0.25]
    unit_ = [np.array(x) / np.linalg.norm(x) for x in (a, b, c)]
    assert 1 - unit_[0] @ unit_[2] > 0.1 > 1 - (unit_[0] + unit_[1]) / np.linalg.norm(unit_[0] + unit_[1]) @ unit_[2]


FACE = "id long, photo_id long, kind string, model string, embedding array<float>, person_id long"


def faces(spark, rows):
    full = [(i, i, kind, model, None if v is None else [float(x) for x in v], p) for i, v, kind, model, p in rows]
    df = spark.createDataFrame(full, FACE)
    e = empty(spark, "face")
    return e.unionByName(df, allowMissingColumns=True)


def people(spark, rows):
    return spark.createDataFrame([(i, name, None, False, None if c is None else [float(x) for x in c], n, kind, None, 0.0, 0.0) for i, name, c, n, kind in rows], schema("person"))


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["person_id"], set()).add(r["id"])
    return out


def test_min_group_kinds_and_dimensions(spark):
    rows = [(1, unit(0), None, "m", None), (2, unit(0, 0.02), None, "m", None), (3, unit(1), None, "m", None), (4, unit(0), "pet", "m", None), (5, np.ones(3), None, "m", None), (6, np.ones(3), None, "m", None), (7, [], None, "m", 9), (8, None, None, None, 9)]
    got = grouped(C.recluster(faces(spark, rows), empty(spark, "face_constraint"), people(spark, []), next_id=20))
    assert got == {20: {1, 2}, 21: {5, 6}, 22: {4}, None: {3}}


def test_ids_and_names_stay(spark):
    rows = [(1, unit(0), None, "m", 5), (2, unit(0, 0.02), None, "m", 5), (3, unit(1), None, "m", 6), (4, unit(1, 0.01), None, "m", 6), (5, unit(0, 0.03), None, "m", None), (6, unit(1, 0.02), None, "m", 77)]
    got = grouped(C.recluster(faces(spark, rows), empty(spark, "face_constraint"), people(spark, [(5, "Al", None, 2, None), (6, None, None, 2, None)]), next_id=20))
    assert got == {5: {1, 2, 5}, 6: {3, 4, 6}}


def test_a_person_is_claimed_once(spark):
    rows = [(i, unit(0, 0.01 * i), None, "m", 5) for i in range(1, 4)] + [(i, unit(2, 0.01 * i), None, "m", 5) for i in range(4, 6)]
    got = grouped(C.recluster(faces(spark, rows), empty(spark, "face_constraint"), people(spark, [(5, None, None, 5, None)]), next_id=20))
    assert got == {5: {1, 2, 3}, 20: {4, 5}}


def test_distributed_clustering_is_local(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(6, 6))[rng.integers(0, 6, 60)] + rng.normal(size=(60, 6)) * 0.35
    rows = [(i + 1, x, None, "m", None) for i, x in enumerate(v)]
    links = [(1, 3, 9, "mustLink", 0.0), (2, 4, 20, "cannotLink", 0.0), (3, 10, 11, "cannotLink", 0.0), (4, 12, 40, "mustLink", 0.0)]
    got = {r["id"]: r["grp"] for r in C.cluster(C.usable(faces(spark, rows)), spark.createDataFrame(links, schema("face_constraint")), C.Config()).collect()}
    labels = C.average_linkage(v, 0.4, [(2, 8), (11, 39)], [(3, 19), (9, 10)])
    expected = {i + 1: int(np.flatnonzero(labels == labels[i])[0]) + 1 for i in range(60)}
    assert got == expected


@pytest.mark.parametrize("seed", [0, 1])
def test_linkage_by_rounds_is_linkage(spark, seed):
    """Components that go by rounds, with must-links, cannot-links and conflicts of both, are grouped as one matrix groups them."""
    rng = np.random.default_rng(seed)
    rows, links = [], []
    for space, kind in enumerate(("human", "pet")):
        centres = rng.normal(size=(4, 6))
        v = centres[rng.integers(0, 4, 40)] + rng.normal(size=(40, 6)) * 0.75
        rows += [(100 * space + k, 1, kind, "m", 6, [float(x) for x in v[k]], None) for k in range(40)]
        for kind_, n in (("mustLink", 5), ("cannotLink", 8)):
            links += [(100 * space + int(a), 100 * space + int(b), kind_) for a, b in rng.integers(0, 40, (n, 2)) if a != b]
        links += [(100 * space + a, 100 * space + b, k) for a, b, k in ((30, 31, "mustLink"), (31, 32, "mustLink"), (30, 32, "cannotLink"), (32, 33, "mustLink"))]
    faces = spark.createDataFrame(rows, "id long, photo_id long, kind string, model string, dim int, vec array<double>, person_id long")
    constraints = spark.createDataFrame([(k, a, b, kind, 0.0) for k, (a, b, kind) in enumerate(links)], schema("face_constraint"))
    for given_ in (None, constraints):
        whole = {r["id"]: r["grp"] for r in C.cluster(faces, given_, C.Config()).collect()}
        rounds = {r["id"]: r["grp"] for r in C.cluster(faces, given_, C.Config(), large=3).collect()}
        assert rounds == whole and 2 < len(set(whole.values())) < 60


@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=8), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=5))
@settings(deadline=None, max_examples=200)
def test_must_links_hold_as_in_one_matrix(must, cannot):
    must, cannot = ([p for p in x if p[0] != p[1]] for x in (must, cannot))
    far = np.eye(8)
    whole = C.average_linkage(far, 0.1, must, cannot)
    place = list(range(8))
    for a, b in L.held_together(must, cannot):
        place = [place[a] if x == place[b] else x for x in place]
    assert [[place[i] == place[j] for j in range(8)] for i in range(8)] == [[bool(whole[i] == whole[j]) for j in range(8)] for i in range(8)]


def test_a_chain_by_rounds_holds_blocks(spark, monkeypatch):
    """A chained component: tasks hold a block of it, whatever its size, and the groups are those of one matrix."""
    n = 240
    angle = np.cumsum(np.random.default_rng(4).uniform(0.01, 0.09, n))
    v = np.stack([np.cos(angle), np.sin(angle)], 1)
    members = spark.createDataFrame([(0, k, "human", [float(x) for x in v[k]]) for k in range(n)], "component long, id long, kind string, vec array<double>")
    whole = C.average_linkage(v, 0.4)
    firsts = {label: int(np.flatnonzero(whole == label)[0]) for label in set(whole.tolist())}
    got = {r["id"]: r["grp"] for r in L.average_linkage_by_rounds(members, None, F.lit(0.4), block_rows=32).collect()}
    assert got == {k: firsts[int(whole[k])] for k in range(n)} and len(firsts) > 1


@pytest.mark.parametrize("block_rows", [None, 100])
def test_a_dense_component_takes_few_rounds(spark, monkeypatch, block_rows):
    """Three dense groups and faces between them are one component: it, or each part of it, goes through its rounds in one task, not in a job a round."""
    rng = np.random.default_rng(9)
    centres = np.eye(24)[:3]
    v = np.concatenate([c + rng.normal(0, 0.05, (60, 24)) for c in centres] + [(centres[[0, 1]] + centres[[1, 2]]) / 2])
    assert ((1 - (u := v / np.linalg.norm(v, axis=1, keepdims=True)) @ u.T) < 0.4)[-2:, :-2].sum() > 2
    searches, search = [], L.nearest_clusters
    monkeypatch.setattr(L, "nearest_clusters", lambda *a: searches.append(1) or search(*a))
    rows = [(k + 1, x, None, "m", None) for k, x in enumerate(v)]
    links = spark.createDataFrame([(1, 1, 100, "cannotLink", 0.0), (2, 5, 9, "cannotLink", 0.0), (3, 7, 8, "mustLink", 0.0)], schema("face_constraint"))
    own = {} if block_rows is None else {"block_rows": block_rows}
    got = {r["id"]: r["grp"] for r in C.cluster(C.usable(faces(spark, rows)), links, C.Config(), large=3, **own).collect()}
    labels = C.average_linkage(v, 0.4, [(6, 7)], [(0, 99), (4, 8)])
    assert got == {k + 1: int(np.flatnonzero(labels == labels[k])[0]) + 1 for k in range(len(v))} and len(searches) <= 3


def test_the_largest_group_claims_a_person(spark):
    groups = spark.createDataFrame([(k, "human", 10 if k < 13 else 20 if k < 15 else 30) for k in range(10, 18)], "id long, kind string, grp long")
    faces = spark.createDataFrame([(k, 7 if k < 17 else None) for k in range(10, 18)], "id long, person_id long")
    persons = spark.createDataFrame([(7,)], "id long")
    got = {r["grp"]: (r["person_id"], r["reused"]) for r in C.identities(faces, groups, persons, C.Config(), 100).collect()}
    assert got == {10: (7, True), 20: (101, False), 30: (100, False)}


def test_incremental(spark):
    rows = [(1, unit(0), None, "m", 5), (2, unit(0, 0.01), None, "m", None), (3, unit(1), None, "m", None), (4, unit(1, 0.01), None, "m", None), (5, unit(3), None, "m", None)]
    got = grouped(C.assign_new(faces(spark, rows), people(spark, [(5, None, unit(0), 1, None)]), next_id=20))
    assert got == {5: {2}, 20: {3, 4}, None: {5}}
    angle = lambda d: [np.cos(np.radians(d)), np.sin(np.radians(d))]
    ambiguous = C.attach(C.usable(faces(spark, [(9, angle(30), None, "m", None)])), people(spark, [(1, None, angle(0), 1, None), (2, None, angle(60), 1, None)]))
    assert ambiguous.count() == 0


@pytest.mark.parametrize("block", [3, 2048])
def test_cosine_pairs_are_brute_force(spark, block):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, "k" if i % 2 else None, x.tolist()) for i, x in enumerate(v)] + [(99, "k", [1.0])], "id long, kind string, vec array<double>")
    got = {(r["a"], r["b"]) for r in S.cosine_pairs(df, 0.5, block=block).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if i % 2 == j % 2 and 1 - u[i] @ u[j] < 0.5}


@pytest.mark.parametrize("limit", [64, 64 << 20])
def test_nearest_two_by_broadcast_and_by_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(4)
    f, p = rng.normal(size=(15, 3)), rng.normal(size=(7, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    got = {r["id"]: r for r in S.nearest_two(spark.createDataFrame([(i, "k", x.tolist()) for i, x in enumerate(f)], "id long, kind string, vec array<double>"), spark.createDataFrame([(i, "k", x.tolist()) for i, x in enumerate(p)], "id long, kind string, centroid array<double>")).collect()}
    d = 1 - f / np.linalg.norm(f, axis=1, keepdims=True) @ p.T
    for i in range(15):
        order = np.argsort(d[i])
        assert got[i]["person_id"] == order[0] and abs(got[i]["best"] - d[i][order[0]]) < 1e-9 and abs(got[i]["runner_up"] - d[i][order[1]]) < 1e-9


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=25))
@settings(deadline=None, max_examples=5)
def test_components_are_union_find(spark, edges):
    top = {i: i for e in edges if e[0] != e[1] for i in e}
    for _ in range(31):
        for a, b in edges:
            if a != b:
                top[a] = top[b] = min(top[a], top[b])
    assert {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == top


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["component"] for r in components(edges).collect()} == {0}


def test_hamming_bands_are_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), 1 << 63, 12)
    h = [int(x) for b in base for x in [b] + [b ^ np.int64(sum(1 << int(k) for k in rng.choice(62, n, replace=False))) for n in (1, 6, 7)]] + [0, -1]
    got = {(r["a"], r["b"]): r["distance"] for r in S.hamming_pairs(spark.createDataFrame([(x,) for x in h], "phash long")).collect()}
    bits = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    assert got == {(a, b): bits(a, b) for a in set(h) for b in set(h) if a < b and bits(a, b) <= 6}


# --- review


def scene(spark):
    rows = [(1, unit(0), None, "m", 1), (2, unit(0, 0.02), None, "m", 1), (3, unit(0, 0.2), None, "m", 2), (4, unit(4), None, "m", 3)]
    f = faces(spark, rows)
    p = people(spark, [(1, None, unit(0), 2, None), (2, "Bo", unit(0, 0.2), 1, None), (3, None, unit(4), 1, None)])
    return f, p, empty(spark, "face_constraint")


def test_suggestions_and_answers(spark):
    f, p, c = scene(spark)
    pairs = lambda c: [(r["person_a"], r["person_b"]) for r in R.suggest_merges(p, f, c, 0.2).collect()]
    assert pairs(c) == [(1, 2)]
    apart = R.confirm_different(p, f, c, 2, 1, 1.0, 1)["face_constraint"]
    assert [(r["face_a"], r["face_b"], r["kind"]) for r in apart.collect()] == [(1, 3, "cannotLink")] and pairs(apart) == []
    same = R.confirm_same(p, f, c, 1, 2, 1.0, 1)
    assert grouped(same["face"]) == {1: {1, 2, 3}, 3: {4}} and {r["id"]: r["face_count"] for r in same["person"].collect()} == {1: 3, 3: 1}
    assert [(r["face_a"], r["face_b"], r["kind"]) for r in same["face_constraint"].collect()] == [(1, 3, "mustLink")]
    merged = R.merge_people(p, f, c, 1, 2, 1.0, 1)["person"]
    assert {r["id"]: r["display_name"] for r in merged.collect()} == {1: "Bo", 3: None}
    assert R.confirm_same(p, f, c, 1, 1, 1.0, 1) == {}
    skipped = spark.createDataFrame([(2, 1)], "person_a long, person_b long")
    assert R.next_pair(R.suggest_merges(p, f, c, 0.2), skipped).count() == 0


def test_not_this_person(spark):
    rows = [(i, unit(0), None, "m", 1) for i in range(1, 5)]
    f, p = faces(spark, rows), people(spark, [(1, "Al", unit(0), 4, None)])
    p = p.withColumn("cover_face_id", p.id + 1)
    changes, n = R.mark_not_person(p, f, empty(spark, "face_constraint"), [2, 3, 4], 1, 1.0, 50, 1)
    assert n == 3 and grouped(changes["face"]) == {1: {1}, 50: {2, 3, 4}}
    assert {r["id"]: (r["face_count"], r["cover_face_id"]) for r in changes["person"].collect()} == {1: (1, None), 50: (3, None)}
    assert {(r["face_a"], r["face_b"]) for r in changes["face_constraint"].collect()} == {(1, 2), (1, 3), (1, 4)}
    none, n = R.mark_not_person(p, f, empty(spark, "face_constraint"), [1, 2, 3, 4], 1, 1.0, 50, 1)
    assert n == 4 and "face_constraint" not in none and [r["id"] for r in none["person"].collect()] == [50]
    assert R.mark_not_person(p, f, empty(spark, "face_constraint"), [77], 1, 1.0, 50, 1) == ({}, 0)


def test_constraints_are_unordered(spark):
    c = empty(spark, "face_constraint")
    new = spark.createDataFrame([(2, 1, "mustLink"), (1, 2, "mustLink"), (1, 2, "cannotLink"), (3, 3, "mustLink")], "face_a long, face_b long, kind string")
    once = R.with_constraints(c, new, 1, 5.0)
    twice = R.with_constraints(once, new, 9, 6.0)
    assert sorted((r["face_a"], r["face_b"], r["kind"], r["created_at"]) for r in twice.collect()) == [(1, 2, "cannotLink", 5.0), (1, 2, "mustLink", 5.0)]


@pytest.mark.parametrize("equal", [1, 2, 3, 4])
def test_hamming_keys_are_exact(spark, monkeypatch, equal):
    """Any number of equal blocks in a key finds all pairs, once."""
    from kinlens.operators import similarity as S

    monkeypatch.setattr(S, "hamming_keys", lambda n, most: (most + equal, equal))
    rng = np.random.default_rng(8)
    hashes = {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 40)} | {0, -1, 1, -(1 << 63)}
    for h in list(hashes):
        for k in (1, 3, 6, 7):
            for _ in range(2):
                x = h & (1 << 64) - 1
                for bit in rng.choice(64, k, replace=False):
                    x ^= 1 << int(bit)
                hashes.add(x - (1 << 64) if x >> 63 else x)
    every = sorted(hashes)
    far = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    brute = {(a, b, far(a, b)) for i, a in enumerate(every) for b in every[i + 1 :] if far(a, b) <= 6}
    got = [tuple(r) for r in S.hamming_pairs(spark.createDataFrame([(h,) for h in every], "phash long")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute and len(brute) > 200


def test_spanning_links_connect_what_all_links_connect(spark):
    from kinlens.operators.graph import components
    from kinlens.operators.similarity import cosine_pairs

    rng = np.random.default_rng(4)
    rows = [(k, "human" if k % 3 else "pet", [float(x) for x in rng.normal(size=3)]) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, kind string, vec array<double>")
    limits = {"human": 0.05, "": 0.1}
    every = cosine_pairs(df, 0.1, block=40).where("distance < CASE WHEN kind = 'human' THEN 0.05 ELSE 0.1 END")
    some = cosine_pairs(df, 0.1, block=40, spanning=limits)
    found = lambda pairs: {tuple(r) for r in components(pairs.select("a", "b")).collect()}
    assert found(every) == found(some) and some.join(every, ["a", "b"], "left_anti").isEmpty()


def test_nearest_two_beyond_the_broadcast(spark, monkeypatch):
    from kinlens.operators import similarity as S

    rng = np.random.default_rng(5)
    faces = spark.createDataFrame([(k, "human", [float(x) for x in rng.normal(size=4)]) for k in range(90)], "id long, kind string, vec array<double>")
    persons = spark.createDataFrame([(k, "human", [float(x) for x in rng.normal(size=4)]) for k in range(20)], "id long, kind string, centroid array<double>")
    whole = sorted((r["id"], r["person_id"], round(r["best"], 9), round(r["runner_up"], 9)) for r in S.nearest_two(faces, persons).collect())
    monkeypatch.setattr(S, "BROADCAST_BYTES", 400)
    monkeypatch.setattr(S, "FACES", 10)
    assert sorted((r["id"], r["person_id"], round(r["best"], 9), round(r["runner_up"], 9)) for r in S.nearest_two(faces, persons).collect()) == whole


@pytest.mark.parametrize("bound", [False, True])
def test_distributed_centroid_merges_are_the_greedy_ones(spark, bound):
    """Groups in clumps whose centroids close: the result of one greedy pass over each space, cannot-links included."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(12)
    rows, groups = [], []
    k = 0
    for clump in range(8):
        base = rng.normal(size=16)
        for g in range(6):
            first = k
            for _ in range(int(rng.integers(1, 4))):
                v = base + 0.35 * rng.normal(size=16)
                rows.append((k, "pet" if clump % 4 == 3 else "human", "m", 16, [float(x) for x in v]))
                groups.append((k, rows[-1][1], "m", 16, first))
                k += 1
    faces = spark.createDataFrame(rows, "id long, kind string, model string, dim int, vec array<double>")
    grouped = spark.createDataFrame(groups, "id long, kind string, model string, dim int, grp long")
    firsts = sorted({g[4] for g in groups})
    pairs = [(a, b) for a, b in zip(firsts, firsts[1:]) if a % 2] if bound else []
    links = spark.createDataFrame([(i, a, b, "cannotLink", 0.0) for i, (a, b) in enumerate(pairs)], "id long, face_a long, face_b long, kind string, created_at double") if bound else None
    got = {r["id"]: r["grp"] for r in C.centroid_merged(faces, grouped, links, C.Config()).collect()}
    expected = {}
    for kind, limit in (("human", C.THRESHOLD), ("pet", C.PET_THRESHOLD)):
        own = [g for g in firsts if next(x[1] for x in groups if x[4] == g) == kind]
        at = {g: i for i, g in enumerate(own)}
        unit = lambda v: np.array(v) / np.linalg.norm(v)
        sums = np.array([sum(unit(r[4]) for r, x in zip(rows, groups) if x[4] == g) for g in own])
        labels = C.merge_by_centroid(sums, limit * C.MERGE_RATIO, [(at[a], at[b]) for a, b in pairs if a in at and b in at])
        lead = {}
        for g, label in zip(own, labels.tolist()):
            lead.setdefault(label, g)
        expected |= {x[0]: lead[labels[at[x[4]]]] for x in groups if x[4] in at}
    assert got == expected and len(set(got.values())) < len(firsts)
