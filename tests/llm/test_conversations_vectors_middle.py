"""Conversation repair, embedding near-duplicates and fill-in-middle against brute force, round trips and SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlens.llm import embeddings, middle, registry, repair
from tests.conftest import duck, same_rows

TURNS = "conv_id long, turn long, role string, text string"


# ---- conversation repair


def cheapest(initials, faults):
    """(cost, audit) of the best of all edit lists."""
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    give = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, q, inserted):
        out = [(0, "")] if i == len(initials) and q in ("", "a") else []
        if inserted < 3:
            out += [(c + 2, "I" + w) for c, w in best(i, give[q], inserted + 1)]
        if i < len(initials):
            out += [(c + 3, "D" + w) for c, w in best(i + 1, q, 0)]
            if faults[i] not in ("blank", "duplicate"):
                more = int(faults[i] == "truncated")
                out += [(c + 2 + more, "R" + w) for c, w in best(i + 1, give[q], 0)]
                if (q, initials[i]) in move:
                    out += [(c + more, "K" + w) for c, w in best(i + 1, move[q, initials[i]], 0)]
        return tuple([min(out)]) if out else ()

    return best(0, "", 0)[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suat"), st.sampled_from(["", "", "blank", "duplicate", "truncated"])), max_size=9))
def test_search_is_the_best_of_all_edits(rows):
    initials, faults = "".join(r[0] for r in rows), [r[1] for r in rows]
    assert list(repair.search(initials, faults, 0, True).values()) == [cheapest(initials, faults)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suat"), st.sampled_from(["", "blank", "truncated"])), min_size=2, max_size=14), st.integers(1, 4))
def test_sections_are_the_whole_search(rows, size):
    initials, faults = "".join(r[0] for r in rows), [r[1] for r in rows]
    cuts = range(0, len(rows), size)
    ways, audits = [], {}
    for k, at in enumerate(cuts):
        for p in repair.STATES:
            found = repair.search(initials[at : at + size], faults[at : at + size], p, k == len(cuts) - 1)
            for place, q in enumerate(sorted(found, key=lambda q: found[q][1])):
                ways.append({"section": k, "entry": p, "exit": q, "cost": found[q][0], "place": place})
                audits[k, p, q] = found[q][1]
    assert "".join(audits[step] for step in repair._route(ways)) == cheapest(initials, faults)[1]


def repaired_by_hand(rows):
    """Rows of the contract from (conv_id, turn, role, text), one step after the other."""
    blank = lambda t: not re.search(r"[^\x20\x09-\x0D]", t)
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in found:
            ended = text.rstrip(" \t\n\x0b\f\r")[-1:] in (".", "!", "?")
            faults.append("blank" if blank(text) else "duplicate" if (role, text) in seen else "" if ended else "truncated")
            seen.add((role, text))
        initials = "".join((r[1] or "?")[0] for r in found)
        cost, audit = cheapest(initials, faults)
        left, k, q = [], 0, ""
        for e in audit:
            give = "assistant" if q == "u" else "user"
            if e == "I":
                left.append((give, ""))
            elif e != "D":
                left.append((found[k][1] if e == "K" else give, found[k][2]))
            if e != "D":
                q = left[-1][0][0]
            k += e != "I"
        turns = [r[0] for r in found if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        out.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0))


def shown(df):
    names = [x.split()[0] for x in repair.SUMMARY.split(", ")]
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=lambda r: (r[0] is None, r[0] or 0))


def test_repair_query_is_brute_force(spark, small):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    assert shown(registry.op11_conversation_repair(spark, small)) == repaired_by_hand(rows)


def odd_turns():
    rng = random.Random(3)
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["a b.", "a b", "", " \t", None, "What? ", "é!\n", "x" * 30])) for c in [*range(40), None] for _ in range(rng.randrange(1, 14))]
    return rows + rows[:15]


@pytest.mark.parametrize("section", [3, 512])
def test_repair_of_odd_turns_in_sections(spark, section):
    rows = odd_turns()
    turns = spark.createDataFrame(rows, TURNS)
    assert shown(repair.repaired(repair.damaged(turns), turns, section)) == repaired_by_hand(rows)


def test_repair_bounds_sections_by_bytes(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"{k} " + "x" * 3000 + ".") for k in range(20)] + [(2, 0, "user", "y" * 50_000)]
    turns = spark.createDataFrame(rows, TURNS)
    log, several = repair.edits(turns, section_bytes=7000)
    assert several
    sizes = log.groupBy("conv_id", "section").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("bytes")).collect()
    assert max(r.n for r in sizes if r.conv_id == 1) == 2 and len(sizes) == 11
    assert [r[7] for r in shown(repair.summaries(log, several))] == ["K" * 20, "D"]


def test_repair_log_has_the_repaired_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "user", ""), (1, 3, "assistant", "Yes")], TURNS)
    log, _ = repair.edits(turns)
    rows = [(r.edit, r.fault, r.was, r.role, r.text, r.cost) for r in log.orderBy("section", "step").collect()]
    assert "".join(r[0] for r in rows) == cheapest("uuua", ["", "", "blank", "truncated"])[1]
    assert [r[3] for r in rows if r[0] != "D"] == ["user", "assistant"] * (sum(r[0] != "D" for r in rows) // 2)
    assert sum(r[5] for r in rows) == cheapest("uuua", ["", "", "blank", "truncated"])[0]


def test_repair_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.repaired(repair.damaged(empty), empty).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "x")], TURNS)
    assert shown(repair.repaired(repair.damaged(one), one)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# ---- embedding near-duplicates

VECTORS = "vec_id long, embedding array<double>, label int"


def by_pairs(rows, cosine=0.98):
    """Rows of the contract by all pairs."""
    of = {}
    for i, v, label in rows:
        fit = i is not None and label is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
        of[i] = min([x for x in (of.get(i), (label, list(v)) if fit else None) if x is not None], default=None)
    of.pop(None, None)
    links = {i: set() for i in of}
    usable = [(i, x[0], np.array(x[1], float) / max(map(abs, x[1]))) for i, x in of.items() if x]
    for k, (i, label, v) in enumerate(usable):
        for j, other, u in usable[k + 1 :]:
            if label == other and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in of:
        reached, new = {i}, [i]
        while new:
            new = [b for a in new for b in links[a] if b not in reached and not reached.add(b)]
        out.append((i, len(links[i]), min(reached), min(reached) == i))
    return sorted(out)


def families(rng, dim=64):
    """Groups of near copies around the threshold, of very different sizes, and unrelated vectors."""
    rows = []
    for size in (1,) * 150 + (2,) * 30 + (5, 12, 90):
        centre = rng.normal(size=dim)
        for _ in range(size):
            rows.append((centre + rng.normal(size=dim) * rng.choice([0, 0.05, 0.1, 0.13])).tolist())
    return [(i, v, int(rng.integers(0, 2))) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [16, 1024])
@pytest.mark.parametrize("dim", [64, 24])
def test_vectors_are_brute_force(spark, block, dim):
    rows = families(np.random.default_rng(dim), dim)
    rows += [(1000 + k, [1e200 * x for x in rows[-1 - k][1]], rows[-1 - k][2]) for k in range(3)]
    rows += [(2000 + k, rows[k][1], rows[k][2]) for k in range(40)] * 2  # copies, and repeated rows
    odd = [(None, rows[0][1], 1), (3000, None, 0), (3001, [0.0] * dim, 0), (3002, [float("nan")] * dim, 0), (3003, [None] * dim, 0), (3004, rows[0][1], None), (3005, [], 0), (3006, [1.0], 0), (3007, [2.0], 0), (3008, [float("inf")] * dim, 0)]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows + odd, VECTORS), block=block).collect()
    assert sorted(tuple(r) for r in got if r.vec_id is not None) == by_pairs(rows + odd)
    assert [tuple(r) for r in got if r.vec_id is None] == [(None, 0, None, True)]


def test_buckets_find_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1)[:, None] * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * g / np.linalg.norm(g, axis=1)[:, None]
    for rotations in range(embeddings.LEAST_ROTATIONS, embeddings.MOST_ROTATIONS + 1):
        shared = np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(embeddings.buckets(x, rotations), embeddings.buckets(y, rotations))])
        assert shared >= 0.999


def test_hadamard_keeps_angles():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(embeddings.hadamard(x) @ embeddings.hadamard(x).T, x @ x.T)
    assert np.allclose(embeddings.hadamard(np.eye(2)) * np.sqrt(2), [[1, 1], [1, -1]])


# ---- fill-in-middle


def by_hand(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_middle_is_by_hand(spark):
    rng = random.Random(5)
    texts = [None, "", "a", "<P", "x<S>y", "<M>", "\r\n\n", "👩‍👩‍👧 é́", "<" * 50, "<<P><S"] + ["".join(rng.choices("ab <PSM>\né日\U0001f600", k=rng.randrange(400))) for _ in range(300)] + ["é\U0001f600z" * 300_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "of no id"), (3, "<P"), (3, "<P")]
    made = middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", middle.restored(F.col("output"), F.col("form")).alias("again")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted([tuple(r) for r in got], key=key) == sorted([(i, *by_hand(i, t), t or "") for i, t in rows], key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit, find", [("char", r"(?s:.)"), ("word", r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_offsets_of_units(unit, find):
    offsets = middle.Offsets(unit, step=3, chunk=20)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("ab \n\té日\U0001f600", weights=[5, 5, 3, 2, 1, 1, 1, 1], k=rng.randrange(1, 120)))
        starts = [m.start() for m in re.finditer(find, text)]
        assert offsets.read(text) == len(starts)
        assert [offsets.at(k) for k in range(len(starts) + 1)] == [*starts, len(text)]


def test_middle_by_lines_restores(spark):
    rows = [(i, "\n".join(f"line {i} {k}" for k in range(i))) for i in range(30)]
    made = middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit="line", rate=100, suffix_first=50)
    got = made.select("doc_id", "form", "output", "prefix_chars", middle.restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert {r.doc_id: r.again for r in got} == dict(rows)
    assert all(r.prefix_chars == 0 or dict(rows)[r.doc_id][: r.prefix_chars][-1] == "\n" or r.prefix_chars == len(dict(rows)[r.doc_id]) for r in got if r.form != "plain")


# ---- SQL


@pytest.mark.parametrize("name", ["op12_cross_polytope", "op13_fill_in_middle"])
def test_sql(spark, small, name):
    found = duck(small).execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    same_rows(registry.queries()[name](spark, small), found.fetchall(), names)


def test_vectors_sql_with_links(spark, tmp_path):
    rows = families(np.random.default_rng(7), 16)
    spark.createDataFrame(rows + [(9000, None, 1), (9001, rows[0][1], None)], VECTORS).coalesce(1).write.parquet(str(tmp_path / "e"))
    (next((tmp_path / "e").glob("*.parquet"))).rename(tmp_path / "embeddings.parquet")
    found = duck(tmp_path).execute(embeddings.SQL)
    same_rows(registry.op12_cross_polytope(spark, str(tmp_path)), found.fetchall(), ["vec_id", "n_links", "component_id", "kept"])
