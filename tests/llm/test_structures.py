"""Packing, near-duplicates, neighbours, chroma and the pipeline against brute force."""

import io
import re
import wave
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kinlens.llm import chroma, neardup, neighbours, packing, registry
from kinlens.llm.common import shingle_hashes, word_hashes

DOCS = "doc_id long, text string"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


# --- packing


@given(st.lists(st.integers(1, 24), min_size=1, max_size=9))
@settings(deadline=None, max_examples=150)
def test_bound_is_under_the_optimum(lengths):
    lengths = np.array(lengths)

    def optimum(rest, bins):
        if not rest:
            return len(bins)
        best, seen = 99, set()
        for k, b in enumerate(bins):
            if b >= rest[0] and b not in seen:
                seen.add(b)
                best = min(best, optimum(rest[1:], bins[:k] + [b - rest[0]] + bins[k + 1 :]))
        return min(best, optimum(rest[1:], bins + [24 - rest[0]])) if len(bins) < best else best

    exact = optimum(sorted(lengths.tolist(), reverse=True), [])
    bins, offsets, made = packing.best_fit_decreasing(lengths, 24)
    assert packing.lower_bound(np.bincount(lengths, minlength=25), 24) <= exact <= made
    assert np.bincount(bins, lengths).max() <= 24


@given(st.lists(st.integers(1, 32), min_size=1, max_size=60))
@settings(deadline=None, max_examples=100)
def test_tree_is_best_fit(lengths):
    got = packing.best_fit_decreasing(np.array(lengths), 32)[2]
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 32) - n)
    assert got == len(rooms)


def check_packed(rows, docs):
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    for doc_id, text in docs:
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, p in enumerate(sorted(by[doc_id], key=lambda r: r["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and p["length"] <= 1024
            assert p["length"] == 1024 or k == 0
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for rows_ in seq.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return len(seq)


def test_certified_packing(spark, small, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = registry.op5_best_fit(spark, small).collect()
    n = check_packed(rows, docs)
    least = packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=1025), 1024)
    assert least <= n <= least * 1.02 + 1
    monkeypatch.setattr(packing, "PARTITION_PIECES", 25)
    again = registry.op5_best_fit(spark, small)
    assert check_packed(again.collect(), docs) <= n + 6
    report = packing.packing_report(again).first()
    assert report["least_sequences"] == least and report["sequences"] >= least


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|> x"), (4, "word " * 9000)], DOCS)
    check_packed(packing.certified_packing(df).collect(), [(1, None), (2, ""), (3, "<|endoftext|> x"), (4, "word " * 9000)])
    twice = packing.certified_packing(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], DOCS)).collect()
    assert len(twice) == 3 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 3
    assert packing.certified_packing(spark.createDataFrame([], DOCS)).count() == 0
    assert packing.packed_matrices(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_PIECES", 50)
    same = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    pieces = packing.written(packing.encoded_pieces(same, None, 1024), "pieces")
    groups = [r["count"] for r in packing._packed(pieces, 1000, 0).groupBy("grp").count().collect()]
    assert len(groups) == 20 and max(groups) < 100
    rows = packing.certified_packing(same).collect()
    assert len({r["sequence_id"] for r in rows}) == 1 and sorted(r["offset"] for r in rows) == list(range(1000))


def test_exchange_goes_on_until_nothing_is_saved(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_PIECES", 40)
    rng = np.random.default_rng(5)
    docs = [(i, "a" + " a" * int(n)) for i, n in enumerate(rng.integers(100, 900, 600))]
    df = spark.createDataFrame(docs, DOCS)
    made = {k: check_packed(packing.certified_packing(df, rounds=k).collect(), docs) for k in (0, 1, None)}
    rows = packing.certified_packing(df).collect()
    least = packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=1025), 1024)
    assert least <= made[None] <= made[1] <= made[0] and made[None] < made[0]


def test_matrices_hold_every_id(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = defaultdict(dict)
    for r in packing.packed_matrices(docs, pieces=64, pad_id=9).collect():
        ids, positions = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
        assert len(ids) == len(positions) == 1024 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        assert (ids[r["n_tokens"] :] == 9).all() and not positions[r["n_tokens"] :].any()
        for doc, piece, s, e in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert (positions[s:e] == np.arange(e - s)).all()
            found[doc][piece] = ids[s:e].tolist()
    for doc, text in texts.items():
        ids = [x for k in sorted(found[doc]) for x in found[doc][k]]
        assert ids == TOKENIZER.encode(text, add_special_tokens=False).ids + [2]


def test_word_ids_without_ranks():
    from kinlens.llm.bpe import tokenizer_source

    w = packing.WordIds(tokenizer_source())
    fast = w.encode(["some words, and Ünique ones"])
    w.clear()
    w.ranked = None
    assert w.encode(["some words, and Ünique ones"]) == fast


# --- near-duplicates

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(docs, percent=85):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, shared = defaultdict(list), defaultdict(int)
    for i in sorted(sets):
        for s in sets[i]:
            for j in holders[s]:
                shared[j, i] += 1
            holders[s].append(i)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def found_components(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_near_duplicates_are_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = registry.op8_near_duplicates(spark, folder)
    assert found_components(got) == brute_components(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


@pytest.mark.parametrize("block", [3, 512])
def test_near_duplicate_families(spark, monkeypatch, block):
    """Chains of edits: neighbours are linked and ends are not; texts that share a passage are not linked; blocks don't matter."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(4000)]
    docs, k = [], 0
    for _ in range(4):
        base = list(rng.choice(words, 120))
        for _ in range(12):
            docs.append((k, " ".join(base)))
            base[int(rng.integers(0, 120))] = "edited" + str(k)
            k += 1
    passage = " ".join(rng.choice(words, 60))
    for _ in range(25):
        docs.append((k, passage + " " + " ".join(rng.choice(words, int(rng.integers(5, 60))))))
        k += 1
    docs += [(k, "few words"), (k + 1, "few WORDS"), (k + 2, ""), (k + 3, None), (k + 4, " \t\n"), (k + 5, "one"), (k + 6, " ".join(words * 5))]
    for percent in (80, 85):
        assert found_components(neardup.near_duplicates(spark.createDataFrame(docs, DOCS), percent)) == brute_components(docs, percent)


def test_near_duplicates_at_another_percentage(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(4000)]
    docs = []
    for k in range(20):  # 116 shingles; two far edits leave 106 of 126, 0.84
        base = list(rng.choice(words, 120, replace=False))
        docs.append((2 * k, " ".join(base)))
        base[30], base[90] = f"edited{k}", f"edited{k}"
        docs.append((2 * k + 1, " ".join(base)))
    df = spark.createDataFrame(docs, DOCS)
    assert found_components(neardup.near_duplicates(df)) == {d: (116, d - d % 2) for d, _ in docs}
    assert found_components(neardup.near_duplicates(df, 85)) == {d: (116, d) for d, _ in docs}
    for percent in (50, 80, 85, 95):
        width = neardup.band_width(percent)
        assert (1 - (percent / 100) ** width) ** (neardup.REGISTERS // width) <= neardup.MOST_MISSED
    assert neardup.band_width(85) == 6 and neardup.band_width(80) == 5


def test_near_duplicate_edges(spark):
    df = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (3, "A b  c"), (None, "a b c"), (None, None)], DOCS)
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert [g for g in got if g[0] > 0] == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 3, False)]
    assert len(got) == 5
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_of_one_id_keep_their_links(spark):
    a, b = [f"a{k}" for k in range(100)], " ".join(f"b{k}" for k in range(100))
    near = " ".join([*a[:-1], "other"])
    df = spark.createDataFrame([(5, " ".join(a)), (7, near), (5, b), (9, b + " more")], DOCS)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)]


def test_settled_keys_enter_no_round(spark, monkeypatch):
    """Of a large group of near copies only what isn't linked with its keys' first class goes on, and each round gets part of the one before."""
    monkeypatch.setattr(neardup, "BLOCK", 20)
    entered, mixed = [], neardup.mixed_keys
    monkeypatch.setattr(neardup, "mixed_keys", lambda rows, found: (entered.append(rows.count()), mixed(rows, found))[1])
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(4000)]
    base, docs = list(rng.choice(words, 200)), []
    for k in range(300):
        text = list(base)
        for _ in range(int(rng.integers(0, 3))):
            text[int(rng.integers(0, 200))] = f"edit{k}"
        docs.append((k, " ".join(text)))
    df = spark.createDataFrame(docs, DOCS)
    assert found_components(neardup.near_duplicates(df)) == brute_components(docs, 80)
    classes = len({t for _, t in docs})
    assert entered[0] < 0.2 * classes * (neardup.REGISTERS // neardup.band_width(80)) and entered[1:-1] == sorted(entered[1:-1], reverse=True)


def test_rounds_end_where_few_link(spark, monkeypatch):
    """After a round in which too few pairs link, what is left goes to blocks at once, and no link is lost."""
    monkeypatch.setattr(neardup, "BLOCK", 20)
    monkeypatch.setattr(neardup, "LEAST_LINKED", 2.0)
    entered, mixed = [], neardup.mixed_keys
    monkeypatch.setattr(neardup, "mixed_keys", lambda rows, found: (entered.append(1), mixed(rows, found))[1])
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(4000)]
    base, docs = list(rng.choice(words, 200)), []
    for k in range(120):  # most pairs lie around 0.65 to 0.9
        text = list(base)
        for _ in range(int(rng.integers(0, 6))):
            text[int(rng.integers(0, 200))] = f"edit{k}"
        docs.append((k, " ".join(text)))
    assert found_components(neardup.near_duplicates(spark.createDataFrame(docs, DOCS))) == brute_components(docs, 80)
    assert len(entered) == 2


def test_null_ids_are_linked_with_nothing(spark):
    df = spark.createDataFrame([(5, "a b c"), (None, "a b c"), (7, "a b c"), (None, "d e")], DOCS)
    got = sorted(((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == [(0, None, True), (0, None, True), (5, 5, True), (7, 5, False)]


def test_blocks_grow_with_what_lies_outside_the_largest_component(spark, monkeypatch):
    """Every pair of classes of different components meets once, and a key of many classes with few outside is dealt in about its size."""
    monkeypatch.setattr(neardup, "BLOCK", 8)

    def meet(n_top, rest):
        comps = [0] * n_top + rest
        rows = [(1, 0, i, 10, c, c == 0, n_top, len(rest), b"") for i, c in enumerate(comps)]
        dealt = neardup.in_blocks(spark.createDataFrame(rows, "key long, band int, id long, n long, component long, is_top boolean, n_top long, n_rest long, regs binary")).collect()
        groups = defaultdict(list)
        for r in dealt:
            groups[r["i"], r["j"]].append(r)
        met = defaultdict(int)
        for (i, j), g in groups.items():
            for x in g:
                for y in g:
                    if x["id"] < y["id"] and x["component"] != y["component"] and (i == j or x["side"] != y["side"]):
                        met[x["id"], y["id"]] += 1
        wanted = {(x, y) for x in range(len(comps)) for y in range(x + 1, len(comps)) if comps[x] != comps[y]}
        assert set(met) == wanted and set(met.values()) <= {1}
        return len(dealt)

    assert meet(400, [1, 2, 2]) <= 400 + 3 * 50 + 3
    meet(20, [1] * 15 + [2] * 12 + list(range(3, 20)))
    meet(3, list(range(1, 30)))


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
    for share in (0.3, 0.6, 0.9):
        n = 2000
        both = int(2 * n * share / (1 + share))
        a, b = pool[:n], pool[n - both : 2 * n - both]
        j, _ = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], np.array([n]), np.array([n]))
        assert abs(j[0] - share) < 0.12
    small = [neardup.registers(pool[k : k + 3]) for k in (0, 3)]
    assert (neardup.densified(np.stack(small)) > 0).all()
    assert 0 < neardup.expected_collisions(np.array([500]), np.array([500]))[0] < 1e-3


def test_word_hashes_are_words():
    assert len(word_hashes("a  b\tÜ\n".encode())) == 3
    assert word_hashes(b"x abc y")[1] == word_hashes(b"abc")[0]
    assert len(shingle_hashes(b"a b c d e f")) == 2 and len(shingle_hashes(b"a b")) == 1 and not len(shingle_hashes(b" "))
    assert shingle_hashes(b"ab c")[0] != shingle_hashes(b"a bc")[0]


# --- neighbours


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    from kinlens.llm import common

    raws = [b"some words and " * 50 + b"x" * 300 + b"  \n tail", b" " * 40, b"", b"w" * 99, "é ü\t".encode() * 60]
    whole = [word_hashes(r).tolist() for r in raws]
    for block in (1, 7, 64):
        monkeypatch.setattr(common, "BLOCK", block)
        assert [word_hashes(r).tolist() for r in raws] == whole


def test_neighbours_recall(spark):
    folder = "/root/testdata/sf0.01"
    got = defaultdict(list)
    for r in registry.op3_collision_counting(spark, folder).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hits = total = 0
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        near = got[q]
        assert [n[2] for n in near] == list(range(1, 11))
        assert all(abs(d[ids == v][0] - s) < 1e-12 for v, s, _ in near)
        hits += len({v for v, _, _ in near} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        total += 10
    assert hits / total >= 0.9


def test_neighbours_of_any_scale(spark):
    rng = np.random.default_rng(1)
    small = rng.normal(size=(200, 8))
    for scale in (1.0, 1e300, 1e-300, 2.0**1020):
        df = spark.createDataFrame([(i, (v * scale / 8).tolist()) for i, v in enumerate(small)], "vec_id long, embedding array<double>")
        rows = neighbours.usable(df)
        got = defaultdict(list)
        for r in neighbours.nearest(rows, rows.where("vec_id % 100 = 0"), k=5).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        for q, near in got.items():
            d = np.sqrt((((small - small[q]) / 8) ** 2).sum(1))
            d[q] = np.inf
            assert [i for i, _ in near] == np.argsort(d)[:5].tolist()
            assert np.allclose([x / scale for _, x in near], np.sort(d)[:5], rtol=1e-9)
    far = neighbours.usable(spark.createDataFrame([(0, [1.7e308]), (1, [-1.7e308]), (2, [1.0])], "vec_id long, embedding array<double>"))
    got = neighbours.nearest(far, far.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 1.7e308), (1, float("inf"))]


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [3.0, 4.0]), (9, [3.0, 4.0]), (None, [1.0, 1.0]), (10, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, block int")
    v = neighbours.usable(df)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(v, v, k=2).orderBy("query_id", "rank").collect()]
    far = float(np.sqrt(20.0))
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (1, 1, 0, 0.0), (1, 2, 2, 0.0), (2, 1, 0, 0.0), (2, 2, 1, 0.0), (9, 1, 0, far), (9, 2, 1, far)]
    none = v.limit(0)
    assert neighbours.nearest(none, none).count() == 0


# --- chroma


def tone(seconds, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * chroma.RATE)) / chroma.RATE
    pitch = 110 * 2 ** (rng.integers(0, 30, int(seconds * 4) + 1) / 12)
    return (np.sin(2 * np.pi * pitch[(t * 4).astype(int)] * t) * 12000).astype("<i2")


def test_filters_are_area_sums():
    image = np.random.default_rng(1).random((20, 12))
    got = chroma.fingerprint(image)
    assert len(got) == 5
    k, (kind, c, h, w) = 1, chroma.FILTERS[1]
    assert kind == 1
    wrapped = np.concatenate([image, image], 1)[2 : 2 + w, c : c + h]
    a, b = wrapped[:, : h // 2].mean(), wrapped[:, h // 2 :].mean()
    value = np.log((chroma.LEAST_LEVEL + a) / (chroma.LEAST_LEVEL + b))
    cell = int(value >= -chroma.STEP) + int(value >= 0) + int(value >= chroma.STEP)
    assert (int(got[2]) >> (2 * (15 - k))) & 3 == cell ^ (cell >> 1)


def test_excerpts_are_found(spark):
    whole = {k: tone(8, k) for k in range(6)}
    rows = spark.createDataFrame([(k, x.tobytes(), chroma.RATE) for k, x in whole.items()], "rec_id long, audio binary, rate int")
    cut = spark.createDataFrame([(100 + k, (x[2 * chroma.RATE + 77 : 5 * chroma.RATE] // 2).tobytes(), chroma.RATE) for k, x in whole.items()], "rec_id long, audio binary, rate int")
    got = chroma.alignments(chroma.fingerprints(rows), chroma.fingerprints(cut)).collect()
    best = {r["query_id"]: r for r in got if r["rank"] == 1}
    assert {q: r["rec_id"] for q, r in best.items()} == {100 + k: k for k in whole}
    assert all(abs(r["offset"] - (2 * chroma.RATE + 77) / chroma.HOP) <= 1 and r["bit_error"] < 0.12 for r in best.values())


def test_chroma_edges(spark):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(2 * chroma.RATE)
        w.writeframes(np.repeat(tone(6, 0), 4).tobytes())  # twice the rate, two channels
    rows = [(0, tone(6, 0).tobytes(), chroma.RATE), (1, buffer.getvalue(), None), (2, None, None), (3, b"", 1), (4, b"\1\2\3", None), (5, bytes(60000), None), (6, bytes(60000), None), (None, tone(6, 0).tobytes(), None), (7, tone(6, 0).tobytes(), None), (7, tone(6, 0).tobytes(), None)]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "rec_id long, audio binary, rate int"))
    sizes = {r["rec_id"]: len(r["prints"]) for r in prints.collect()}
    assert sizes[2] == sizes[3] == sizes[4] == 0 and sizes[0] and sizes[5]
    got = defaultdict(list)
    for r in chroma.alignments(prints, prints).orderBy("rank").collect():
        got[r["query_id"]].append(r["rec_id"])
    assert got[5] == [5, 6] and got[0][:2] == [0, 7] and 1 in got[0]
    none = prints.limit(0)
    assert chroma.alignments(none, none).count() == 0


PRINTS = "rec_id long, prints binary"


def test_noisy_copies_align(spark):
    rng = np.random.default_rng(4)
    whole = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    bad = rng.random((100, 32)) < 0.15
    bad[::5, :16] = False  # some high halves are as they were
    cut = whole[50:150] ^ (bad << np.arange(31, -1, -1)).sum(1).astype(np.uint32)
    prints = spark.createDataFrame([(1, whole.astype("<u4").tobytes()), (2, rng.bytes(800))], PRINTS)
    asked = spark.createDataFrame([(9, cut.astype("<u4").tobytes())], PRINTS)
    (found,) = chroma.alignments(prints, asked).collect()
    assert (found["rec_id"], found["offset"]) == (1, 50) and 0.12 < found["bit_error"] < 0.2
    assert chroma.alignments(prints, asked, most_error=0.1).count() == 0


def test_every_copy_aligns(spark):
    rng = np.random.default_rng(5)
    whole = rng.integers(0, 1 << 32, 200, dtype=np.uint32)
    near = whole ^ (rng.random(200) < 0.5).astype(np.uint32)  # other low halves
    rows = [(k, whole.astype("<u4").tobytes()) for k in range(15)] + [(20, near.astype("<u4").tobytes()), (21, rng.bytes(800)), (22, b"")]
    prints = spark.createDataFrame(rows, PRINTS)
    asked = spark.createDataFrame([(q, whole[50:150].astype("<u4").tobytes()) for q in (30, 31)] + [(32, b"")], PRINTS)
    got = [(r["query_id"], r["rank"], r["rec_id"]) for r in chroma.alignments(prints, asked).orderBy("query_id", "rank").collect()]
    assert got == [(q, n + 1, k) for q in (30, 31) for n, k in enumerate([*range(15), 20])]
    assert chroma.alignments(prints, asked, k=3).count() == 6


def test_a_lower_peak_aligns(spark):
    """The most votes are at an offset with too little overlap; the excerpt lies at another."""
    rng = np.random.default_rng(7)
    asked = rng.integers(0, 1 << 32, 100, dtype=np.uint32)
    true = asked ^ np.where(rng.random(100) < 0.8, np.uint32(1 << 20), np.uint32(0)).astype(np.uint32)  # few high halves are equal
    whole = np.concatenate([asked[60:], rng.integers(0, 1 << 32, 30, dtype=np.uint32), true])
    prints = spark.createDataFrame([(1, whole.astype("<u4").tobytes())], PRINTS)
    (found,) = chroma.alignments(prints, spark.createDataFrame([(9, asked.astype("<u4").tobytes())], PRINTS)).collect()
    assert found["offset"] == 70 and found["votes"] < 40


def brute_align(query, prints, need_votes=True):
    """{recording: (bit error, -votes, offset)} of the best offset of each, over all offsets."""
    out = {}
    for r, p in prints.items():
        for d in range(-len(query), len(p)):
            s, e = max(0, -d), min(len(query), len(p) - d)
            if e - s < max(1, chroma.LEAST_OVERLAP * len(query)):
                continue
            x = query[s:e] ^ p[s + d : e + d]
            votes = int((x >> np.uint32(16) == 0).sum())
            if not need_votes or votes >= max(2, chroma.LEAST_VOTES * len(query)):
                out[r] = min(out.get(r, (2.0, 0, 0)), (int(np.bitwise_count(x).sum()) / (32 * len(x)), -votes, d))
    return out


@pytest.mark.parametrize("held", [7, 1 << 20])
def test_alignments_are_brute_force(monkeypatch, held):
    """Random, repetitive and silent fingerprints: runs vote for as many offsets as their integers do, however they are cut."""
    monkeypatch.setattr(chroma, "HELD", held)
    rng = np.random.default_rng(9)
    prints = {}
    for r in range(24):
        n = int(rng.integers(0, 70))
        kinds = [rng.integers(0, 1 << 32, n, dtype=np.uint32), np.repeat(rng.integers(0, 3, n // 6 + 1) << 17, 6)[:n].astype(np.uint32), np.zeros(n, np.uint32), (rng.integers(0, 2, n) << 16).astype(np.uint32)]
        prints[r] = kinds[r % 4]
    whole = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
    prints[24], prints[25] = whole, np.concatenate([np.zeros(30, np.uint32), whole[10:50]])
    batch = chroma.pa.RecordBatch.from_pydict({"id": list(prints), "prints": [p.astype("<u4").tobytes() for p in prints.values()]})
    index = chroma.PrintIndex(batch)
    for query in [*(p[3:40] for p in prints.values() if len(p) > 10), np.zeros(20, np.uint32), np.empty(0, np.uint32)]:
        near, (n, total, squares) = index.align(query, 0.2)
        brute = brute_align(query, prints) if len(query) else {}
        assert {r: (e, -v, d) for r, d, v, e in near} == {r: x for r, x in brute.items() if x[0] <= 0.2}
        rest = [x[0] for x in brute.values() if x[0] > 0.2]
        assert n == len(rest) and abs(total - sum(rest)) < 1e-9 and abs(squares - sum(x * x for x in rest)) < 1e-9


def test_alignment_recall(spark):
    """Quieter, noisy excerpts of held chords among many recordings: at least 0.9 of what a search of every offset by bit error alone finds, and
    hardly anything by chance."""
    rng = np.random.default_rng(2)
    whole = {k: tone(6, k) for k in range(120)}
    rows = spark.createDataFrame([(k, x.tobytes(), chroma.RATE) for k, x in whole.items()], "rec_id long, audio binary, rate int")
    noisy = lambda x: (x * 0.4 + rng.normal(0, 500, len(x))).astype("<i2")
    cut = spark.createDataFrame([(k, noisy(whole[k][2 * chroma.RATE + 50 : 5 * chroma.RATE]).tobytes(), chroma.RATE) for k in range(0, 120, 4)], "rec_id long, audio binary, rate int")
    prints, asked = chroma.fingerprints(rows), chroma.fingerprints(cut)
    got = {(r["query_id"], r["rec_id"]) for r in chroma.alignments(prints, asked).collect()}
    held = {r["rec_id"]: np.frombuffer(r["prints"], "<u4") for r in prints.collect()}
    true = set()
    for r in asked.collect():
        best = brute_align(np.frombuffer(r["prints"], "<u4"), held, need_votes=False)
        if best[r["rec_id"]][0] <= chroma.MOST_ERROR:
            true.add((r["rec_id"], r["rec_id"]))
    assert len(true) > 20 and len(got & true) >= 0.9 * len(true)
    assert len({q for q, r in got if q != r}) <= 1


def test_silence_is_counted_by_ranges():
    """Thousands of silent recordings of different lengths cost one query little memory."""
    import tracemalloc

    batch = chroma.pa.RecordBatch.from_pydict({"id": list(range(4000)), "prints": [np.zeros(80 + k % 40, "<u4").tobytes() for k in range(4000)]})
    index = chroma.PrintIndex(batch)
    tracemalloc.start()
    near, _ = index.align(np.zeros(43, np.uint32), 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(near) == 4000 and peak < 80e6
    assert {(d, v, e) for _, d, v, e in near} == {(0, 43, 0.0)}


def test_chroma_query(spark):
    got = [r for r in registry.op2_chroma(spark, "/root/testdata/sf0.01").collect() if r["rank"] == 1]
    assert len(got) == 10 and all(r["query_id"] == r["rec_id"] for r in got)


# --- the pipeline


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert np.mean([d in kept["quality"] for d in good]) > 0.97
    assert np.mean([d in kept["quality"] for d, q in labels.items() if q == 0]) < 0.1
    assert set(kept["lines"]) == set(kept["quality"])
    components = brute_components(kept["lines"].items(), 80)
    assert set(kept["near_duplicates"]) == {c for _, c in components.values()}
    for d, text in kept["secrets"].items():
        before = kept["near_duplicates"][d]
        assert text == before or "[secret]" in text
        assert not re.search("[0-9a-f]{32}", text)
    rows = corpus_pipeline.packing_stage(spark, docs, folder).collect()
    check_packed(rows, list(kept["secrets"].items()))


def test_near_duplicate_stage_removes_rows_not_ids(spark):
    t, u = "one two three four five six", "quite other words that nothing else here has at all"
    rows = [(3, t), (5, t), (5, u), (9, "alike rows of one id stay once"), (9, "alike rows of one id stay once"), (None, t), (None, t)]
    docs = spark.createDataFrame([(d, x, "en", "s", len(x)) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()))
    assert got == [(0, t), (0, t), (3, t), (5, u), (9, "alike rows of one id stay once")]
    few = docs.where("doc_id < 9")
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, few, "").collect()) == [(3, t), (5, u)]


def test_pipeline_runs_on_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
