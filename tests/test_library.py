"""Functions, inventories, the store, scans, deletes, exports and streams."""

import hashlib
import io
import os
import struct
import subprocess
import sys
import time
import zlib
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from kinlens import cli
from kinlens.functions import images as I
from kinlens.functions import text as X
from kinlens.functions import vectors as V
from kinlens.operators import browse as B
from kinlens.plans.features import Found, Models, NoDetector, PixelEmbedder, choose_embedder
from kinlens.plans.library import FolderTrash, Library
from kinlens.sources import images as D
from kinlens.sources import inventory as N
from kinlens.sources.files import contents, files_under
from kinlens.sources.store import Store, with_metadata, with_root
from kinlens.streaming.watch import CHANGES, changes, quiet_sessions, watch, with_roots
from kinlens.tables import empty, schema


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- functions


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = one(spark, V.l2_normalized(a(3, 4, 0, 0)), V.l2_normalized(a(0, 0)), V.dot(a(1, 2, 3), a(1, 2)), V.cosine_distance(a(1, 2, 3), a(1, 2)), V.cosine_similarity(a(2, 0), a(5, 0)), V.cosine_similarity(a(0, 0), a(1, 0)))
    assert r[0] == [0.6, 0.8, 0, 0] and r[1] == [0, 0] and r[2] == 0 and r[3] == 1 and r[4] == 1 and r[5] == 0
    blobs = spark.createDataFrame([(struct.pack("<2f", 1, -2),), (b"\1\2\3",), (b"",), (None,)], "b binary")
    assert [r[0] for r in blobs.select(V.from_blob("b")).collect()] == [[1.0, -2.0], [], [], None]
    assert blobs.limit(1).select(V.to_blob(V.from_blob("b"))).first()[0] == struct.pack("<2f", 1, -2)
    rows = spark.createDataFrame([(1, "g", [1.0, 3.0]), (2, "g", [3.0, 5.0]), (3, "g", [9.0]), (4, "h", [0.0, 0.0])], "id long, k string, vec array<double>")
    assert {r["k"]: r["mean"] for r in V.mean_vectors(rows, ["k"], "vec", "id").collect()} == {"g": [2.0, 4.0], "h": [0.0, 0.0]}


def test_hashes(spark):
    h = lambda x, y: I.hamming(F.lit(x).cast("long"), F.lit(y).cast("long"))
    assert tuple(one(spark, h(0, 0), h(0, 0b1011), h(-1, 0))) == (0, 3, 64)
    falling = np.tile(np.arange(9)[::-1], (8, 1))
    assert I.dhash_bits(falling) == -1 and I.dhash_bits(falling[:, ::-1]) == 0
    first = np.zeros((8, 9), int)
    first[0, 0] = 1
    assert I.dhash_bits(first) == 1
    rows = spark.createDataFrame([(first.astype(np.uint8).tobytes(),), (b"x",), (None,)], "p binary")
    assert [r[0] for r in rows.select(I.dhash("p")).collect()] == [1, None, None]
    assert (I.shrink_gray(np.kron(falling * 10, np.ones((5, 7)))) == falling * 10).all()


def test_rules(spark):
    s = lambda name, camera, png, w, h: I.is_screenshot(F.lit(name), F.lit(camera), F.lit(png), F.lit(w), F.lit(h))
    assert tuple(one(spark, s("a.jpg", False, False, 108, 234), s("a.jpg", True, False, 108, 234), s("My Screen Shot.jpg", True, False, 1, 1), s("a.png", False, True, 10, 10), s("a.jpg", False, False, None, 5), s("a.jpg", False, False, 170, 100))) == (True, False, True, True, False, True)
    c = lambda i, s, d: I.category(F.lit(i), F.lit(s), F.lit(d))
    assert tuple(one(spark, c(1 == 1, True, True), c(False, True, True), c(False, False, True), c(False, False, False))) == ("identity", "screenshot", "document", "other")
    label = lambda *x: F.array(*[F.struct(F.lit(n).alias("label"), F.lit(p).alias("confidence")) for n, p in x])
    assert tuple(one(spark, I.is_document(F.lit(0.75), label(("x", 1.0))), I.is_document(F.lit(None).cast("double"), label(("receipt", 0.6))), I.is_document(F.lit(0.7), label(("menu", 0.9))))) == (True, True, False)
    assert tuple(one(spark, I.pet_kind(label(("Cat", 0.6), ("dog", 0.5))), I.pet_kind(label(("dog", 0.59))), I.pet_kind(label(("fox", 0.9))))) == ("cat", None, None)
    assert tuple(one(spark, I.passes_quality(F.lit(None).cast("double")), I.passes_quality(F.lit(0.3)), I.passes_quality(F.lit(0.29)), I.passes_quality(F.lit(0.1), None), I.passes_joints(F.lit(0.2), F.lit(0.3)), I.passes_joints(F.lit(0.1), F.lit(0.3)))) == (True, True, False, True, True, False)


def test_dates_and_text(spark):
    assert tuple(one(spark, X.taken_at(F.lit("2021:07:15 10:30:00")), X.taken_at(F.lit("soon")), X.signed(F.lit(12.5), F.lit("S"), "S"), X.signed(F.lit(77.25), F.lit("E"), "W"))) == (datetime(2021, 7, 15, 10, 30).timestamp() if time.timezone == 0 else 1626345000.0, None, -12.5, 77.25)
    assert tuple(one(spark, X.numbered(F.lit("a.b.jpg"), F.lit(2)), X.numbered(F.lit("none"), F.lit(3)), X.numbered(F.lit("a.jpg"), F.lit(1)), X.last_component(F.lit("/x/y/")), X.relative_path(F.lit("/r/a/b.jpg"), "/r"), X.relative_path(F.lit("/q/b.jpg"), "/r"))) == ("a.b (2).jpg", "none (3)", "a.jpg", "y", "a/b.jpg", "b.jpg")
    assert tuple(one(spark, X.grid_key(F.lit(-0.125), F.lit(0.125)), X.cleaned(F.lit("  ")), X.display_name(F.lit(None)), X.short_count(F.lit(1250)), X.short_count(F.lit(999)), X.match_percent(F.lit(0.125)), X.byte_size(F.lit(2_500_000)), X.review_label(F.lit(0.25)), X.title(F.lit("identity")))) == ("-3,3", None, "Unnamed", "1.3k", "999", 88, "2.5 MB", "likely same · 75% · 0.25", "Identity & cards")


def test_alignment():
    rng = np.random.default_rng(0)
    p = rng.random((5, 2)) * 100
    turn = 1.7 * np.exp(1j * np.radians(25))
    z = p @ [1, 1j] * turn + (12 - 8j)
    a, b, tx, ty = I.similarity_transform(p, np.stack([z.real, z.imag], 1))
    assert np.allclose([a, b, tx, ty], [turn.real, turn.imag, 12, -8], atol=1e-6)
    assert I.similarity_transform(np.ones((3, 2)), p[:3]) is None and I.similarity_transform(p[:1], p[:1]) is None
    mirrored = np.array([(0.7, 0.4), (0.3, 0.4), (0.5, 0.55), (0.65, 0.7), (0.35, 0.7)])
    plain = mirrored[[1, 0, 2, 4, 3]]
    assert np.allclose(I.template_transform(mirrored, 200, 200), I.template_transform(plain, 200, 200)) and I.template_transform(plain, 200, 200)[0] > 0
    image = rng.random((112, 112))
    assert np.allclose(I.warp(image, np.array([1.0, 0, 0, 0]), 112), image)


@pytest.mark.parametrize("k", [5, 3])
def test_transforms_of_many_are_those_of_each(k):
    rng = np.random.default_rng(k)
    many = rng.random((40, k, 2))
    many[7] = 0.5  # all points coincide
    got = I.template_transforms(many, 640, 480)
    assert np.isnan(got[7]).all() and I.template_transform(many[7], 640, 480) is None
    for j in [*range(7), *range(8, 40)]:
        p = many[j].copy()
        for a, b in ((0, 1), (3, 4))[: 2 if k == 5 else 1]:
            p[[a, b]] = p[sorted((a, b), key=lambda x: p[x, 0])]
        goal = np.array(I.FACE_TEMPLATE if k == 5 else I.PET_TEMPLATE, float)
        (x, y), (u, v) = (p * [640, 480] if k == 3 else np.stack([p[:, 0] * 640, (1 - p[:, 1]) * 480], 1)).T, np.stack([goal[:, 0], I.TEMPLATE_SIDE - goal[:, 1]])
        system = np.concatenate([np.stack([x, -y, x * 0 + 1, x * 0], 1), np.stack([y, x, x * 0, x * 0 + 1], 1)])
        assert np.allclose(np.linalg.lstsq(system, np.concatenate([u, v]), rcond=None)[0], got[j])



def test_five_points(spark):
    pts = lambda *x: F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in x])
    none = F.array().cast("array<struct<x:double,y:double>>")
    box = F.struct(F.lit(0.2).alias("x"), F.lit(0.2).alias("y"), F.lit(0.5).alias("w"), F.lit(0.5).alias("h"))
    full = one(spark, I.five_points(pts((0.2, 0.8), (0.4, 0.8)), pts((0.8, 0.8)), none, pts((0.7, 0.2), (0.3, 0.2)), box))[0]
    assert [(round(p["x"], 3), round(p["y"], 3)) for p in full] == [(0.35, 0.4), (0.6, 0.4), (0.475, 0.4), (0.35, 0.7), (0.55, 0.7)]
    assert one(spark, I.five_points(none, pts((0.8, 0.8)), none, none, box))[0] is None


# --- files


def png(pixels, kinds=(0, 1, 2, 3, 4)):
    h, w = pixels.shape[:2]
    c = 1 if pixels.ndim == 2 else 3
    rows, above = b"", np.zeros(w * c, int)
    for y in range(h):
        kind, line, out = kinds[y % len(kinds)], pixels[y].ravel().astype(int), []
        for x in range(w * c):
            left, corner = (line[x - c], above[x - c]) if x >= c else (0, 0)
            p = left + above[x] - corner
            paeth = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
            out.append((line[x] - [0, left, above[x], (left + above[x]) // 2, paeth][kind]) & 255)
        rows += bytes([kind, *out])
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if c == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def jpeg_header():
    def entry(tag, kind, n, value):
        return struct.pack("<HHI", tag, kind, n) + (value if isinstance(value, bytes) else struct.pack("<I", value)).ljust(4, b"\0")

    date, gps = b"2021:07:15 10:30:00\0", struct.pack("<6I", 12, 1, 30, 1, 0, 1)
    main, exif, place = 8, 8 + 2 + 2 * 12 + 4, 8 + 2 + 2 * 12 + 4 + 2 + 12 + 4
    data = place + 2 + 4 * 12 + 4
    tiff = b"II*\0" + struct.pack("<I", main) + struct.pack("<H", 2) + entry(0x8769, 4, 1, exif) + entry(0x8825, 4, 1, place) + b"\0" * 4
    tiff += struct.pack("<H", 1) + entry(0x9003, 2, len(date), data) + b"\0" * 4
    tiff += struct.pack("<H", 4) + entry(1, 2, 2, b"S\0") + entry(2, 5, 3, data + len(date)) + entry(3, 2, 2, b"W\0") + entry(4, 5, 3, data + len(date)) + b"\0" * 4 + date + gps
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 234, 108, 3) + b"\0" * 9


def test_decoding():
    rng = np.random.default_rng(0)
    for p in (rng.integers(0, 256, (11, 7)), rng.integers(0, 256, (6, 5, 3))):
        assert (D.decode(png(p)) == p).all()
    gray = rng.integers(0, 256, (4, 6))
    assert (D.decode(D.to_pgm(gray)) == gray).all()
    assert D.decode(b"junk") is None and D.decode(png(gray)[:60]) is None and D.decode(b"P5 9 9 255\n12") is None
    m = D.metadata(jpeg_header())
    assert (m.width, m.height, m.taken, m.lat, m.lat_ref, m.lon_ref, m.has_camera) == (108, 234, "2021:07:15 10:30:00", 12.5, "S", "W", True)
    assert D.metadata(b"").width is None and D.metadata(png(gray)).is_png
    assert D.bounded(np.zeros((4000, 100))).shape == (1600, 40)
    assert (D.upright(gray, 6) == np.rot90(gray, 3)).all()


def listing(spark, rows):
    return spark.createDataFrame([(p, "VOL", i, float(t), s, p.endswith(".mov")) for p, i, t, s in rows], N.LISTING)


def photo_rows(spark, rows):
    e = empty(spark, "photo")
    base = spark.createDataFrame([(i, 1, p, "VOL", f, 1.0, 10, state, 1, False) for i, p, f, state in rows], "id long, root_id long, relative_path string, volume_uuid string, file_id long, mtime double, size long, state string, scan_generation int, favorite boolean")
    return e.unionByName(base, allowMissingColumns=True)


def test_scan_diff(spark):
    known = photo_rows(spark, [(1, "keep", 1, "embedded"), (2, "edit", 2, "embedded"), (3, "gone", 3, "embedded"), (4, "old", 4, "embedded"), (5, "lost", 5, "missing"), (6, "back", 6, "missing")])
    new = listing(spark, [("keep", 1, 1, 10), ("edit", 2, 2, 10), ("new name", 4, 1, 10), ("add", 9, 1, 10), ("clip.mov", 10, 1, 10), ("back", 6, 1, 10), ("copy", 4, 1, 10)])
    got = {r["relative_path"]: (r["id"], r["status"], r["state"]) for r in N.scan_diff(known, new, 1, 2).collect()}
    # of two files with one inode the first path is the move
    assert got == {"keep": (1, "unchanged", "embedded"), "edit": (2, "changed", "discovered"), "gone": (3, "missing", "missing"), "copy": (4, "unchanged", "embedded"), "new name": (None, "inserted", "discovered"), "lost": (5, "absent", "missing"), "add": (None, "inserted", "discovered"), "clip.mov": (None, "inserted", "embedded"), "back": (6, "unchanged", "discovered")}
    report = N.scan_report(N.scan_diff(known, new, 1, 2)).first().asDict()
    assert report == {"discovered": 3, "changed": 1, "unchanged": 3, "missing": 1, "videos": 1}


def tree(root, files):
    for name, content in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)


def digest(root):
    return {os.path.relpath(os.path.join(d, n), root): hashlib.sha256(open(os.path.join(d, n), "rb").read()).hexdigest() for d, _, names in os.walk(root) for n in names}


def test_inventory(spark, tmp_path):
    tree(tmp_path, {"a.jpg": b"1", "in/b.PNG": b"12", "in/deep/c.mov": b"123", "note.txt": b"", ".hidden.jpg": b"", ".dir/d.jpg": b"", "x.app/e.jpg": b"", "in/y.photoslibrary/f.jpg": b""})
    for df in (N.listed(spark, str(tmp_path)), N.listed_with_inodes(spark, str(tmp_path))):
        assert {(r["relative_path"], r["size"], r["is_video"]) for r in df.collect()} == {("a.jpg", 1, False), ("in/b.PNG", 2, False), ("in/deep/c.mov", 3, True)}
    inodes = {r["relative_path"]: r["file_id"] for r in N.listed_with_inodes(spark, str(tmp_path)).collect()}
    assert inodes["a.jpg"] == os.stat(tmp_path / "a.jpg").st_ino


def test_export_names(spark):
    wanted = spark.createDataFrame([(1, "a.jpg"), (2, "a.jpg"), (3, "b"), (4, "a (2).jpg"), (5, "c.png")], "id long, name string")
    got = {r["id"]: r["name"] for r in N.export_names(wanted, spark.createDataFrame([("a.jpg",), ("b",)], "name string")).collect()}
    assert len(set(got.values())) == 5 and not {"a.jpg", "b"} & set(got.values()) and got[5] == "c.png" and got[3] == "b (2)"


def test_export_names_are_the_first_free_ones(spark):
    wanted = [(k, "a.jpg") for k in range(1, 9)] + [(20, "a (4).jpg"), (21, "b.png"), (22, "b.png")]
    there = ["a.jpg", "a (3).jpg", "a (6).jpg", "a (40).jpg", "a (0).jpg", "b (2).png"]
    df = N.export_names(spark.createDataFrame(wanted, "id long, name string"), spark.createDataFrame([(t,) for t in there], "name string"))
    got = {r["id"]: r["name"] for r in df.collect()}
    assert got == {k + 1: f"a ({n}).jpg" for k, n in enumerate([2, 5, 7, 8, 9, 10, 11, 12])} | {20: "a (4).jpg", 21: "b.png", 22: "b (3).png"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "sequence(" not in plan  # no array of a name's clashes


# --- the store


def test_store_ids_are_not_given_again(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.commit(photo=photo_rows(spark, [(1, "a", 1, "embedded"), (7, "b", 2, "embedded")]))
    s.commit(photo=s.table("photo").where("id < 7"))
    assert s.next_id("photo") == 8 and Store(spark, str(tmp_path / "s")).next_id("photo") == 8
    again = Store(spark, str(tmp_path / "s"))
    s.commit(photo=s.table("photo"))
    with pytest.raises(RuntimeError):
        again.commit(photo=again.table("photo"))
    s.vacuum()
    assert len(os.listdir(tmp_path / "s" / "photo")) == 1 and s.table("photo").count() == 1
    assert s.table("person").schema == schema("person")


def test_changes_are_read_over_the_base(spark, tmp_path, monkeypatch):
    """Changes of rows, new rows and removals against a dictionary, before and after levels become one and a new base; old snapshots stay readable."""
    from kinlens.sources import store as module

    monkeypatch.setattr(module, "MOST_LEVELS", 3)
    s = Store(spark, str(tmp_path / "db"))
    rows = lambda of: spark.createDataFrame([(k, 1, 2, v, 0.0) for k, v in of.items()], schema("face_constraint"))
    held = lambda df: {r["id"]: r["kind"] for r in df.collect()}
    now = {k: "old" for k in range(1, 61)}
    s.commit(face_constraint=rows(now))
    old, before, rng, shapes = s.table("face_constraint"), dict(now), np.random.default_rng(2), []
    for step in range(9):
        gone = [int(x) for x in rng.choice(sorted(now), 2, replace=False)] if step % 3 else []
        new = {int(k): f"s{step}" for k in rng.choice(sorted(now), 2 if step < 6 else 30, replace=False)} | {100 + step: "new"}
        s.commit({"face_constraint": (rows(new), spark.createDataFrame([(k,) for k in gone if k not in new], "id long"))})
        for k in gone:
            now.pop(k, None)
        now |= {k: v for k, v in new.items() if k not in gone or k in new}
        entry = s.manifest["tables"]["face_constraint"]
        shapes.append((len(entry["levels"]), entry["n"]))
        assert held(s.table("face_constraint")) == now and held(Store(spark, str(tmp_path / "db")).table("face_constraint")) == now
    assert {n for _, n in shapes} > {60} and max(n for n, _ in shapes) == 3 and shapes[3] == (1, 60)  # one level out of four, later a new base
    assert held(old) == before and s.next_id("face_constraint") == 109
    s.vacuum()
    assert held(s.table("face_constraint")) == now
    s.commit({"person": (spark.createDataFrame([(5, None, None, False, None, 0, None, None, 0.0, 0.0)], schema("person")), None)})
    assert [r["id"] for r in s.table("person").collect()] == [5] and s.next_id("person") == 6


def test_a_correction_writes_its_rows_alone(spark, tmp_path):
    library = Library(spark, str(tmp_path / "db"))
    photos = [(k, 1, f"{k}.jpg", None, None, 0.0, 1, None, None, None, None, None, "embedded", 1, None, None, None, None, False) for k in range(1, 4001)]
    people = [(k, f"P{k}", None, False, None, 1, None, None, 0.0, 0.0) for k in range(1, 301)]
    library.store.commit(photo=spark.createDataFrame(photos, schema("photo")).coalesce(1), person=spark.createDataFrame(people, schema("person")))
    def size(table):
        return {d: sum(f.stat().st_size for f in d.glob("*.parquet")) for d in (tmp_path / "db" / table).iterdir()}
    base = size("photo"), size("person")
    library.set_favorite([7, 9])
    library.name(4, " Ann ")
    library.set_favorite([9], False)
    entry = library.store.manifest["tables"]
    assert [x["n"] for x in entry["photo"]["levels"]] == [2, 1] and [x["n"] for x in entry["person"]["levels"]] == [1]
    assert set(base[0]) < set(size("photo")) and set(base[1]) < set(size("person"))
    assert [r["id"] for r in library.photos.where("favorite").collect()] == [7] and library.photos.count() == 4000
    assert library.persons.where("id = 4").first()["display_name"] == "Ann" and library.persons.count() == 300


def test_store_recovers(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.commit(photo=photo_rows(spark, [(1, "a", 1, "embedded")]))
    (tmp_path / "s" / "manifests" / "99999999.json").write_text("{")
    fresh = Store(spark, str(tmp_path / "s"))
    assert fresh.table("photo").count() == 0 and any(".corrupt-" in n for n in os.listdir(tmp_path))


def test_roots_and_metadata(spark):
    r = with_root(with_root(empty(spark, "root"), "/a", "V", b"x", 1.0, 1), "/a", None, None, 2.0, 2).collect()
    assert [(x["id"], x["volume_uuid"], bytes(x["bookmark"])) for x in r] == [(1, None, b"x")]
    p = photo_rows(spark, [(1, "a", 1, "embedded")])
    new = lambda lat: spark.createDataFrame([(1, None, None, None, lat, None)], "id long, width int, height int, taken_at double, gps_lat double, gps_lon double")
    assert with_metadata(with_metadata(p, new(3.5)), new(None)).first()["gps_lat"] == 3.5


# --- the library


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have this module


class Faces(NoDetector):
    """A face over the whole image, if it isn't flat."""

    def faces(self, pixels):
        return [Found((0.0, 0.0, 1.0, 1.0), quality=0.9), Found((0.0, 0.0, 1.0, 1.0), quality=0.1)] if np.ptp(pixels) else []


def picture(seed, jitter=0):
    rng = np.random.default_rng(seed)
    base = np.kron(rng.integers(30, 220, (8, 8)), np.ones((8, 8)))
    return D.to_pgm(np.clip(base + np.random.default_rng(jitter).integers(-3, 4, base.shape), 0, 255))


def test_library_end_to_end(spark, tmp_path):
    root, db = tmp_path / "lib", str(tmp_path / "db")
    tree(root, {"a1.pgm": picture(1, 1), "a2.pgm": picture(1, 2), "b1.pgm": picture(2, 1), "b2.pgm": picture(2, 2), "flat.pgm": D.to_pgm(np.full((16, 16), 9)), "bad.jpg": b"nothing", "v.mov": b"film"})
    before = digest(root)
    lib = Library(spark, db, Models(detector=Faces))
    r = lib.index(str(root), now=1.0)
    assert r["scan"] == {"discovered": 7, "changed": 0, "unchanged": 0, "missing": 0, "videos": 1}
    assert r["process"] == {"processed": 5, "failures": 1, "faces": 4} and r["groups"]["people"] == 2
    assert digest(root) == before
    counts = lib.category_counts().first()
    assert (counts["no_faces"], counts["videos"], counts["people"]) == (2, 1, 2)
    ids = {r["relative_path"]: r["id"] for r in lib.photos.collect()}
    sets = sorted((r["set_id"], r["id"]) for r in lib.duplicate_sets().collect())
    assert {ids["a1.pgm"], ids["a2.pgm"]} <= {i for _, i in sets}
    people = [r["id"] for r in lib.people().collect()]
    lib.name(people[0], "  Ada ")
    # a second pass retries what failed and finds nothing new; ids and names stay
    again = lib.index(str(root), now=2.0)
    assert again["scan"]["unchanged"] == 7 and again["process"] == {"processed": 0, "failures": 1, "faces": 0}
    assert {r["id"]: r["display_name"] for r in lib.people().collect()} == {people[0]: "Ada", people[1]: None}
    # a rename keeps the row and its faces
    os.rename(root / "a1.pgm", root / "renamed.pgm")
    lib.scan(1, now=3.0)
    assert lib.faces_in(ids["a1.pgm"]).count() == 1 and lib.photos.where(F.col("id") == ids["a1.pgm"]).first()["relative_path"] == "renamed.pgm"
    lib.set_favorite([ids["b1.pgm"]])
    lib.scan(1, now=4.0)
    assert [r["id"] for r in lib.favorites().collect()] == [ids["b1.pgm"]]
    out = tmp_path / "out"
    out.mkdir()
    (out / "b1.pgm").write_bytes(b"")
    assert lib.export_photos([ids["b1.pgm"], ids["b2.pgm"], 999], str(out)) == {"exported": 2, "missing": 0, "failed": 1}
    assert sorted(os.listdir(out)) == ["b1 (2).pgm", "b1.pgm", "b2.pgm"]
    os.remove(root / "b2.pgm")
    d = lib.delete_photos([ids["b1.pgm"], ids["b2.pgm"], 999], FolderTrash(str(tmp_path / "trash")), now=5.0)
    assert d == {"trashed": 1, "missing": 1, "failed": 0, "removed_people": 1} and os.listdir(tmp_path / "trash") == ["b1.pgm"]
    say = io.StringIO()
    assert cli.main(["--db", db, "people"], spark, say) == 0 and cli.main(["--db", db, "photos", str(people[0])], spark, say) == 0 and cli.main(["--db", db, "faces", str(ids["a2.pgm"])], spark, say) == 0
    assert cli.main(["--db", db, "delete", "1"], spark, say, ask=lambda _: "n") == 1
    assert "Ada: 2 faces" in say.getvalue() and "renamed.pgm" in say.getvalue() and "bbox [x=0.000" in say.getvalue()
    assert Library(spark, db).remove_root(1) == 5 and Library(spark, db).persons.count() == 0


def test_choosing_an_embedder(tmp_path):
    load = lambda path, name: (path, name)
    assert isinstance(choose_embedder(str(tmp_path)), PixelEmbedder)
    (tmp_path / "arcface.onnx").write_bytes(b"")
    assert choose_embedder(str(tmp_path), load=load)[1] == "arcface.buffalo_l"
    (tmp_path / "auraface.onnx").write_bytes(b"")
    assert choose_embedder(str(tmp_path), load=load)[1] == "auraface.v1"
    assert isinstance(choose_embedder(str(tmp_path), "fallback", load=load), PixelEmbedder)
    assert isinstance(choose_embedder(str(tmp_path)), PixelEmbedder)  # neither file is a model


def test_browse_cases(spark):
    photos = photo_rows(spark, [(1, "ab", 1, "embedded"), (2, "abc", 2, "embedded"), (3, "a", 3, "missing")])
    faces = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (1, None)], "photo_id long, person_id long")
    who = lambda ids, only=False: sorted(r["id"] for r in B.photos_for_people(photos, faces, ids, only).collect())
    assert who([1, 2]) == [1, 2] and who([1, 2], True) == [1] and who([3]) == [2] and who([]) == [] and who([1, 1]) == [1, 2, 3]
    members = spark.createDataFrame([(1, 1, 1, 10), (1, 2, 2, 5)], "set_id long, rank_in_set int, id long, size long")
    assert [r["id"] for r in B.pin(spark.createDataFrame([(1,)], "id long"), members, 2).collect()] == [2]
    assert B.duplicate_totals(members).first().asDict() == {"sets": 1, "photos": 2, "trim_count": 1, "trim_bytes": 5}
    roots = spark.createDataFrame([(1, "/a"), (2, "/b")], "id long, display_path string")
    change = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(B.affected_roots(roots, change("/a/x"))) == [1] and ids(B.affected_roots(roots, change("/z"))) == [1, 2]
    assert ids(B._roots_by_prefix(roots, change("/b/x", "/c"))) == [2]
    assert B.review_progress(2, 3)["total"] == 5


# --- streams


def test_quiet_sessions_batch_and_stream(spark, tmp_path):
    t = lambda s: f"2024-01-01T00:00:{s:06.3f}"
    roots = spark.createDataFrame([(1, "/a"), (2, "/b")], "id long, display_path string")
    rows = [("/a/x", t(0)), ("/a/y", t(1.5)), ("/b/z", t(1)), ("/a/w", t(9)), ("/c/no", t(2))]
    df = spark.createDataFrame(rows, "path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r["key"], r["n"], sorted(r["paths"])) for r in quiet_sessions(with_roots(df, roots)).collect())
    assert got == [(1, 1, ["/a/w"]), (1, 2, ["/a/x", "/a/y"]), (2, 1, ["/b/z"])]
    folder = tmp_path / "changes"
    folder.mkdir()
    assert CHANGES
    seen = []
    lines = lambda x: "\n".join(f'{{"path": "{p}", "ts": "{s}"}}' for p, s in x)
    (folder / "1.json").write_text(lines(rows))
    (folder / "2.json").write_text(lines([("/a/late", t(50))]))
    q = watch(with_roots(changes(spark, str(folder)), roots), lambda k, paths: seen.append((k, paths)), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(120)
    assert q.exception() is None
    merged = {}
    for k, paths in seen:
        merged.setdefault(k, set()).update(paths)
    assert merged == {1: {"/a/x", "/a/y", "/a/w"}, 2: {"/b/z"}}


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from kinlens.tables import shared_folder

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, applicationId="x"))
    assert shared_folder(session("yarn", "/shared")) == "/shared" and os.path.isdir(shared_folder(session("local[4]", None)))
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://host:7077", None))


def test_every_root_with_a_change_is_affected(spark):
    """1500 roots of different lengths, each with a change; a root holds what begins with its path."""
    roots = spark.range(1500).select("id", F.concat(F.lit("/r"), F.repeat(F.lit("x"), F.col("id").cast("int")), F.lit("_")).alias("display_path"))
    changes_ = roots.select(F.concat("display_path", F.lit("/photo.jpg")).alias("path"))
    assert B.affected_roots(roots, changes_).count() == 1500
    assert B.affected_roots(roots, changes_.where(F.length("path") < 20)).count() == len([i for i in range(1500) if i + 3 + 10 < 20])
    some = spark.createDataFrame([(1, "/lib/A"), (2, "/lib/AB"), (3, "/lib/C")], "id long, display_path string")
    hit = some.sparkSession.createDataFrame([("/lib/AB/x",), (None,)], "path string")
    assert sorted(r["id"] for r in B.affected_roots(some, hit).collect()) == [1, 2]
    ts = hit.select("path", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    assert sorted((r["key"], r["path"]) for r in with_roots(ts, some).collect()) == [(1, "/lib/AB/x"), (2, "/lib/AB/x")]


def test_watch_gives_roots_alone(spark, tmp_path):
    roots = spark.createDataFrame([(1, "/a"), (2, "/b")], "id long, display_path string")
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(f'{{"path": "/a/{k}", "ts": "2024-01-01T00:00:00Z"}}' for k in range(20)))
    (folder / "2.json").write_text('{"path": "/b/late", "ts": "2024-01-01T01:00:00Z"}')
    seen = []
    q = watch(with_roots(changes(spark, str(folder)), roots), lambda k, paths: seen.append((k, paths)), str(tmp_path / "cp"), with_paths=False, availableNow=True)
    q.awaitTermination(120)
    assert q.exception() is None and set(map(str, seen)) == {"(1, [])"}


@pytest.mark.parametrize("root", ["hdfs://nn:8020/lib", "s3a://bucket/lib", "file:/lib", "file:///lib", "/lib", "viewfs://store/lib/"])
def test_remote_listings_keep_folders(spark, monkeypatch, root):
    from pyspark.sql import DataFrameReader

    stem = root.rstrip("/")
    at = spark.createDataFrame([(f"{stem}/a/b.jpg", 1.0, 5), (f"{stem}/c.jpg", 1.0, 5), (f"{stem}/d e/f#1.png", 1.0, 5)], "path string, modificationTime double, length long")
    monkeypatch.setattr(DataFrameReader, "load", lambda self, path: at)
    assert sorted(r["relative_path"] for r in N.listed(spark, root).collect()) == ["a/b.jpg", "c.jpg", "d e/f#1.png"]


def test_export_with_numbers_beyond_integers(spark):
    names = spark.createDataFrame([(1, "x.jpg"), (2, "x.jpg")], "id long, name string")
    taken = spark.createDataFrame([("x (99999999999).jpg",), (f"x ({'9' * 30}).jpg",), ("x (2).jpg",)], "name string")
    assert sorted(tuple(r) for r in N.export_names(names, taken).collect()) == [(1, "x.jpg"), (2, "x (3).jpg")]


def test_a_manifest_that_is_no_object_is_put_aside(spark, tmp_path):
    (tmp_path / "db" / "manifests").mkdir(parents=True)
    (tmp_path / "db" / "manifests" / "00000001.json").write_text("[1, 2]")
    assert Store(spark, str(tmp_path / "db")).manifest["snapshot"] == 0
    assert [p for p in tmp_path.iterdir() if "corrupt" in p.name]


def jpeg(spark, pixels, progressive=False):
    """A JPEG file as the JVM writes it."""
    j = spark._jvm
    height, width = pixels.shape[:2]
    picture = j.java.awt.image.BufferedImage(width, height, 10 if pixels.ndim == 2 else 1)
    for y in range(height):
        for x in range(width):
            if pixels.ndim == 2:
                picture.getRaster().setSample(x, y, 0, int(pixels[y, x]))
            else:
                picture.setRGB(x, y, int.from_bytes(bytes(pixels[y, x].tolist()), "big"))
    out = j.java.io.ByteArrayOutputStream()
    writer = j.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    settings = writer.getDefaultWriteParam()
    settings.setCompressionMode(2)
    settings.setCompressionQuality(0.95)
    if progressive:
        settings.setProgressiveMode(1)
    writer.setOutput(j.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, j.javax.imageio.IIOImage(picture, None, None), settings)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


def scene(height=45, width=53):
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([128 + 100 * np.sin(x / 9), 128 + 100 * np.cos(y / 7), (3 * x + 2 * y) % 256 * 0 + 90 + x], 2).clip(0, 255).astype(np.uint8)


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg_pixels(spark, progressive):
    pixels = scene()
    content = jpeg(spark, pixels, progressive)
    got = D.decode(content)
    assert got.shape == pixels.shape and np.abs(got.astype(int) - pixels).mean() < 4
    picture = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(bytearray(content)))
    theirs = np.array([[[picture.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(pixels.shape[1])] for y in range(pixels.shape[0])])
    assert np.abs(got.astype(int) - theirs).mean() < 1.5  # they smooth what they spread
    gray = D.decode(jpeg(spark, pixels[..., 0], progressive))
    assert gray.ndim == 2 and np.abs(gray.astype(int) - pixels[..., 0]).max() < 12
    assert abs(bin((I.dhash_bits(I.shrink_gray(got)) ^ I.dhash_bits(I.shrink_gray(pixels))) & (1 << 64) - 1).count("1")) <= 3
    for broken in (content[:200], content[:-40], content[:2], b"\xff\xd8" + bytes(50), content[:30] + content[60:]):
        assert D.decode(broken) is None or D.decode(broken).ndim >= 2
    assert D.decode(content[: len(content) // 2]) is None


ODD_NAMES = ("_DSC0001.pgm", "_raw/z.pgm", "Screenshot 12:30:01.pgm", "sub [1]/new {x}*.pgm", "in/_IMG.pgm", "é \U0001f600.pgm", "a#b%20c?.pgm")


def test_pending_files_are_read_by_their_names(spark, tmp_path):
    """Names that Spark's file sources hide or can't spell; a file that can't be read has no content, and the others theirs."""
    folder = tmp_path / "photos"
    tree(folder, {n: D.to_pgm(np.full((9, 9), k)) for k, n in enumerate(ODD_NAMES)} | {"wrong.pgm": b"P5 no", "big.pgm": b"P5 2 2 255\n" + b"x" * 5000})
    for root in (str(folder), f"file://{folder}", f"file:{folder}"):
        found = {r["relative_path"]: r["size"] for r in N.listed_with_inodes(spark, root).collect()}
        assert set(found) == {*ODD_NAMES, "wrong.pgm", "big.pgm"} and found["big.pgm"] == 5011
        paths = [(k, f"{root}/{n}", 94) for k, n in enumerate([*ODD_NAMES, "gone.pgm"])] + [(99, None, None), (100, f"{root}/big.pgm", 5011), (101, root, 0)]
        got = {r["id"]: r["content"] for r in contents(spark.createDataFrame(paths, "id long, path string, size long"), longest=5000).collect()}
        assert got == {k: D.to_pgm(np.full((9, 9), k)) for k in range(len(ODD_NAMES))} | {len(ODD_NAMES): None, 99: None, 100: None, 101: None}
    assert contents(spark.createDataFrame([], "id long, path string, size long")).collect() == []
    library = Library(spark, str(tmp_path / "db"))
    library.index(str(folder))
    states = {r["relative_path"]: r["state"] for r in library.photos.collect()}
    assert states == {n: "embedded" for n in (*ODD_NAMES, "big.pgm")} | {"wrong.pgm": "failed"}
    assert library.index(str(folder))["scan"]["unchanged"] == len(states)


def test_folders_are_listed_in_rounds(spark, tmp_path):
    """A folder of many names is looked up in many tasks, deep folders come in rounds, and links, packages and hidden files stay out."""
    folder = tmp_path / "photos"
    tree(folder, {f"flat/{k}.jpg": b"x" * (k % 7) for k in range(300)} | {"a/b/c/d/e.jpg": b"1", "x.app/e.jpg": b"", ".h/e.jpg": b"", "a/.h.jpg": b"", "app/e.jpg": b""})
    (folder / "a" / "loop").symlink_to(folder)
    (folder / "link.jpg").symlink_to(folder / "flat" / "1.jpg")
    (folder / "empty").mkdir()
    found = files_under(spark, str(folder) + "/")
    rows = {r["relative_path"]: r for r in found.collect()}
    assert set(rows) == {*(f"flat/{k}.jpg" for k in range(300)), "a/b/c/d/e.jpg", "app/e.jpg"}
    s = os.stat(folder / "flat" / "5.jpg")
    r = rows["flat/5.jpg"]
    assert (r["size"], r["file_id"], r["volume_uuid"], r["mtime"]) == (5, s.st_ino, str(s.st_dev), s.st_mtime)
    assert len(found.inputFiles()) > 1
    assert files_under(spark, str(folder / "empty")).collect() == []
    with pytest.raises(Exception, match="NotADirectoryError"):
        files_under(spark, str(tmp_path / "none"))


def test_a_removed_root_is_not_watched_back(spark, tmp_path):
    folder, drop = tmp_path / "photos", tmp_path / "changes"
    tree(folder, {"a.pgm": D.to_pgm(np.full((9, 9), 1))})
    drop.mkdir()
    library = Library(spark, str(tmp_path / "db"))
    library.index(str(folder))
    (drop / "1.json").write_text("\n".join(f'{{"path": "{folder}/{n}", "ts": "2024-01-01T0{h}:00:00Z"}}' for h, n in ((0, "a.pgm"), (1, "late"))))
    (drop / "2.json").write_text(f'{{"path": "{folder}/later", "ts": "2024-01-01T03:00:00Z"}}')
    changed = changes(spark, str(drop))
    roots = library.roots
    library.remove_root(roots.first()["id"])
    library_roots, Library.roots = Library.roots, property(lambda self: roots)
    try:
        started = library.watch(changed, str(tmp_path / "cp"), availableNow=True)
    finally:
        Library.roots = library_roots
    started.awaitTermination(120)
    assert started.exception() is None and library.roots.isEmpty() and library.photos.isEmpty()


def test_a_program_without_the_repository_on_its_path(tmp_path):
    """Workers get the package from the driver: nothing on PYTHONPATH, another working folder."""
    folder = tmp_path / "photos"
    tree(folder, {"_DSC1.pgm": D.to_pgm(np.full((9, 9), 7))})
    root = str(Path(__file__).resolve().parents[1])
    program = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from kinlens.plans.library import Library
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
library = Library(spark, {str(tmp_path / "db")!r})
library.index({str(folder)!r})
print("STATES", [r["state"] for r in library.photos.collect()])
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "STATES ['embedded']" in done.stdout, done.stderr[-3000:]
