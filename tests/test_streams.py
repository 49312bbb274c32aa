"""Changes of folders as a stream, across restarts and lost roots; faces given to people batch by batch."""

import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlens.operators import clustering as C
from kinlens.plans.library import Library
from kinlens.sources import images as D
from kinlens.streaming.folders import Journal, differences
from kinlens.streaming.watch import watch


def arrived(spark, journal, checkpoint):
    """Changes that a stream over the journal brings now, beyond those that its checkpoint knows of."""
    seen = []
    q = journal.stream().writeStream.foreachBatch(lambda b, _: seen.extend(b.where("key IS NOT NULL").collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted((r["key"], r["kind"], os.path.basename(r["path"]), r["moved_from"] and os.path.basename(r["moved_from"])) for r in seen)


def test_changes_arrive_once(spark, tmp_path):
    root, cp = tmp_path / "photos", tmp_path / "cp"
    (root / "in").mkdir(parents=True)
    for n in ("a.jpg", "b.jpg", "in/c.jpg", "_d.jpg", "notes.txt"):
        (root / n).write_bytes(b"1")
    roots = spark.createDataFrame([(1, str(root))], "id long, display_path string")
    journal = Journal(spark, str(tmp_path / "journal"))
    assert journal.observe(roots) == {} and arrived(spark, journal, cp) == []
    (root / "new.jpg").write_bytes(b"22")
    (root / "a.jpg").write_bytes(b"333")
    os.rename(root / "in" / "c.jpg", root / "moved.jpg")
    (root / "b.jpg").unlink()
    (root / "notes.txt").write_bytes(b"other")
    assert journal.observe(roots) == {"created": 1, "modified": 1, "renamed": 1, "deleted": 1}
    want = [(1, "created", "new.jpg", None), (1, "deleted", "b.jpg", None), (1, "modified", "a.jpg", None), (1, "renamed", "moved.jpg", "c.jpg")]
    assert arrived(spark, journal, cp) == want
    assert arrived(spark, journal, cp) == []
    # a new observer and a new stream go on from there; a draft that a crash left is no version
    draft = tmp_path / "journal" / "drafts" / "x" / "changes"
    draft.mkdir(parents=True)
    journal = Journal(spark, str(tmp_path / "journal"))
    (root / "later.jpg").write_bytes(b"4")
    assert journal.observe(roots) == {"created": 1} and not draft.exists()
    assert arrived(spark, journal, cp) == [(1, "created", "later.jpg", None)]
    journal.forget(journal.versions()[-1] + 5)
    assert len(journal.versions()) == 1 and arrived(spark, journal, cp) == []


def test_roots_come_and_go(spark, tmp_path):
    one, two, cp = tmp_path / "one", tmp_path / "two", tmp_path / "cp"
    for r in (one, two):
        r.mkdir()
        (r / "a.jpg").write_bytes(b"1")
    of = lambda *rows: spark.createDataFrame([(k, str(p)) for k, p in rows], "id long, display_path string")
    journal = Journal(spark, str(tmp_path / "journal"), settle=0.0)
    journal.observe(of((1, one)))
    assert journal.observe(of((1, one), (2, two))) == {}  # an added root's files are no changes
    (two / "b.jpg").write_bytes(b"1")
    os.rename(one, tmp_path / "away")
    assert journal.observe(of((1, one), (2, two))) == {"created": 1}  # and a lost root's files aren't deleted
    (tmp_path / "away" / "c.jpg").write_bytes(b"1")
    os.rename(tmp_path / "away", one)
    assert journal.observe(of((1, one), (2, two))) == {"created": 1}
    assert journal.observe(of((2, two))) == {}  # a removed root leaves without changes, and comes back as a new one
    (one / "d.jpg").write_bytes(b"1")
    assert journal.observe(of((1, one), (2, two))) == {}
    assert arrived(spark, journal, cp) == [(1, "created", "c.jpg", None), (2, "created", "b.jpg", None)]
    n = len(journal.versions())
    assert journal.observe(of((1, one), (2, two))) == {} and len(journal.versions()) == n  # nothing to tell
    assert journal.observe(of()) == {} and journal.observe(of()) == {}


def test_differences_of_odd_listings(spark):
    rows = "root_id long, relative_path string, volume_uuid string, file_id long, mtime double, size long"
    old = spark.createDataFrame([(1, "a", None, None, 1.0, 1), (1, "b", "v", 7, 1.0, 1), (1, "c", "v", 7, 1.0, 1), (2, "b", "v", 9, None, None)], rows)
    new = spark.createDataFrame([(1, "x", None, None, 1.0, 1), (1, "y", "v", 7, 1.0, 1), (1, "z", "v", 7, 1.0, 1), (2, "b", "v", 9, None, None)], rows)
    got = sorted((r["relative_path"], r["kind"], r["moved_from"]) for r in differences(old, new).collect())
    assert got == [("a", "deleted", None), ("c", "deleted", None), ("x", "created", None), ("y", "renamed", "b"), ("z", "created", None)]


def test_quiet_changes_are_told_without_later_ones(spark, tmp_path):
    """Marks bring the watermark past the last change."""
    root = tmp_path / "photos"
    root.mkdir()
    roots = spark.createDataFrame([(1, str(root))], "id long, display_path string")
    journal = Journal(spark, str(tmp_path / "journal"))
    journal.observe(roots, 1000.0)
    (root / "a.jpg").write_bytes(b"1")
    assert journal.observe(roots, 1010.0) == {"created": 1}
    for t in (1012.0, 1016.0, 1020.0):
        assert journal.observe(roots, t) == {}
    assert len(journal.versions()) == 4  # the last one had nothing more to settle
    seen = []
    for _ in range(2):
        q = watch(journal.stream(), lambda k, paths: seen.append((k, paths)), str(tmp_path / "cp"), with_paths=False, availableNow=True)
        q.awaitTermination(120)
        assert q.exception() is None
    assert seen == [(1, [])]


def test_a_library_follows_its_roots(spark, tmp_path):
    root = tmp_path / "photos"
    root.mkdir()
    (root / "a.pgm").write_bytes(D.to_pgm(np.full((9, 9), 1)))
    library = Library(spark, str(tmp_path / "db"))
    library.index(str(root))
    stop, trouble = threading.Event(), []

    def run():
        try:
            library.follow(str(tmp_path / "journal"), str(tmp_path / "cp"), stop, every=0.5)
        except Exception as e:  # noqa: BLE001
            trouble.append(e)

    t = threading.Thread(target=run)
    t.start()
    try:
        journal = Journal(spark, str(tmp_path / "journal"))
        deadline = time.time() + 60
        while not journal.versions() and time.time() < deadline:
            time.sleep(0.5)
        (root / "b.pgm").write_bytes(D.to_pgm(np.full((9, 9), 2)))
        deadline = time.time() + 120
        while library.photos.count() < 2 and time.time() < deadline and t.is_alive():
            time.sleep(1)
    finally:
        stop.set()
        t.join(60)
    assert not trouble and library.photos.count() == 2


# --- faces


def near(rng, identity, n):
    base = np.zeros(16)
    base[identity] = 1.0
    return [[float(x) for x in base + rng.normal(0, 0.02, 16)] for _ in range(n)]


def face_rows(spark, vectors, first_photo):
    return spark.createDataFrame([(first_photo + k, "human", "m", v) for k, v in enumerate(vectors)], "photo_id long, kind string, model string, embedding array<float>")


def grouping(faces, key):
    groups = {}
    for r in faces.collect():
        groups.setdefault(r["person_id"], set()).add(r[key])
    return {frozenset(v) for k, v in groups.items() if k is not None}, groups.get(None, set())


def test_batches_of_faces_are_published_once(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    library = Library(spark, str(tmp_path / "db"))
    first = near(rng, 0, 4) + near(rng, 1, 4)
    assert library.assign_batch(face_rows(spark, first, 0), 0)
    assert library.persons.count() == 2
    second = near(rng, 0, 2) + near(rng, 2, 2)  # two that are near to a person, two too few for one
    before = library.store.manifest["snapshot"]

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:  # nothing of a batch that fails before it is published is seen
        m.setattr(library.store.files, "rename", crash)
        with pytest.raises(OSError):
            library.assign_batch(face_rows(spark, second, 100), 1)
    again = Library(spark, str(tmp_path / "db"))
    assert again.store.manifest["snapshot"] == before and again.faces.count() == 8
    assert again.assign_batch(face_rows(spark, second, 100), 1)
    state = again.store.manifest["snapshot"]
    assert not Library(spark, str(tmp_path / "db")).assign_batch(face_rows(spark, second, 100), 1)  # it comes again: done already
    again = Library(spark, str(tmp_path / "db"))
    assert again.store.manifest["snapshot"] == state and again.faces.count() == 12
    third = near(rng, 2, 2)
    assert again.assign_batch(face_rows(spark, third, 200), 2)
    ids = [r["id"] for r in again.faces.collect()]
    assert len(ids) == len(set(ids)) == 14
    # as one pass over all of them, since what is near is the same
    union = face_rows(spark, first, 0).union(face_rows(spark, second, 100)).union(face_rows(spark, third, 200))
    whole = union.withColumn("id", F.col("photo_id") + 1).withColumn("person_id", F.lit(None).cast("long"))
    want = C.assign_new(whole, again.persons.limit(0)).join(whole.select("id", "photo_id"), "id")
    assert grouping(again.faces, "photo_id") == grouping(want, "photo_id")
    counts = {r["id"]: r["n"] for r in again.faces.where("person_id IS NOT NULL").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("n")).collect()}
    assert {r["id"]: r["face_count"] for r in again.persons.collect()} == counts and again.persons.where("centroid IS NULL").isEmpty()


def test_a_stream_of_faces(spark, tmp_path):
    rng = np.random.default_rng(4)
    drop, library = tmp_path / "in", Library(spark, str(tmp_path / "db"))
    face_rows(spark, near(rng, 0, 4), 0).coalesce(1).write.parquet(str(drop / "1"))
    stream = lambda: spark.readStream.schema("photo_id long, kind string, model string, embedding array<float>").parquet(str(drop / "*"))
    for k in range(2):
        q = library.take_faces(stream(), str(tmp_path / "cp"), availableNow=True)
        q.awaitTermination(180)
        assert q.exception() is None and library.faces.count() == 4 + 3 * k and library.persons.count() == 1
        if not k:
            face_rows(spark, near(rng, 0, 3), 10).coalesce(1).write.parquet(str(drop / "2"))
