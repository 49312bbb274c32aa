"""The library: scans, groups, browses and corrects, over a snapshot store. Every change is one published snapshot."""

from __future__ import annotations

import os
import shutil
import threading
import time
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import browse as B
from ..operators import clustering as C
from ..operators import review as R
from ..operators import similarity as S
from ..operators.order import numbered
from ..sources import inventory as N
from ..sources.files import contents
from ..sources.store import Store, dead_constraints, with_metadata, with_root, with_values, without_photos
from ..tables import schema, written
from .features import Models, face_rows, features, photo_columns


class Trash(Protocol):
    def trash(self, path: str) -> None: ...


class FolderTrash:
    """Moves files into a folder, from where they can be taken back."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def trash(self, path: str) -> None:
        os.makedirs(self.folder, exist_ok=True)
        name, n = os.path.basename(path), 1
        stem, ext = os.path.splitext(name)
        while os.path.exists(os.path.join(self.folder, name)):
            n += 1
            name = f"{stem} ({n}){ext}"
        shutil.move(path, os.path.join(self.folder, name))


class Library:
    """The public entry: a store's folder, models and thresholds."""

    def __init__(self, spark: SparkSession, path: str, models: Models | None = None, config: C.Config | None = None) -> None:
        self.spark, self.store = spark, Store(spark, path)
        self.models, self.config = models or Models(), config or C.Config()

    roots = property(lambda self: self.store.table("root"))
    photos = property(lambda self: self.store.table("photo"))
    persons = property(lambda self: self.store.table("person"))
    faces = property(lambda self: self.store.table("face"))
    constraints = property(lambda self: self.store.table("face_constraint"))

    # scanning

    def add_root(self, path: str, volume: str | None = None, bookmark: bytes | None = None, now: float | None = None) -> int:
        """The root's id; a folder that is known keeps its own."""
        path = path.rstrip("/")
        self.store.commit(root=with_root(self.roots, path, volume, bookmark, now or time.time(), self.store.next_id("root")))
        return self.roots.where(F.col("display_path") == path).first()["id"]

    def scan(self, root_id: int, listing: DataFrame | None = None, now: float | None = None) -> dict[str, int]:
        """Bring the photos of a root up to date with a listing of it; counts of what changed."""
        root = self.roots.where(F.col("id") == root_id).first()
        generation = root["scan_generation"] + 1
        listing = listing if listing is not None else N.listed_with_inodes(self.spark, root["display_path"])
        diff = written(N.scan_diff(self.photos, listing, root_id, generation), "diff")
        fresh = numbered(diff.where("status = 'inserted'").drop("id"), [F.col("relative_path")], self.store.next_id("photo"), "id")
        rest = diff.where("status <> 'inserted'")
        own = rest.unionByName(fresh.select(*rest.columns)).select(*self.photos.columns)
        photos = self.photos.where(F.col("root_id") != root_id).unionByName(own)
        roots = self.roots.withColumns({"scan_generation": F.when(F.col("id") == root_id, generation).otherwise(F.col("scan_generation")), "last_scanned_at": F.when(F.col("id") == root_id, float(now or time.time())).otherwise(F.col("last_scanned_at"))})
        report = N.scan_report(diff).first().asDict()
        self.store.commit(photo=photos, root=roots)
        return report

    def process(self, now: float | None = None) -> dict[str, int]:
        """Features of all photos that need them, each from its own root's file: faces, category, metadata, hash and state."""
        now = float(now or time.time())
        todo = B.needing_processing(self.photos)
        paths = written(B.full_paths(todo, self.roots, "size"), "paths")
        if paths.isEmpty():
            return {"processed": 0, "faces": 0, "failures": 0}
        raw = written(features(contents(paths), self.models), "features")
        columns = written(photo_columns(raw, paths.select("id", X.last_component(F.col("path")).alias("name"))), "columns")
        state = columns.select("id", F.when(F.col("failed"), "failed").otherwise("embedded").alias("state"), F.when(~F.col("failed"), F.lit(now)).alias("indexed_at"))
        photos = self.photos.join(columns.select("id"), "id", "left_semi").select(*self.photos.columns)
        photos = with_metadata(photos, columns)
        photos = with_values(photos, columns.where(~F.col("failed")).select("id", "category", "pet_kind", "phash"))
        photos = with_values(photos, state)
        made = numbered(face_rows(raw, now), [F.col("photo_id"), F.col("nth")], self.store.next_id("face"), "id").drop("nth")
        gone = self.faces.join(paths.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").select("id")
        gone = written(gone, "gone")
        report = columns.agg(F.count_if(~F.col("failed")).alias("processed"), F.count_if("failed").alias("failures")).first().asDict()
        self.store.commit({"photo": (photos, None), "face": (made.select(*self.faces.columns), gone), "face_constraint": (None, dead_constraints(self.constraints, gone))})
        return report | {"faces": raw.select(F.sum(F.size("found"))).first()[0] or 0}

    def index(self, path: str, listing: DataFrame | None = None, now: float | None = None, progress: Callable[[str, dict], None] = lambda phase, counts: None) -> dict:
        """Scan a folder, compute what is missing, and group the faces; ``progress`` hears of each phase with its counts."""
        report: dict = {}
        for phase, step in (("scan", lambda: self.scan(self.add_root(path, now=now), listing, now)), ("process", lambda: self.process(now)), ("groups", lambda: self.cluster_after_scan(now=now))):
            progress(phase, {})
            report[phase] = step()
            progress(phase, report[phase])
        return report

    def index_all(self, paths: Iterable[str], now: float | None = None) -> dict:
        """Index folders one after the other: sums of their counts, but the people are those after the last."""
        total: dict = {}
        for p in paths:
            for phase, counts in self.index(p, now=now).items():
                for k, v in counts.items():
                    held = total.setdefault(phase, {})
                    held[k] = v if k == "people" else held.get(k, 0) + v
        return total

    def watch(self, changed: DataFrame, checkpoint: str, **options):
        """Index a root anew whenever a stream of changes (path, ts) under it is quiet; start it again when roots come or go."""
        from ..streaming.watch import watch, with_roots

        return watch(with_roots(changed, self.roots), self._rescan, checkpoint, with_paths=False, **options)

    def _rescan(self, root: int, _: list[str]) -> None:
        known = self.roots.where(F.col("id") == root).first()
        if known is not None:  # else removed meanwhile: it stays so
            self.index(known["display_path"])

    def follow(self, journal: str, checkpoint: str, stop: threading.Event, every: float = 5.0, **options) -> None:
        """Watch the roots until ``stop`` is set: list them every few seconds, and index those anew whose changes are quiet. Roots that come, go, or
        can't be reached for a while are taken up with the next listing."""
        from ..streaming.folders import Journal, supervise
        from ..streaming.watch import watch

        kept = Journal(self.spark, journal)
        supervise(lambda: kept.observe(self.roots), lambda: watch(kept.stream(), self._rescan, checkpoint, with_paths=False, **options), every, stop)

    def take_faces(self, new_faces: DataFrame, checkpoint: str, name: str = "faces", **trigger):
        """Give people to a stream of new faces (columns of the face table; ids are given here), batch after batch: see :meth:`assign_batch`."""
        from ..streaming.watch import assign_stream

        return assign_stream(new_faces, lambda batch, n: self.assign_batch(batch, n, name), checkpoint, **trigger)

    def assign_batch(self, new_faces: DataFrame, batch: int, name: str = "faces", now: float | None = None) -> bool:
        """Add faces and give people to all that have none, against the centroids of the present snapshot; whether anything was done.

        Faces, people with their counts and centroids, and the batch's number are published together: a batch that comes again after a crash is
        done once. Faces that no one is near to stay without a person until a later batch makes enough of them. Only changed rows of faces are written.
        """
        done = self.store.mark(name)
        if done is not None and done >= batch:
            return False
        now = float(now or time.time())
        given = {"created_at": F.lit(now), "person_id": F.lit(None)}
        types = {f.name: f.dataType for f in schema("face").fields}
        value = lambda c: F.col(c) if c in new_faces.columns and c != "person_id" else given.get(c, F.lit(None))
        fresh = written(new_faces.select(*[value(c).cast(t).alias(c) for c, t in types.items() if c != "id"]), "fresh")
        fresh = written(numbered(fresh, [F.col("photo_id"), F.col("bbox_x"), F.col("bbox_y"), F.xxhash64(F.col("embedding"))], self.store.next_id("face"), "id").select(*types), "new-faces")
        faces = self.faces.unionByName(fresh)
        found = written(C.assign_new(faces, self.persons, self.config, self.store.next_id("person")).where("person_id IS NOT NULL"), "assigned")
        old = with_values(self.faces.join(found, "id", "left_semi").select(*types), found.select("id", "person_id"))
        changed = written(old.unionByName(with_values(fresh, found.select("id", "person_id"))), "changed-faces")
        after = self.faces.join(changed, "id", "left_anti").select(*types).unionByName(changed)
        kinds = found.where("is_new").join(faces.select("id", F.coalesce("kind", F.lit("human")).alias("kind")), "id").select("person_id", "kind").distinct()
        touched = found.select("person_id").distinct()
        persons = written(R.refreshed(self.persons.unionByName(self._made(kinds, now)), after, now, touched), "people")
        self.store.commit({"face": (changed, None)}, {name: batch}, person=persons)
        return True

    def reclassify(self) -> int:
        """Categories of photos that have none and whose files are there; how many got one."""
        paths = written(B.full_paths(B.uncategorized(self.photos), self.roots, "size"), "paths")
        if paths.isEmpty():
            return 0
        raw = features(contents(paths), self.models)
        found = written(photo_columns(raw, paths.select("id", X.last_component(F.col("path")).alias("name"))).where("category IS NOT NULL").select("id", "category"), "categories")
        self.store.commit({"photo": (with_values(self.photos.join(found.select("id"), "id", "left_semi").select(*self.photos.columns), found), None)})
        return found.count()

    # grouping

    def recluster(self, now: float | None = None) -> dict[str, int]:
        """Group all faces anew; people keep their ids by majority."""
        now = float(now or time.time())
        faces = self.faces
        if B.with_embeddings(faces).isEmpty():
            cleared = faces.withColumn("person_id", F.lit(None).cast("long"))
            self.store.commit(face=cleared, person=self.persons.limit(0))
            return {"faces": 0, "people": 0, "reused": 0, "new": 0}
        found = written(C.recluster(faces, self.constraints, self.persons, self.config, self.store.next_id("person")), "groups")
        made = found.where("NOT reused AND person_id IS NOT NULL").select("person_id", "kind").distinct()
        reused = found.where("reused").select("person_id").distinct().count()
        report = self._published(faces, found.select("id", "person_id"), made, now)
        return report | {"reused": reused, "people": reused + report["new"]}

    def cluster_after_scan(self, limit: int = C.FULL_LIMIT, now: float | None = None) -> dict[str, int]:
        """A full pass for few faces or no people; else new faces join people or form new ones."""
        faces = self.faces
        n = B.with_embeddings(faces).count()
        if C.full_pass_due(self.persons.count(), n, limit):
            return self.recluster(now)
        found = written(C.assign_new(faces, self.persons, self.config, self.store.next_id("person")), "assigned")
        kinds = found.where("is_new").join(faces.select("id", F.coalesce("kind", F.lit("human")).alias("kind")), "id").select("person_id", "kind").distinct()
        return self._published(faces, found.select("id", "person_id"), kinds, float(now or time.time())) | {"reused": 0}

    def _published(self, faces: DataFrame, assigned: DataFrame, new: DataFrame, now: float) -> dict[str, int]:
        moved = written(with_values(faces, assigned), "moved")
        touched = assigned.where("person_id IS NOT NULL").select("person_id").distinct()
        persons = written(R.refreshed(self.persons.unionByName(self._made(new, now)), moved, now, touched), "people")
        n_new = new.count()
        if n_new:
            top = new.agg(F.max("person_id")).first()[0]
            self.store.manifest["next_id"]["person"] = max(self.store.next_id("person"), top + 1)
        self.store.commit(face=moved, person=persons)
        return {"faces": B.with_embeddings(moved).count(), "people": B.people(persons).count(), "new": n_new}

    def _made(self, new: DataFrame, now: float) -> DataFrame:
        """Rows of new people (person_id, kind), without counts and centroids yet."""
        made = new.select(F.col("person_id").alias("id"), F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("long").alias("cover_face_id"), F.lit(False).alias("is_hidden"), F.lit(None).cast("array<double>").alias("centroid"), F.lit(0).cast("long").alias("face_count"), F.when(F.col("kind") != "human", F.col("kind")).alias("kind"), F.lit(None).cast("string").alias("model"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
        return made.select(*self.persons.columns)

    # corrections

    def suggest_merges(self, max_distance: float = R.DISTANCE, limit: int | None = R.LIMIT) -> DataFrame:
        return R.suggest_merges(self.persons, self.faces, self.constraints, max_distance, limit)

    def _answered(self, changes: dict[str, DataFrame]) -> bool:
        if changes:
            self.store.commit(**{k: written(v, k) for k, v in changes.items()})
        return bool(changes)

    def confirm_same(self, a: int, b: int, now: float | None = None) -> bool:
        return self._answered(R.confirm_same(self.persons, self.faces, self.constraints, a, b, float(now or time.time()), self.store.next_id("face_constraint")))

    def confirm_different(self, a: int, b: int, now: float | None = None) -> bool:
        return self._answered(R.confirm_different(self.persons, self.faces, self.constraints, a, b, float(now or time.time()), self.store.next_id("face_constraint")))

    def merge_people(self, source: int, target: int, now: float | None = None) -> bool:
        return self._answered(R.merge_people(self.persons, self.faces, self.constraints, source, target, float(now or time.time()), self.store.next_id("face_constraint")))

    def mark_not_person(self, photo_ids: Iterable[int], person_id: int, now: float | None = None) -> int:
        changes, n = R.mark_not_person(self.persons, self.faces, self.constraints, list(photo_ids), person_id, float(now or time.time()), self.store.next_id("person"), self.store.next_id("face_constraint"), self.config)
        self._answered(changes)
        return n

    def set_cover(self, person_id: int, photo_id: int, now: float | None = None) -> None:
        own = self.persons.where(F.col("id") == person_id)
        self.store.commit({"person": (R.set_cover(own, self.faces, person_id, photo_id, float(now or time.time())), None)})

    def learned_corrections(self) -> int:
        return self.constraints.count()

    def name(self, person_id: int, name: str | None, now: float | None = None) -> None:
        own = self.persons.where(F.col("id") == person_id)
        self.store.commit({"person": (own.withColumns({"display_name": X.cleaned(F.lit(name)), "updated_at": F.lit(float(now or time.time()))}), None)})

    def set_favorite(self, photo_ids: Iterable[int], on: bool = True) -> None:
        self.store.commit({"photo": (self.photos.where(F.col("id").isin(list(photo_ids))).withColumn("favorite", F.lit(on)), None)})

    # browsing

    def people(self, include_hidden: bool = False) -> DataFrame:
        return B.people(self.persons, include_hidden)

    def photos_for(self, person_ids: int | Iterable[int], exclusive: bool = False) -> DataFrame:
        if isinstance(person_ids, int):
            return B.photos_for_person(self.photos, self.faces, person_ids)
        return B.photos_for_people(self.photos, self.faces, person_ids, exclusive)

    def category_counts(self) -> DataFrame:
        return B.category_counts(self.photos, self.faces, self.persons)

    def in_category(self, category: str, limit: int | None = None) -> DataFrame:
        return B.in_category(self.photos, self.faces, category, limit)

    def duplicate_sets(self, max_hamming: int = S.MAX_HAMMING) -> DataFrame:
        return S.duplicate_sets(self.photos, max_hamming)

    def favorites(self) -> DataFrame:
        return B.favorites(self.photos)

    def recently_added(self, limit: int = B.RECENT) -> DataFrame:
        return B.recently_added(self.photos, limit)

    def faces_in(self, photo_id: int, person_id: int | None = None) -> DataFrame:
        return B.faces_in_photo(self.faces, photo_id, person_id)

    # leaving

    def remove_root(self, root_id: int, now: float | None = None, refresh_centroids: bool = False) -> int:
        """Forget a root, its photos and their faces; counts are renewed and, only if asked for, centroids."""
        gone = self.photos.where(F.col("root_id") == root_id).select("id")
        n = gone.count()
        faces = without_photos(self.photos, self.faces, self.constraints, gone)["face"]
        dead = written(self.faces.join(gone.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").select("id"), "dead")
        touched = faces.select("person_id").where("person_id IS NOT NULL").distinct() if refresh_centroids else None
        people = R.refreshed(self.persons, faces, float(now or time.time()), touched)
        removed = {"photo": (None, gone), "face": (None, dead), "face_constraint": (None, dead_constraints(self.constraints, dead))}
        self.store.commit(removed, root=self.roots.where(F.col("id") != root_id), person=people)
        return n

    def reset(self) -> None:
        """Forget everything; ids are not given again."""
        self.store.commit(**{t: self.store.table(t).limit(0) for t in ("root", "photo", "person", "face", "face_constraint")})

    def delete_photos(self, ids: Iterable[int], trash: Trash, now: float | None = None) -> dict[str, int]:
        """Move files to the trash and forget them; a file that is gone already is forgotten, too, and one that can't be moved is kept."""
        report = {"trashed": 0, "missing": 0, "failed": 0}
        chosen = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id long")
        plan = B.full_paths(self.photos.join(chosen, "id", "left_semi"), self.roots).join(self.photos.select("id", F.col("root_id")), "id").join(self.roots.select(F.col("id").alias("root_id"), F.lit(True).alias("known")), "root_id", "left")
        done = []
        for r in plan.collect():  # the photos that a person chose
            if not r["known"]:
                report["failed"] += 1
                continue
            try:
                if os.path.exists(r["path"]):
                    trash.trash(r["path"])
                    report["trashed"] += 1
                else:
                    report["missing"] += 1
                done.append((r["id"],))
            except OSError:
                report["failed"] += 1
        gone = self.spark.createDataFrame(done, "id long")
        touched = self.faces.join(gone.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").where("person_id IS NOT NULL").select("person_id").distinct()
        before = self.persons.count()
        faces = without_photos(self.photos, self.faces, self.constraints, gone)["face"]
        dead = written(self.faces.join(gone.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").select("id"), "dead")
        persons = written(R.refreshed(self.persons, faces, float(now or time.time()), touched), "people")
        self.store.commit({"photo": (None, gone), "face": (None, dead), "face_constraint": (None, dead_constraints(self.constraints, dead))}, person=persons)
        return report | {"removed_people": before - persons.count()}

    def export_photos(self, ids: Iterable[int], folder: str, copy: Callable[[str, str], None] = shutil.copy2) -> dict[str, int]:
        """Copy files into a folder under free names; sources stay as they are."""
        report = {"exported": 0, "missing": 0, "failed": 0}
        chosen = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id long")
        known = B.full_paths(self.photos.join(chosen, "id", "left_semi"), self.roots)
        there = [(r["id"], r["path"]) for r in known.collect()]  # the photos that a person chose
        report["failed"] = chosen.count() - len(there)
        here = [(i, p) for i, p in there if os.path.exists(p)]
        report["missing"] = len(there) - len(here)
        taken = self.spark.createDataFrame([(n,) for n in os.listdir(folder)], "name string")
        names = {r["id"]: r["name"] for r in N.export_names(self.spark.createDataFrame([(i, os.path.basename(p)) for i, p in here], "id long, name string"), taken).collect()}
        for i, p in here:
            try:
                copy(p, os.path.join(folder, names[i]))
                report["exported"] += 1
            except OSError:
                report["failed"] += 1
        return report
