"""``python -m kinlens.cli --db FOLDER COMMAND``: scan, people, photos, name, delete, faces, reclassify."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators.browse import full_paths
from .operators.clustering import Config
from .plans.features import Models, choose_embedder
from .plans.library import FolderTrash, Library


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinlens")
    p.add_argument("--db", default="kinlens-library", help="the store's folder")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="index a folder")
    scan.add_argument("path")
    scan.add_argument("--threshold", type=float, default=0.45, help="largest distance of a person's faces")
    scan.add_argument("--model", help="an ONNX face model")
    people = sub.add_parser("people", help="list people by face count")
    people.add_argument("--include-hidden", action="store_true")
    photos = sub.add_parser("photos", help="list a person's photos")
    photos.add_argument("person", type=int)
    name = sub.add_parser("name", help="name a person")
    name.add_argument("person", type=int)
    name.add_argument("name")
    delete = sub.add_parser("delete", help="move photos to the trash and forget them")
    delete.add_argument("photos", type=int, nargs="+")
    delete.add_argument("--yes", "-y", action="store_true")
    delete.add_argument("--trash", default="kinlens-trash")
    faces = sub.add_parser("faces", help="list the faces of a photo")
    faces.add_argument("photo", type=int)
    faces.add_argument("--person", type=int)
    sub.add_parser("reclassify", help="categories for photos without one")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout, ask=input) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("kinlens").getOrCreate()
    models = Models(face_embedder=lambda: choose_embedder(None, path=a.model)) if getattr(a, "model", None) else Models()
    lib = Library(spark, a.db, models, Config(threshold=getattr(a, "threshold", Config().threshold)))
    say = lambda *x: print(*x, file=out)
    if a.command == "scan":
        r = lib.index(a.path)
        say("Scan: " + ", ".join(f"{k} {v}" for k, v in r["scan"].items()))
        say("Processed: " + ", ".join(f"{k} {v}" for k, v in r["process"].items()))
        say("Groups: " + ", ".join(f"{k} {v}" for k, v in r["groups"].items()))
    elif a.command == "people":
        rows = lib.people(a.include_hidden).select("id", X.display_name(F.col("display_name")).alias("name"), "face_count").collect()
        for r in rows:
            say(f"[{r['id']}] {r['name']}: {r['face_count']} face{'s' * (r['face_count'] != 1)}")
        if not rows:
            say("No people yet.")
    elif a.command == "photos":
        rows = full_paths(lib.photos_for(a.person), lib.roots).orderBy("id").collect()
        for r in rows:
            say(f"[{r['id']}] {r['path']}")
        if not rows:
            say(f"No photos of person {a.person}.")
    elif a.command == "name":
        lib.name(a.person, a.name)
        say(f"Person {a.person} is {a.name}.")
    elif a.command == "delete":
        if not a.yes and not ask(f"Move {len(a.photos)} photo(s) to the trash? [y/N] ").lower().startswith("y"):
            say("Cancelled.")
            return 1
        say("Deleted: " + ", ".join(f"{k} {v}" for k, v in lib.delete_photos(a.photos, FolderTrash(a.trash)).items()))
    elif a.command == "faces":
        rows = lib.faces_in(a.photo, a.person).select("id", X.face_line(F.col("bbox_x"), F.col("bbox_y"), F.col("bbox_w"), F.col("bbox_h"), F.col("person_id")).alias("line")).orderBy("id").collect()
        for r in rows:
            say(f"face {r['id']} · {r['line']}")
        if not rows:
            say(f"No faces in photo {a.photo}.")
    else:
        say(f"Classified {lib.reclassify()} photos.")
    return 0


if __name__ == "__main__":
    sys.exit(main())
