"""Browse queries over photos, faces, people and roots: filters, joins, counts and orders, all left to Catalyst.

Every ordered result has the order as its sort with ``id`` last, so ties are settled; the limits are parts of the queries
that have them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

RECENT = 300
CATEGORIES = ("screenshot", "document", "identity", "places", "no_faces", "pets", "video")


def newest() -> list[Column]:
    return [F.coalesce("taken_at", "mtime").desc(), F.col("id").asc()]


def latest_indexed() -> list[Column]:
    return [F.coalesce("indexed_at", F.lit(0.0)).desc(), F.col("id").asc()]


def with_rank(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Rows numbered from 1 in an order over all of them; for results that are one listing."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


# filters


def needing_processing(photos: DataFrame) -> DataFrame:
    return photos.where(F.col("state").isin("discovered", "failed"))


def uncategorized(photos: DataFrame) -> DataFrame:
    return photos.where(F.col("category").isNull() & (F.col("state") != "missing"))


def with_phash(photos: DataFrame) -> DataFrame:
    return photos.where(F.col("phash").isNotNull() & (F.col("state") != "missing"))


def favorites(photos: DataFrame) -> DataFrame:
    return photos.where("favorite").orderBy(*newest())


def without_faces(photos: DataFrame, faces: DataFrame) -> DataFrame:
    return photos.join(faces.select(F.col("photo_id").alias("id")), "id", "left_anti").where(F.coalesce(F.col("category"), F.lit("")) != "video")


def in_category(photos: DataFrame, faces: DataFrame, category: str, limit: int | None = None) -> DataFrame:
    """Photos of a category, newest first: places have coordinates, pets a pet kind, ``no_faces`` no row in faces and no video."""
    if category == "places":
        found = photos.where(F.col("gps_lat").isNotNull())
    elif category == "pets":
        found = photos.where(F.col("pet_kind").isNotNull())
    elif category == "no_faces":
        found = without_faces(photos, faces)
    else:
        found = photos.where(F.col("category") == category)
    found = found.orderBy(*newest())
    return found if limit is None else found.limit(limit)


def first_in_category(photos: DataFrame, faces: DataFrame, category: str) -> DataFrame:
    return in_category(photos, faces, category, 1)


def with_embeddings(faces: DataFrame) -> DataFrame:
    return faces.where(F.col("embedding").isNotNull())


def usable_vectors(faces: DataFrame) -> DataFrame:
    return faces.where(F.col("id").isNotNull() & (F.size("embedding") > 0))


def faces_in_photo(faces: DataFrame, photo_id: int, person_id: int | None = None) -> DataFrame:
    found = faces.where(F.col("photo_id") == photo_id)
    return found if person_id is None else found.where(F.col("person_id") == person_id)


def people(persons: DataFrame, include_hidden: bool = False) -> DataFrame:
    """By face count, most first."""
    found = persons if include_hidden else persons.where(~F.col("is_hidden"))
    return found.orderBy(F.col("face_count").desc(), "id")


def search_people(persons: DataFrame, query: str) -> DataFrame:
    """By part of the shown name, in any case; an empty query finds everyone."""
    wanted = query.strip().lower()
    return persons.where(F.lower(X.display_name(F.col("display_name"))).contains(wanted)) if wanted else persons


def online(photos: DataFrame, offline_roots: DataFrame) -> DataFrame:
    return photos.join(offline_roots.select(F.col("id").alias("root_id")), "root_id", "left_anti")


def affected_roots(roots: DataFrame, changes: DataFrame) -> DataFrame:
    """Roots that hold a changed path; all roots where none does. A root holds what begins with its path, as plain text."""
    hit = _roots_by_prefix(roots, changes)
    return roots if hit.isEmpty() else hit


def _roots_by_prefix(roots: DataFrame, changes: DataFrame) -> DataFrame:
    held = under_roots(changes.select("path").distinct(), roots).select("display_path").distinct()
    return roots.join(held, "display_path", "left_semi")


def under_roots(changes: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``changes`` (path, ...) with ``display_path``, once for each root whose path theirs begins with.

    Every length that a root's path has is cut from the paths, and those are equal or not: a join by keys, however many there are
    of either. There are as many lengths as the longest root's path has characters, at most.
    """
    lengths = sorted(r[0] for r in roots.where("display_path IS NOT NULL").select(F.length("display_path")).distinct().collect())
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path"))
    heads = changes.withColumn("_n", F.explode(fitting)).withColumn("display_path", F.substring("path", F.lit(1), F.col("_n"))).drop("_n")
    return heads.join(roots.select("display_path").distinct(), "display_path", "left_semi").select(*changes.columns, "display_path")


def full_paths(photos: DataFrame, roots: DataFrame, *more: str) -> DataFrame:
    """(id, path, ...) with ``more`` columns of photos: roots are a registry of folders, joined as Catalyst sees fit."""
    r = roots.select(F.col("id").alias("root_id"), "display_path")
    return photos.join(r, "root_id", "left").select("id", X.full_path(F.col("display_path"), F.col("relative_path")).alias("path"), *more)


def existing(photos: DataFrame, listing: DataFrame) -> DataFrame:
    """Photos whose file a fresh listing (root_id, relative_path) still has."""
    return photos.join(listing.select("root_id", "relative_path"), ["root_id", "relative_path"], "left_semi")


# joins


def photos_for_person(photos: DataFrame, faces: DataFrame, person_id: int) -> DataFrame:
    """Photos with a face of the person, newest first. A semi join: a photo comes once however many faces match."""
    hits = faces.where(F.col("person_id") == person_id).select(F.col("photo_id").alias("id"))
    return photos.join(hits, "id", "left_semi").orderBy(*newest())


def photos_for_people(photos: DataFrame, faces: DataFrame, person_ids: Iterable[int], exclusive: bool = False) -> DataFrame:
    """Photos with all of the people and, if exclusive, no other known person; none for no people.

    One pass over faces: the distinct people asked for are counted and the others flagged for each photo.
    """
    wanted = sorted(set(person_ids))
    asked = F.col("person_id").isin(wanted) if wanted else F.lit(False)
    known = faces.where(F.col("person_id").isNotNull() if exclusive else asked)
    per = known.groupBy(F.col("photo_id").alias("id")).agg(F.count_distinct(F.when(asked, F.col("person_id"))).alias("n"), F.count_if(~asked).alias("others"))
    hits = per.where((F.col("n") == len(wanted)) & (F.col("n") > 0) & (F.col("others") == 0))
    return photos.join(hits, "id", "left_semi").orderBy(*newest())


# aggregations


def counts_by_root(photos: DataFrame) -> DataFrame:
    """Photos of each root, missing ones included."""
    return photos.groupBy("root_id").agg(F.count("*").alias("n"))


def photo_counts(faces: DataFrame) -> DataFrame:
    """Distinct photos of each known person."""
    return faces.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.count_distinct("photo_id").alias("n"))


def face_counts(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """(id, face_count) of every person, 0 without faces."""
    n = faces.where(F.col("person_id").isNotNull()).groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("n"))
    return persons.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("face_count"))


def category_counts(photos: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """One row of eight counts, from one pass over photos; missing photos count."""
    seen = faces.select(F.col("photo_id").alias("id")).distinct().withColumn("has_face", F.lit(True))
    flagged = photos.select("id", "category", "gps_lat", "pet_kind").join(seen, "id", "left")
    category = lambda c: F.count_if(F.col("category") == c)
    counts = flagged.agg(
        category("screenshot").alias("screenshots"),
        category("document").alias("documents"),
        category("identity").alias("identity"),
        F.count_if(F.col("gps_lat").isNotNull()).alias("places"),
        F.count_if(F.col("has_face").isNull() & (F.coalesce("category", F.lit("")) != "video")).alias("no_faces"),
        F.count_if(F.col("pet_kind").isNotNull()).alias("pets"),
        category("video").alias("videos"),
    )
    return counts.crossJoin(persons.where(~F.col("is_hidden")).agg(F.count("*").alias("people")))  # a row by a row


def place_groups(photos: DataFrame) -> DataFrame:
    """(key, lat, lon, n): photos with coordinates by grid cell, at their mean."""
    located = photos.where(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull())
    return located.groupBy(X.grid_key(F.col("gps_lat"), F.col("gps_lon")).alias("key")).agg(F.avg("gps_lat").alias("lat"), F.avg("gps_lon").alias("lon"), F.count("*").alias("n"))


def source_count(photos: DataFrame) -> DataFrame:
    return photos.agg(F.count_distinct("root_id").alias("n"))


def face_boxes(faces: DataFrame, person_id: int) -> DataFrame:
    """(photo_id, boxes) of a person: every photo's boxes, ordered. A photo holds a handful of faces."""
    box = F.struct("bbox_x", "bbox_y", "bbox_w", "bbox_h")
    return faces.where(F.col("person_id") == person_id).groupBy("photo_id").agg(F.sort_array(F.collect_list(box)).alias("boxes"))


def duplicate_totals(members: DataFrame) -> DataFrame:
    """(sets, photos, trim_count, trim_bytes) of duplicate-set members (set_id, rank_in_set, size)."""
    rest = F.col("rank_in_set") > 1
    return members.agg(F.count_distinct("set_id").alias("sets"), F.count("*").alias("photos"), F.count_if(rest).alias("trim_count"), F.coalesce(F.sum(F.when(rest, F.col("size"))), F.lit(0)).alias("trim_bytes"))


def majority(votes: DataFrame, group: str, choice: str) -> DataFrame:
    """(group, choice, votes): the most frequent non-null choice of each group, ties to the smaller."""
    counted = votes.where(F.col(choice).isNotNull()).groupBy(group, choice).agg(F.count("*").alias("votes"))
    return counted.groupBy(group).agg(F.min_by(F.struct(choice, "votes"), F.struct(-F.col("votes"), F.col(choice))).alias("top")).select(group, f"top.{choice}", "top.votes")


# orders and positions


def all_by_taken(photos: DataFrame) -> DataFrame:
    return photos.orderBy(*newest())


def all_by_indexed(photos: DataFrame) -> DataFrame:
    return photos.orderBy(*latest_indexed())


def recently_added(photos: DataFrame, limit: int = RECENT) -> DataFrame:
    return photos.orderBy(*latest_indexed()).limit(limit)


def library_view(photos: DataFrame, faces: DataFrame, person_id: int | None = None, by_indexed: bool = False) -> DataFrame:
    if person_id is not None:
        return photos_for_person(photos, faces, person_id)
    return all_by_indexed(photos) if by_indexed else all_by_taken(photos)


def between(listing: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of a numbered listing from one position to another, in whichever order they are given."""
    return listing.where(F.col("position").between(min(first, last), max(first, last)))


def step(listing: DataFrame, position: int, by: int) -> DataFrame:
    """The neighbour of a position; none beyond the ends."""
    return listing.where(F.col("position") == position + by)


def trimmable(members: DataFrame, sets: Iterable[int] | None = None) -> DataFrame:
    """All but the best of each duplicate set, or of the chosen sets."""
    rest = members.where(F.col("rank_in_set") > 1)
    return rest if sets is None else rest.where(F.col("set_id").isin(list(sets)))


def pin(pins: DataFrame, members: DataFrame, photo_id: int) -> DataFrame:
    """Pins (id) with one photo pinned, and no other of its set."""
    its_set = members.where(F.col("id") == photo_id).select("set_id")
    others = members.join(its_set, "set_id", "left_semi").select("id")
    spark = members.sparkSession
    return pins.join(others, "id", "left_anti").unionByName(spark.createDataFrame([(photo_id,)], "id long"))


def review_progress(reviewed: int, remaining: int) -> dict[str, int]:
    return {"reviewed": reviewed, "remaining": remaining, "total": reviewed + remaining}
