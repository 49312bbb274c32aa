"""File inventories: listings of media files, and the difference of a listing to what is known."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..tables import written
from .files import PACKAGES, files_under

IMAGES = ("jpg", "jpeg", "png", "gif", "heic", "heif", "tif", "tiff", "bmp", "webp", "ppm", "pgm", "dng", "cr2", "nef", "arw")
MOVIES = ("mov", "mp4", "m4v", "avi", "mkv", "mpg", "mpeg", "webm", "3gp")
LISTING = "relative_path string, volume_uuid string, file_id long, mtime double, size long, is_video boolean"


#: A scheme and an authority (name node, bucket) with the slashes behind them.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*"


def plain_path(path: Column) -> Column:
    """A path within its file system, without scheme and authority."""
    return F.regexp_replace(path, SCHEME, "/")


def media_kind(name: Column) -> Column:
    """image, video, or null for other files, by extension."""
    e = F.lower(X.extension(name))
    return F.when(e.isin(*IMAGES), "image").when(e.isin(*MOVIES), "video")


def visible(relative: Column) -> Column:
    """Neither hidden nor within a package."""
    parts = F.split(relative, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    inside = F.exists(folders, lambda p: F.lower(X.extension(p)).isin(*PACKAGES))
    return ~F.exists(parts, lambda p: p.startswith(".")) & ~inside


def listed(spark: SparkSession, root: str) -> DataFrame:
    """A listing by Spark's own file source, for file systems that only Spark reads; inodes are not known there, and names that begin with ``_`` are
    hidden from it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    rows = files.withColumn("relative_path", X.relative_path(plain_path(F.col("path")), re.sub(SCHEME, "/", root)))
    return _media(rows.select("relative_path", F.lit(None).cast("string").alias("volume_uuid"), F.lit(None).cast("long").alias("file_id"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size")))


def _media(rows: DataFrame) -> DataFrame:
    kind = media_kind(F.col("relative_path"))
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull() & visible(F.col("relative_path"))).select("relative_path", "volume_uuid", "file_id", "mtime", "size", (F.col("kind") == "video").alias("is_video"))


def listed_with_inodes(spark: SparkSession, root: str) -> DataFrame:
    """A listing of the media under a folder that executors mount, with inodes, or under one of another file system by its scheme."""
    return _media(files_under(spark, root))


def scan_diff(photos: DataFrame, listing: DataFrame, root_id: int, generation: int) -> DataFrame:
    """Every photo of a root after a scan, with ``status``: inserted, changed, unchanged, missing, or absent (missing already).

    Paths match first. What is left of both sides matches by (volume_uuid, file_id): a moved file keeps its row. The rest of the
    listing is inserted, with a null id. A file whose time or size changed, or that was missing, is to be processed again;
    renamed and returned files count as unchanged. Videos to be processed are done at once. Unlike a file-by-file scan the
    result doesn't depend on the order of files.
    """
    known = written(photos.where(F.col("root_id") == root_id), "known")
    new = written(listing.select(*[F.col(c).alias(f"n_{c}") for c in ("relative_path", "volume_uuid", "file_id", "mtime", "size", "is_video")]), "listing")
    by_path = known.join(new, F.col("relative_path") == F.col("n_relative_path"))
    p_left = known.join(new, F.col("relative_path") == F.col("n_relative_path"), "left_anti")
    n_left = new.join(known, F.col("relative_path") == F.col("n_relative_path"), "left_anti")
    # of several rows with one file id, the first id moves to the first path
    p_first = p_left.where("volume_uuid IS NOT NULL AND file_id IS NOT NULL").groupBy("volume_uuid", "file_id").agg(F.min("id").alias("id"))
    n_first = n_left.where("n_volume_uuid IS NOT NULL AND n_file_id IS NOT NULL").groupBy("n_volume_uuid", "n_file_id").agg(F.min("n_relative_path").alias("n_relative_path"))
    moves = p_first.join(n_first, (F.col("volume_uuid") == F.col("n_volume_uuid")) & (F.col("file_id") == F.col("n_file_id"))).select("id", "n_relative_path")
    moves = written(moves, "moves")
    moved = p_left.join(moves, "id").join(new, "n_relative_path").select(*by_path.columns)
    matched = by_path.unionByName(moved)
    changed = (F.col("mtime") != F.col("n_mtime")) | (F.col("size") != F.col("n_size"))
    again = changed | F.col("state").isin("missing", "discovered")
    video = F.col("n_is_video") & again
    state = F.when(video, "embedded").when(changed | (F.col("state") == "missing"), "discovered").otherwise(F.col("state"))
    fields = {"relative_path": F.col("n_relative_path"), "volume_uuid": F.col("n_volume_uuid"), "file_id": F.col("n_file_id"), "mtime": F.col("n_mtime"), "size": F.col("n_size"), "scan_generation": F.lit(generation), "state": state, "category": F.when(video, "video").otherwise(F.col("category"))}
    kept = matched.select(*[fields.get(c, F.col(c)).alias(c) for c in photos.columns], F.when(changed, "changed").otherwise("unchanged").alias("status"), F.col("n_is_video").alias("is_video"))
    fresh = n_left.join(moves, "n_relative_path", "left_anti")
    made = {"root_id": F.lit(root_id).cast("long"), "relative_path": F.col("n_relative_path"), "volume_uuid": F.col("n_volume_uuid"), "file_id": F.col("n_file_id"), "mtime": F.col("n_mtime"), "size": F.col("n_size"), "scan_generation": F.lit(generation), "state": F.when(F.col("n_is_video"), "embedded").otherwise("discovered"), "category": F.when(F.col("n_is_video"), "video"), "favorite": F.lit(False)}
    types = {f.name: f.dataType for f in photos.schema.fields}
    inserted = fresh.select(*[made.get(c, F.lit(None)).cast(types[c]).alias(c) for c in photos.columns], F.lit("inserted").alias("status"), F.col("n_is_video").alias("is_video"))
    gone = p_left.join(moves, "id", "left_anti")
    lost = mark_missing(gone, generation).select(*photos.columns, "status", F.lit(False).alias("is_video"))
    return kept.unionByName(inserted).unionByName(lost)


def mark_missing(photos: DataFrame, generation: int) -> DataFrame:
    """Photos with ``status``: those of an older scan that weren't missing are, now."""
    older = F.col("scan_generation") < generation
    newly = older & (F.col("state") != "missing")
    return photos.withColumn("status", F.when(newly, "missing").otherwise("absent")).withColumn("state", F.when(newly, "missing").otherwise(F.col("state")))


def scan_report(diff: DataFrame) -> DataFrame:
    """(discovered, changed, unchanged, missing, videos) of a scan."""
    n = lambda s: F.count_if(F.col("status") == s)
    return diff.agg(n("inserted").alias("discovered"), n("changed").alias("changed"), n("unchanged").alias("unchanged"), n("missing").alias("missing"), F.count_if("is_video").alias("videos"))


def export_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, name): a free name for every wanted (id, name), in the order of ids; ``taken`` (name) are there already.

    The first free one of ``name``, ``name (2)``, ``name (3)``, ... where earlier rows' names count as taken too. A window over one
    name is one folder's clashes.
    """
    from pyspark.sql import Window

    named = wanted.where("name IS NOT NULL")
    rows = named.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("id")))
    # the numbers in use (one beyond all integers is none that a row could get): of ``stem (n).ext`` among what is there, n for the wanted name, 1 for the name itself
    numbered_ = F.regexp_extract("name", r"^(.*) \((\d+)\)(\.[^.]+)?$", 2)
    base = F.regexp_replace("name", r"^(.*) \((\d+)\)(\.[^.]+)?$", "$1$3")
    # wanted names can themselves be numbered forms of others: they are taken, too
    all_taken = taken.select("name").unionByName(wanted.select("name")).distinct()
    used = all_taken.where(numbered_ != "").select(base.alias("name"), numbered_.try_cast("long").alias("n")).unionByName(taken.select("name", F.lit(1).alias("n"))).distinct()
    # a used number shifts those rows that have no more free numbers before theirs than lie under it
    under = F.col("n") - F.row_number().over(Window.partitionBy("name").orderBy("n"))
    marks = used.where("n >= 1").select(F.lit(None).cast(wanted.schema["id"].dataType).alias("id"), "name", under.alias("at"), F.lit(0).alias("side"))
    both = rows.select("id", "name", (F.col("k") - 1).alias("at"), F.lit(1).alias("side")).unionByName(marks)
    before = Window.partitionBy("name").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("n", (F.col("at") + 1 + F.count_if(F.col("side") == 0).over(before)).cast("int")).where("side = 1")
    return placed.select("id", X.numbered(F.col("name"), F.col("n")).alias("name"))
