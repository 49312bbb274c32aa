"""The review queue: suggested merges, and what a person's answers change.

Answers are functions from tables to new tables; whoever holds a store writes them as one snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .clustering import Config, cluster, person_centroids
from .order import numbered
from .similarity import cosine_pairs

DISTANCE, LIMIT = 0.5, 20


def representatives(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """(person_id, face_id): the cover if there is such a face, else the person's first face."""
    covers = persons.select(F.col("id").alias("person_id"), F.col("cover_face_id").alias("cover")).join(faces.select(F.col("id").alias("cover")), "cover", "left_semi")
    firsts = faces.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.min("id").alias("first"))
    both = persons.select(F.col("id").alias("person_id")).join(covers, "person_id", "left").join(firsts, "person_id", "left")
    return both.select("person_id", F.coalesce("cover", "first").alias("face_id")).where("face_id IS NOT NULL")


def unordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("face_a"), F.greatest(a, b).alias("face_b")]


def suggest_merges(persons: DataFrame, faces: DataFrame, constraints: DataFrame, max_distance: float = DISTANCE, limit: int | None = LIMIT) -> DataFrame:
    """(person_a, person_b, distance) of shown people of one kind with centroids that close, nearest first, ties by ids.

    Pairs whose representative faces are bound to differ are left out. The limit is the queue's length.
    """
    shown = persons.where(~F.col("is_hidden") & (F.size("centroid") > 0)).select("id", F.coalesce("kind", F.lit("human")).alias("kind"), F.col("centroid").alias("vec"))
    pairs = cosine_pairs(shown, max_distance, inclusive=True).select(F.col("a").alias("person_a"), F.col("b").alias("person_b"), "distance")
    reps = representatives(persons, faces)
    named = pairs.join(reps.toDF("person_a", "rep_a"), "person_a", "left").join(reps.toDF("person_b", "rep_b"), "person_b", "left")
    barred = constraints.where("kind = 'cannotLink'").select("face_a", "face_b")
    kept = named.withColumns({"face_a": F.least("rep_a", "rep_b"), "face_b": F.greatest("rep_a", "rep_b"), "both": F.col("rep_a").isNotNull() & F.col("rep_b").isNotNull()})
    open_ = kept.where("both").join(barred, ["face_a", "face_b"], "left_anti").select("person_a", "person_b", "distance").unionByName(kept.where("NOT both").select("person_a", "person_b", "distance"))
    ordered = open_.orderBy("distance", "person_a", "person_b")
    return ordered if limit is None else ordered.limit(limit)


def candidates_for(suggestions: DataFrame, persons: DataFrame, person_id: int, dismissed: DataFrame) -> DataFrame:
    """(other, distance) of suggestions for a person, without dismissed pairs (person_a, person_b), where the other has no more faces."""
    mine = suggestions.where((F.col("person_a") == person_id) | (F.col("person_b") == person_id)).join(dismissed.select(F.least("person_a", "person_b").alias("person_a"), F.greatest("person_a", "person_b").alias("person_b")), ["person_a", "person_b"], "left_anti")
    mine = mine.select(F.when(F.col("person_a") == person_id, F.col("person_b")).otherwise(F.col("person_a")).alias("other"), "distance")
    own = persons.where(F.col("id") == person_id).select(F.col("face_count").alias("own_count"))
    found = mine.join(persons.select(F.col("id").alias("other"), "face_count"), "other").crossJoin(F.broadcast(own))  # own is one row
    return found.where("face_count <= own_count").select("other", "distance").orderBy("distance", "other")


def next_pair(suggestions: DataFrame, skipped: DataFrame) -> DataFrame:
    """The head of the queue without the session's skipped pairs, with its label."""
    s = skipped.select(F.least("person_a", "person_b").alias("person_a"), F.greatest("person_a", "person_b").alias("person_b"))
    return suggestions.join(s, ["person_a", "person_b"], "left_anti").orderBy("distance", "person_a", "person_b").limit(1).withColumn("label", X.review_label(F.col("distance")))


def with_constraints(constraints: DataFrame, new: DataFrame, next_id: int, now: float) -> DataFrame:
    """Constraints with new ones (face_a, face_b, kind), smaller face first; a pair of a kind keeps its first row."""
    rows = new.where("face_a <> face_b").select(*unordered("face_a", "face_b"), "kind").distinct().join(constraints, ["face_a", "face_b", "kind"], "left_anti")
    rows = numbered(rows, [F.col("face_a"), F.col("face_b"), F.col("kind")], next_id, "id").withColumn("created_at", F.lit(float(now)))
    return constraints.unionByName(rows.select(*constraints.columns))


def refreshed(persons: DataFrame, faces: DataFrame, now: float, centroids_of: DataFrame | None = None, prune: bool = True) -> DataFrame:
    """People with their face counts and, for those in ``centroids_of`` (person_id), centroids anew; people without faces go."""
    counts = faces.where(F.col("person_id").isNotNull()).groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("_n"))
    out = persons.join(counts, "id", "left").withColumn("face_count", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")
    if centroids_of is not None:
        touched = centroids_of.select(F.col("person_id").alias("id"), F.lit(True).alias("_touched")).distinct()
        made = person_centroids(faces, centroids_of).select(F.col("person_id").alias("id"), F.col("centroid").alias("_c"))
        out = out.join(touched, "id", "left").join(made, "id", "left")
        out = out.withColumn("centroid", F.when(F.col("_touched"), F.col("_c")).otherwise(F.col("centroid"))).withColumn("updated_at", F.when(F.col("_touched"), F.lit(float(now))).otherwise(F.col("updated_at"))).drop("_touched", "_c")
    out = out.where("face_count > 0") if prune else out
    return out.select(*persons.columns)


def confirm_same(persons: DataFrame, faces: DataFrame, constraints: DataFrame, a: int, b: int, now: float, next_constraint: int) -> dict[str, DataFrame]:
    """The person with more faces (``a`` of equals) takes the other's; their representatives are bound together."""
    rows = {r["id"]: r for r in persons.where(F.col("id").isin(a, b)).select("id", "face_count").collect()}  # two rows
    if a == b or a not in rows or b not in rows:
        return {}
    survivor, absorbed = (a, b) if rows[a]["face_count"] >= rows[b]["face_count"] else (b, a)
    spark = persons.sparkSession
    reps = representatives(persons.where(F.col("id").isin(a, b)), faces).collect()
    out: dict[str, DataFrame] = {}
    if len(reps) == 2:
        link = spark.createDataFrame([(reps[0]["face_id"], reps[1]["face_id"], "mustLink")], "face_a long, face_b long, kind string")
        out["face_constraint"] = with_constraints(constraints, link, next_constraint, now)
    moved = faces.withColumn("person_id", F.when(F.col("person_id") == absorbed, F.lit(survivor).cast("long")).otherwise(F.col("person_id")))
    out["face"] = moved
    out["person"] = refreshed(persons, moved, now, spark.createDataFrame([(survivor,)], "person_id long"))
    return out


def confirm_different(persons: DataFrame, faces: DataFrame, constraints: DataFrame, a: int, b: int, now: float, next_constraint: int) -> dict[str, DataFrame]:
    """The representatives of two people are bound to differ; nothing moves."""
    reps = representatives(persons.where(F.col("id").isin(a, b)), faces).collect()  # two rows
    if len(reps) < 2:
        return {}
    link = persons.sparkSession.createDataFrame([(reps[0]["face_id"], reps[1]["face_id"], "cannotLink")], "face_a long, face_b long, kind string")
    return {"face_constraint": with_constraints(constraints, link, next_constraint, now)}


def merge_people(persons: DataFrame, faces: DataFrame, constraints: DataFrame, source: int, target: int, now: float, next_constraint: int) -> dict[str, DataFrame]:
    """``confirm_same`` of target and source; a survivor without a name takes the target's, else the source's."""
    names = {r["id"]: r["display_name"] for r in persons.where(F.col("id").isin(source, target)).select("id", "display_name").collect()}
    out = confirm_same(persons, faces, constraints, target, source, now, next_constraint)
    name = names.get(target) or names.get(source)
    if out and name:
        out["person"] = out["person"].withColumn("display_name", F.when(F.col("id").isin(source, target) & F.col("display_name").isNull(), F.lit(name)).otherwise(F.col("display_name")))
    return out


def mark_not_person(persons: DataFrame, faces: DataFrame, constraints: DataFrame, photo_ids: list[int], person_id: int, now: float, next_person: int, next_constraint: int, config: Config = Config()) -> tuple[dict[str, DataFrame], int]:
    """Faces of a person in the photos leave it: each is bound to differ from the first face that stays, and they form people among themselves.

    Returns the changed tables and the number of faces that left.
    """
    spark = persons.sparkSession
    own = faces.where(F.col("person_id") == person_id)
    chosen = spark.createDataFrame([(p,) for p in photo_ids], "photo_id long")
    leaving = own.join(chosen, "photo_id", "left_semi")
    n = leaving.count()
    if not n:
        return {}, 0
    out: dict[str, DataFrame] = {}
    anchor = own.join(chosen, "photo_id", "left_anti").agg(F.min("id").alias("id")).first()["id"]
    if anchor is not None:
        links = leaving.select(F.col("id").alias("face_a"), F.lit(anchor).alias("face_b"), F.lit("cannotLink").alias("kind"))
        out["face_constraint"] = with_constraints(constraints, links, next_constraint, now)
    kind = persons.where(F.col("id") == person_id).select("kind").first()
    kind = kind["kind"] if kind else None
    same = leaving.where(F.size("embedding") > 0).select("id", F.lit(kind or "human").alias("kind"), F.lit("").alias("model"), F.size("embedding").alias("dim"), F.col("embedding").alias("vec"))
    groups = cluster(same, None, config)
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    named = numbered(sizes, [F.col("n").desc(), F.col("grp")], next_person, "new_person").select("grp", "new_person")
    placed = leaving.select("id", F.lit(True).alias("left")).join(groups.join(named, "grp").select("id", "new_person"), "id", "left")
    moved = faces.join(placed, "id", "left").withColumn("person_id", F.when(F.col("left"), F.col("new_person")).otherwise(F.col("person_id"))).select(*faces.columns)
    made = named.select(F.col("new_person").alias("id"), F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("long").alias("cover_face_id"), F.lit(False).alias("is_hidden"), F.lit(None).cast("array<double>").alias("centroid"), F.lit(0).cast("long").alias("face_count"), F.lit(kind).cast("string").alias("kind"), F.lit(None).cast("string").alias("model"), F.lit(float(now)).alias("created_at"), F.lit(float(now)).alias("updated_at"))
    gone = leaving.select(F.col("id").alias("cover_face_id"), F.lit(True).alias("_gone"))
    base = persons.join(gone, "cover_face_id", "left").withColumn("cover_face_id", F.when((F.col("id") == person_id) & F.col("_gone"), F.lit(None)).otherwise(F.col("cover_face_id"))).select(*persons.columns)
    touched = named.select(F.col("new_person").alias("person_id")).unionByName(spark.createDataFrame([(person_id,)], "person_id long"))
    out["face"] = moved
    out["person"] = refreshed(base.unionByName(made.select(*persons.columns)), moved, now, touched)
    return out, n


def set_cover(persons: DataFrame, faces: DataFrame, person_id: int, photo_id: int, now: float) -> DataFrame:
    """The person's first face in a photo becomes the cover; without one nothing changes."""
    face = faces.where((F.col("person_id") == person_id) & (F.col("photo_id") == photo_id)).agg(F.min("id").alias("id")).first()["id"]
    if face is None:
        return persons
    own = F.col("id") == person_id
    return persons.withColumn("cover_face_id", F.when(own, F.lit(face)).otherwise(F.col("cover_face_id"))).withColumn("updated_at", F.when(own, F.lit(float(now))).otherwise(F.col("updated_at")))

