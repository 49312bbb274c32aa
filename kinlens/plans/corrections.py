"""More registered queries: vector expressions, file rules, and what corrections and removals leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import text as X
from ..functions import vectors as V
from ..operators import browse as B
from ..operators import clustering as C
from ..operators import review as R
from ..sources import inventory as N
from ..sources.store import with_root, with_values, without_photos
from .catalog import CENTROID, SETS, _sets, face_vectors, faces, library, no_constraints, photos, query
from .domain import people, view

# --- vectors

def _other():
    """Vectors of another length at every seventh face, of zeros at every eleventh."""
    return F.when(F.col("id") % 7 == 0, F.slice("vec", 1, 5)).when(F.col("id") % 11 == 0, F.transform("vec", lambda _: F.lit(0.0))).otherwise(F.reverse("vec"))


@query("vector_dots", "SELECT id, CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN 0 ELSE round(list_dot_product(vec, list_reverse(vec)), 6) END AS dot FROM v_face_vec", "v_face_vec")
def _(spark, sf):
    return face_vectors(spark, sf).select("id", F.round(V.dot(F.col("vec"), _other()), 6).alias("dot"))


@query("vector_similarities", "SELECT id, s AS similarity, round(1 - s, 6) AS distance FROM (SELECT id, CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN 0 ELSE round(list_cosine_similarity(vec, list_reverse(vec)), 6) END AS s FROM v_face_vec)", "v_face_vec")
def _(spark, sf):
    return face_vectors(spark, sf).select("id", F.round(V.cosine_similarity(F.col("vec"), _other()), 6).alias("similarity"), F.round(V.cosine_distance(F.col("vec"), _other()), 6).alias("distance"))


@query("vector_blobs", "SELECT id, 4 * len(vec) AS n_bytes, round(CAST(CAST(vec[1] AS FLOAT) AS DOUBLE), 6) AS first, CASE WHEN id % 3 = 0 THEN 0 ELSE len(vec) END AS n_back FROM v_face_vec", "v_face_vec")
def _(spark, sf):
    coded = face_vectors(spark, sf).select("id", V.to_blob(F.col("vec").cast("array<float>")).alias("blob"))
    cut = coded.withColumn("cut", F.when(F.col("id") % 3 == 0, F.expr("substring(blob, 1, octet_length(blob) - 1)")).otherwise(F.col("blob")))
    back = cut.select("id", F.octet_length("blob").cast("long").alias("n_bytes"), V.from_blob("blob").alias("whole"), V.from_blob("cut").alias("part"))
    return back.select("id", "n_bytes", F.round(F.element_at("whole", 1).cast("double"), 6).alias("first"), F.size("part").cast("long").alias("n_back"))


def _gappy(spark, sf):
    return face_vectors(spark, sf).select("id", "ident", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 7 == 0, F.array().cast("array<double>")).otherwise(F.col("vec")).alias("embedding"))


@query("faces_with_embeddings", "SELECT id FROM v_face_vec WHERE id % 5 <> 0", "v_face_vec")
def _(spark, sf):
    return B.with_embeddings(_gappy(spark, sf)).select("id")


@query("usable_vectors", "SELECT id FROM v_face_vec WHERE id % 5 <> 0 AND id % 7 <> 0", "v_face_vec")
def _(spark, sf):
    return B.usable_vectors(_gappy(spark, sf)).select("id")


@query("joint_gate", "SELECT photo_id, line FROM v_face WHERE bbox_x * 10 >= 0.2 AND bbox_y * 10 >= 0.2 AND quality >= 0.2", "v_face")
def _(spark, sf):
    return faces(spark, sf).where(I.passes_joints(F.col("bbox_x") * 10, F.col("bbox_y") * 10, F.col("quality"))).select("photo_id", "line")


@query(
    "difference_hashes",
    """SELECT id, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN (id * 31 + ((i // 8) * 9 + i % 8) * ((i // 8) * 9 + i % 8) * 7) % 251 > (id * 31 + ((i // 8) * 9 + i % 8 + 1) * ((i // 8) * 9 + i % 8 + 1) * 7) % 251
       THEN CASE WHEN i = 63 THEN (-9223372036854775807 - 1)::BIGINT ELSE 1::BIGINT << i END ELSE 0::BIGINT END), lambda a, b: a | b) AS phash FROM v_photo_plain""",
    "v_photo_plain",
)
def _(spark, sf):
    gray = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (F.col("id") * 31 + i * i * 7) % 251)
    pixels = F.unhex(F.array_join(F.transform(gray, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return photos(spark, sf).select("id", I.dhash(pixels).alias("phash"))


# --- files

_PLACES = "CASE id % 6 WHEN 0 THEN '.hidden/' WHEN 1 THEN 'Some.app/in/' WHEN 2 THEN 'app/' WHEN 3 THEN 'a.photosLibrary/' ELSE 'b c/' END"


@query("visible_files", f"SELECT id, {_PLACES} || relative_path AS path FROM v_photo_plain WHERE id % 6 IN (2, 4, 5)", "v_photo_plain")
def _(spark, sf):
    rows = photos(spark, sf).select("id", F.expr(f"{_PLACES} || relative_path").alias("path"))
    return rows.where(N.visible(F.col("path")))


@query("relative_paths", "SELECT p.id, substr(display_path, 6) || '/' || relative_path AS path FROM v_photo_plain p JOIN v_root r ON r.id = root_id", "v_photo_plain", "v_root")
def _(spark, sf):
    full = B.full_paths(photos(spark, sf), view(spark, sf, "v_root"))
    remote = F.concat(F.when(F.col("id") % 2 == 0, "hdfs://nn:8020").otherwise("file:"), "path")
    return full.select("id", X.relative_path(N.plain_path(remote), "/lib").alias("path"))


@query("root_upserts", "SELECT id::BIGINT AS id, display_path, CASE WHEN display_path = '/lib/ASIA' THEN 'V2' ELSE 'V1' END AS volume, 'b' || id AS bookmark FROM v_root UNION ALL SELECT 100, '/new', 'V3', 'mark'", "v_root")
def _(spark, sf):
    roots = view(spark, sf, "v_root").select("id", "display_path", F.lit("V1").alias("volume_uuid"), F.concat(F.lit("b"), F.col("id").cast("string")).cast("binary").alias("bookmark"), "added_at", F.lit(None).cast("double").alias("last_scanned_at"), F.lit(0).alias("scan_generation"))
    renewed = with_root(with_root(roots, "/lib/ASIA", "V2", None, 5.0, 100), "/new", "V3", b"mark", 5.0, 100)
    return renewed.select("id", "display_path", F.col("volume_uuid").alias("volume"), F.col("bookmark").cast("string").alias("bookmark"))


@query("states_overwritten", "SELECT id, CASE WHEN id % 3 = 0 THEN 'failed' ELSE state END AS state, CASE WHEN id % 3 <> 0 THEN indexed_at END AS indexed_at FROM v_photo_plain", "v_photo_plain")
def _(spark, sf):
    p = photos(spark, sf)
    new = p.where("id % 3 = 0").select("id", F.lit("failed").alias("state"), F.lit(None).cast("double").alias("indexed_at"))
    return with_values(p, new).select("id", "state", "indexed_at")


@query("values_overwritten", "SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'other' ELSE category END AS category, CASE WHEN id % 4 < 2 THEN id % 4 = 1 ELSE favorite END AS favorite FROM v_photo_plain", "v_photo_plain")
def _(spark, sf):
    p = photos(spark, sf)
    new = p.where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 1, "other").alias("category"), (F.col("id") % 4 == 1).alias("favorite"))
    return with_values(p, new).select("id", "category", "favorite")


def _without_root(spark, sf):
    """The tables without root 2; a face's number is its photo's and its line, and faces of a photo's first two lines are bound."""
    p = photos(spark, sf)
    f = faces(spark, sf).withColumn("id", F.col("photo_id") * 10 + F.col("line"))
    bound = f.where("line = 2").select(F.col("id"), (F.col("id") - 1).alias("face_a"), F.col("id").alias("face_b"))
    return without_photos(p, f, bound, p.where("root_id = 2").select("id"))


@query(
    "tables_without_root",
    """SELECT 'photo' AS t, count(*) AS n FROM v_photo_plain WHERE root_id <> 2
       UNION ALL SELECT 'face', count(*) FROM v_face JOIN v_photo_plain p ON p.id = photo_id WHERE root_id <> 2
       UNION ALL SELECT 'face_constraint', count(*) FROM v_face JOIN v_photo_plain p ON p.id = photo_id WHERE root_id <> 2 AND line = 2""",
    "v_photo_plain", "v_face",
)
def _(spark, sf):
    out = None
    for name, df in _without_root(spark, sf).items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("people_without_root", "SELECT person_id AS id, count(*) AS face_count FROM v_face JOIN v_photo_plain p ON p.id = photo_id WHERE root_id <> 2 AND person_id IS NOT NULL GROUP BY person_id", "v_photo_plain", "v_face")
def _(spark, sf):
    return R.refreshed(people(spark, sf), _without_root(spark, sf)["face"], 0.0).select("id", "face_count")


# --- corrections


@query("pins_exclusive", SETS + "SELECT set_id AS id FROM sets WHERE rank_in_set = 1 AND set_id NOT IN (SELECT set_id FROM sets WHERE id = (SELECT max(id) FROM sets)) UNION ALL SELECT max(id) FROM sets HAVING count(*) > 0", "v_photo", "v_root")
def _(spark, sf):
    members = _sets(spark, sf)
    pins = members.where("rank_in_set = 1").select("id")
    chosen = members.agg(F.max("id")).first()[0]
    return pins if chosen is None else B.pin(pins, members, chosen)


_SUGGESTED = CENTROID + ", s AS (SELECT a.person_id AS person_a, b.person_id AS person_b, list_cosine_distance(a.c, b.c) AS distance FROM unit a JOIN kinds ka ON ka.person_id = a.person_id JOIN unit b ON a.person_id < b.person_id JOIN kinds kb ON kb.person_id = b.person_id WHERE ka.kind = kb.kind AND list_cosine_distance(a.c, b.c) <= 0.8) "


@query("suggestions_unbound", _SUGGESTED + "SELECT person_a, person_b, round(distance, 6) AS distance FROM s WHERE (person_a + person_b) % 3 <> 0", "v_face_vec")
def _(spark, sf):
    """Pairs of people whose numbers sum to a multiple of three are bound to differ, by their representative faces."""
    rows, persons = library(spark, sf)
    reps = R.representatives(persons, rows)
    a, b = reps.toDF("person_a", "face_a"), reps.toDF("person_b", "face_b")
    third = a.withColumn("rest", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("(person_a + rest) % 3 = 0")  # an equal join, not a cross
    pairs = third.join(b.withColumn("rest", F.col("person_b") % 3), "rest").where("person_a < person_b")
    bound = R.with_constraints(no_constraints(spark), pairs.select("face_a", "face_b", F.lit("cannotLink").alias("kind")), 1, 0.0)
    return R.suggest_merges(persons, rows, bound, 0.8, None).select("person_a", "person_b", F.round("distance", 6).alias("distance"))


@query("suggestion_after_skips", _SUGGESTED + "SELECT person_a, person_b, round(distance, 6) AS distance FROM s ORDER BY s.distance, person_a, person_b LIMIT 1 OFFSET 2", "v_face_vec")
def _(spark, sf):
    rows, persons = library(spark, sf)
    found = R.suggest_merges(persons, rows, no_constraints(spark), 0.8, None)
    skipped = found.limit(2).select(F.col("person_b").alias("person_a"), F.col("person_a").alias("person_b"))
    return R.next_pair(found, skipped).select("person_a", "person_b", F.round("distance", 6).alias("distance"))


@query("representative_faces", "SELECT person_id, CASE WHEN person_id % 3 <> 0 AND person_id % 2 = 0 THEN max(id) ELSE min(id) END AS face_id FROM v_face_vec WHERE person_id IS NOT NULL GROUP BY person_id", "v_face_vec")
def _(spark, sf):
    """Covers of even people are their last faces; those of every third are faces that are gone."""
    rows, persons = library(spark, sf)
    last = rows.groupBy(F.col("person_id").alias("id")).agg(F.max("id").alias("last")).where("id IS NOT NULL")
    covered = persons.join(last, "id").withColumn("cover_face_id", F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 2 == 0, F.col("last")))
    return R.representatives(covered, rows)


@query("confirm_different", "SELECT least(a, b) AS face_a, greatest(a, b) AS face_b, 'cannotLink' AS kind FROM (SELECT min(id) FILTER (WHERE person_id = 3) AS a, min(id) FILTER (WHERE person_id = 5) AS b FROM v_face_vec)", "v_face_vec")
def _(spark, sf):
    rows, persons = library(spark, sf)
    return R.confirm_different(persons, rows, no_constraints(spark), 5, 3, 1.0, 1)["face_constraint"].select("face_a", "face_b", "kind")


@query(
    "merge_people",
    """SELECT CASE WHEN person_id IN (1, 2) THEN (SELECT CASE WHEN count(*) FILTER (WHERE person_id = 2) >= count(*) FILTER (WHERE person_id = 1) THEN 2 ELSE 1 END FROM v_face_vec) ELSE person_id END AS id,
       CASE WHEN bool_or(person_id IN (1, 2)) THEN 'Old' END AS display_name, count(*) AS face_count FROM v_face_vec WHERE person_id IS NOT NULL GROUP BY 1""",
    "v_face_vec",
)
def _(spark, sf):
    """Person 1, who has a name, is merged into person 2, who has none."""
    rows, persons = library(spark, sf)
    named = persons.withColumn("display_name", F.when(F.col("id") == 1, "Old"))
    return R.merge_people(named, rows, no_constraints(spark), 1, 2, 1.0, 1)["person"].select("id", "display_name", "face_count")


@query("cover_set", "SELECT DISTINCT person_id AS id, CASE WHEN person_id = 3 THEN 53::BIGINT END AS cover FROM v_face_vec WHERE person_id IS NOT NULL", "v_face_vec")
def _(spark, sf):
    rows, persons = library(spark, sf)
    covered = R.set_cover(R.set_cover(persons, rows, 3, 53, 1.0), rows, 4, 53, 1.0)  # the photo doesn't show person 4
    return covered.select("id", F.col("cover_face_id").alias("cover"))


@query("learned_corrections", "SELECT count(*) AS n FROM (SELECT DISTINCT least(id % 7, id % 5), greatest(id % 7, id % 5), id % 2 FROM v_face_vec WHERE id % 7 <> id % 5)", "v_face_vec")
def _(spark, sf):
    new = face_vectors(spark, sf).select((F.col("id") % 7).alias("face_a"), (F.col("id") % 5).alias("face_b"), F.when(F.col("id") % 2 == 0, "mustLink").otherwise("cannotLink").alias("kind"))
    first = R.with_constraints(no_constraints(spark), new.where("face_a < 3"), 1, 0.0)
    return R.with_constraints(first, new, 1000, 1.0).agg(F.count("*").alias("n"))  # a pair that is known keeps its row


# --- grouping


def _halves(spark, sf):
    """(usable faces with the half of their identity that they are in, the half's first face, and the first face of the other half)."""
    rows, _ = library(spark, sf)
    half = F.expr("(id - 1) div 50 % 2")
    halves = face_vectors(spark, sf).select("id", "ident", half.alias("half"))
    firsts = halves.groupBy("ident").agg(F.min(F.when(F.col("half") == 0, F.col("id"))).alias("first"), F.min(F.when(F.col("half") == 1, F.col("id"))).alias("second"))
    return C.usable(rows), halves.join(firsts, "ident")


def _split(spark, sf):
    own, halves = _halves(spark, sf)
    grp = F.when(F.col("half") == 0, F.col("first")).otherwise(F.col("second"))
    return own, halves, own.join(halves.select("id", grp.alias("grp")), "id").select("id", "kind", "model", "dim", "grp")


def _link(spark, pairs, kind):
    return pairs.select(F.lit(0).cast("long").alias("id"), "face_a", "face_b", F.lit(kind).alias("kind"), F.lit(0.0).alias("created_at"))


@query("centroid_merges", "SELECT id, min(id) OVER (PARTITION BY ident) AS grp FROM v_face_vec", "v_face_vec")
def _(spark, sf):
    """Every identity's faces come as two groups; their centroids are close."""
    own, _, groups = _split(spark, sf)
    return C.centroid_merged(own, groups, None, C.Config()).select("id", "grp")


@query("centroid_merges_bound", "SELECT id, CASE WHEN ident % 2 = 0 THEN min(id) OVER (PARTITION BY ident, (id - 1) // 50 % 2) ELSE min(id) OVER (PARTITION BY ident) END AS grp FROM v_face_vec", "v_face_vec")
def _(spark, sf):
    """The same, where the two groups of every other identity are bound to differ."""
    own, halves, groups = _split(spark, sf)
    pairs = halves.where("ident % 2 = 0 AND id = first AND second IS NOT NULL").select(F.col("first").alias("face_a"), F.col("second").alias("face_b"))
    return C.centroid_merged(own, groups, _link(spark, pairs, "cannotLink"), C.Config()).select("id", "grp")


@query("groups_bound_to_differ", "SELECT id, min(id) OVER (PARTITION BY ident, (id - 1) // 50 % 2) AS grp FROM v_face_vec", "v_face_vec")
def _(spark, sf):
    """One half of each identity is bound together, and each face of the other bound to differ from it: average linkage makes two groups."""
    own, halves = _halves(spark, sf)
    together = halves.where("half = 0 AND id <> first").select(F.col("first").alias("face_a"), F.col("id").alias("face_b"))
    apart = halves.where("half = 1").select(F.col("first").alias("face_a"), F.col("id").alias("face_b"))
    links = _link(spark, together, "mustLink").unionByName(_link(spark, apart, "cannotLink"))
    return C.cluster(own, links, C.Config()).select("id", "grp")
