"""Registered queries over the domain views, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import text as X
from ..functions import vectors as V
from ..operators import browse as B
from ..operators import clustering as C
from ..operators import review as R
from ..operators import similarity as S
from ..operators.order import numbered
from ..sources import inventory as N
from ..streaming.watch import quiet_sessions
from .domain import inventory, oracle, people, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = oracle(sql, *views)
        return fn

    return keep


def photos(spark, sf):
    return view(spark, sf, "v_photo_plain")


def faces(spark, sf):
    return view(spark, sf, "v_face")


NEWEST = "coalesce(taken_at, mtime) DESC, id"


# --- people and photos

for _name, _ids, _only in (("photos_for_all_people", (1, 2), False), ("photos_only_these_people", (1, 2), True), ("photos_for_person", (1,), False)):
    _in = ", ".join(map(str, _ids))
    _sql = f"SELECT p.id, p.relative_path FROM v_photo_plain p WHERE (SELECT count(DISTINCT person_id) FROM v_face f WHERE f.photo_id = p.id AND person_id IN ({_in})) = {len(_ids)}"
    _sql += f" AND NOT EXISTS (SELECT 1 FROM v_face f WHERE f.photo_id = p.id AND person_id IS NOT NULL AND person_id NOT IN ({_in}))" * _only

    def _run(spark, sf, ids=_ids, only=_only):
        found = B.photos_for_people(photos(spark, sf), faces(spark, sf), ids, only) if len(ids) > 1 else B.photos_for_person(photos(spark, sf), faces(spark, sf), ids[0])
        return found.select("id", "relative_path")

    query(_name, _sql, "v_photo_plain", "v_face")(_run)


@query("counts_by_root", "SELECT root_id, count(*) AS n FROM v_photo_plain GROUP BY root_id", "v_photo_plain")
def _(spark, sf):
    return B.counts_by_root(photos(spark, sf))


@query("photo_counts_per_person", "SELECT person_id, count(DISTINCT photo_id) AS n FROM v_face WHERE person_id IS NOT NULL GROUP BY person_id", "v_face")
def _(spark, sf):
    return B.photo_counts(faces(spark, sf))


@query("face_counts_per_person", "SELECT id, (SELECT count(*) FROM v_face f WHERE f.person_id = p.id) AS face_count FROM v_person p", "v_face", "v_person")
def _(spark, sf):
    return B.face_counts(view(spark, sf, "v_person"), faces(spark, sf))


@query(
    "category_counts",
    """SELECT count(*) FILTER (WHERE category = 'screenshot') AS screenshots, count(*) FILTER (WHERE category = 'document') AS documents, count(*) FILTER (WHERE category = 'identity') AS identity,
       count(*) FILTER (WHERE gps_lat IS NOT NULL) AS places, count(*) FILTER (WHERE id NOT IN (SELECT photo_id FROM v_face) AND coalesce(category, '') <> 'video') AS no_faces,
       count(*) FILTER (WHERE pet_kind IS NOT NULL) AS pets, count(*) FILTER (WHERE category = 'video') AS videos, (SELECT count(*) FROM v_person WHERE NOT is_hidden) AS people FROM v_photo_plain""",
    "v_photo_plain", "v_face", "v_person",
)
def _(spark, sf):
    return B.category_counts(photos(spark, sf), faces(spark, sf), view(spark, sf, "v_person"))


CONDITIONS = {c: f"category = '{c}'" for c in ("screenshot", "document", "identity", "video")} | {"places": "gps_lat IS NOT NULL", "pets": "pet_kind IS NOT NULL", "no_faces": "id NOT IN (SELECT photo_id FROM v_face) AND coalesce(category, '') <> 'video'"}
for _c, _where in CONDITIONS.items():
    query(f"in_category_{_c}", f"SELECT id, category, pet_kind, gps_lat FROM v_photo_plain WHERE {_where}", "v_photo_plain", "v_face")(lambda spark, sf, c=_c: B.in_category(photos(spark, sf), faces(spark, sf), c).select("id", "category", "pet_kind", "gps_lat"))
    query(f"first_in_category_{_c}", f"SELECT id, relative_path FROM v_photo_plain WHERE {_where} ORDER BY {NEWEST} LIMIT 1", "v_photo_plain", "v_face")(lambda spark, sf, c=_c: B.first_in_category(photos(spark, sf), faces(spark, sf), c).select("id", "relative_path"))


def _listing(order: str, where: str = "TRUE", limit: int | None = None) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS position, id FROM v_photo_plain WHERE {where} ORDER BY position" + (f" LIMIT {limit}" if limit else "")


@query("recently_added_300", _listing("coalesce(indexed_at, 0) DESC, id", limit=300), "v_photo_plain")
def _(spark, sf):
    return B.with_rank(B.recently_added(photos(spark, sf)), B.latest_indexed()).select("position", "id")


@query("all_by_taken_at", _listing(NEWEST), "v_photo_plain")
def _(spark, sf):
    return numbered(photos(spark, sf).select("id", "taken_at", "mtime"), B.newest(), 1, "position").select("position", "id")


@query("all_by_indexed_at", _listing("coalesce(indexed_at, 0) DESC, id"), "v_photo_plain")
def _(spark, sf):
    return numbered(photos(spark, sf).select("id", "indexed_at"), B.latest_indexed(), 1, "position").select("position", "id")


@query("favorites", _listing(NEWEST, "favorite"), "v_photo_plain")
def _(spark, sf):
    return numbered(photos(spark, sf).where("favorite").select("id", "taken_at", "mtime"), B.newest(), 1, "position").select("position", "id")


@query("viewer_range", f"SELECT position, id FROM ({_listing(NEWEST)}) WHERE position BETWEEN 40 AND 60", "v_photo_plain")
def _(spark, sf):
    return B.between(QUERIES["all_by_taken_at"](spark, sf), 60, 40)


@query("viewer_step", f"SELECT position, id FROM ({_listing(NEWEST)}) WHERE position = 41", "v_photo_plain")
def _(spark, sf):
    return B.step(QUERIES["all_by_taken_at"](spark, sf), 40, 1)


for _name, _fn, _where in (
    ("needing_processing", B.needing_processing, "state IN ('discovered', 'failed')"),
    ("uncategorized", B.uncategorized, "category IS NULL AND state <> 'missing'"),
):
    query(_name, f"SELECT id, state, category FROM v_photo_plain WHERE {_where}", "v_photo_plain")(lambda spark, sf, fn=_fn: fn(photos(spark, sf)).select("id", "state", "category"))


@query("with_phash", "SELECT id, phash FROM v_photo WHERE phash IS NOT NULL AND state <> 'missing'", "v_photo")
def _(spark, sf):
    return B.with_phash(view(spark, sf, "v_photo")).select("id", "phash")


@query("people_search", "SELECT id, display_name FROM v_person WHERE contains(lower(coalesce(display_name, 'Unnamed')), 'n 1')", "v_person")
def _(spark, sf):
    return B.search_people(view(spark, sf, "v_person"), " N 1 ").select("id", "display_name")


@query("people_by_face_count", "SELECT row_number() OVER (ORDER BY face_count DESC, id) AS position, id, face_count FROM (SELECT p.id, count(f.photo_id) AS face_count FROM v_person p LEFT JOIN v_face f ON f.person_id = p.id WHERE NOT is_hidden GROUP BY p.id)", "v_person", "v_face")
def _(spark, sf):
    return numbered(B.people(people(spark, sf)).select("id", "face_count"), [F.col("face_count").desc(), F.col("id")], 1, "position")


@query("top_people_preview", "SELECT id, face_count FROM (SELECT p.id, count(f.photo_id) AS face_count FROM v_person p LEFT JOIN v_face f ON f.person_id = p.id WHERE NOT is_hidden GROUP BY p.id) ORDER BY face_count DESC, id LIMIT 4", "v_person", "v_face")
def _(spark, sf):
    return B.people(people(spark, sf)).limit(4).select("id", "face_count")


@query("online_photos", "SELECT id FROM v_photo_plain WHERE root_id <> 2", "v_photo_plain")
def _(spark, sf):
    return B.online(photos(spark, sf), view(spark, sf, "v_root").where("id = 2")).select("id")


@query("roots_by_added", "SELECT id, display_path, added_at FROM v_root", "v_root")
def _(spark, sf):
    return view(spark, sf, "v_root").orderBy("added_at")


@query("first_roots", "SELECT id, display_path FROM v_root ORDER BY added_at, id LIMIT 4", "v_root")
def _(spark, sf):
    return view(spark, sf, "v_root").orderBy("added_at", "id").limit(4).select("id", "display_path")


@query("photo_by_id", "SELECT id, relative_path FROM v_photo_plain WHERE id = 41", "v_photo_plain")
def _(spark, sf):
    return photos(spark, sf).where("id = 41").select("id", "relative_path")


@query("people_refreshed", "SELECT id, face_count FROM (SELECT p.id, count(f.photo_id) AS face_count FROM v_person p LEFT JOIN v_face f ON f.person_id = p.id GROUP BY p.id) WHERE face_count > 0", "v_person", "v_face")
def _(spark, sf):
    """People whose counts were renewed, without those that lost all their faces."""
    base = view(spark, sf, "v_person").select("id", F.lit(0).cast("long").alias("face_count"))
    return R.refreshed(base, faces(spark, sf), 0.0)


@query("photo_by_path", "SELECT id FROM v_photo_plain WHERE root_id = 1 AND relative_path = (SELECT min(relative_path) FROM v_photo_plain WHERE root_id = 1)", "v_photo_plain")
def _(spark, sf):
    least = photos(spark, sf).where("root_id = 1").agg(F.min("relative_path").alias("relative_path"))
    return photos(spark, sf).where("root_id = 1").join(F.broadcast(least), "relative_path", "left_semi").select("id")


@query("photo_full_paths", "SELECT p.id, r.display_path || '/' || p.relative_path AS path FROM v_photo_plain p JOIN v_root r ON r.id = p.root_id", "v_photo_plain", "v_root")
def _(spark, sf):
    return B.full_paths(photos(spark, sf), view(spark, sf, "v_root"))


@query("affected_roots", "SELECT id FROM v_root WHERE display_path LIKE '/lib/A%'", "v_root")
def _(spark, sf):
    roots = view(spark, sf, "v_root")
    changes = roots.where(F.col("display_path").startswith("/lib/A")).select(F.concat("display_path", F.lit("/x.jpg")).alias("path"))
    return B.affected_roots(roots, changes).select("id")


@query("faces_in_photo", "SELECT photo_id, line, person_id FROM v_face WHERE photo_id = 7 AND person_id IS NOT NULL", "v_face")
def _(spark, sf):
    return B.faces_in_photo(faces(spark, sf), 7).where("person_id IS NOT NULL").select("photo_id", "line", "person_id")


@query("face_boxes_by_photo", "SELECT photo_id, string_agg(printf('%.3f/%.3f', bbox_x, bbox_y), ',' ORDER BY bbox_x, bbox_y) AS boxes FROM v_face WHERE person_id = 3 GROUP BY photo_id", "v_face")
def _(spark, sf):
    found = B.face_boxes(faces(spark, sf), 3)
    return found.select("photo_id", F.array_join(F.transform("boxes", lambda b: F.format_string("%.3f/%.3f", b["bbox_x"], b["bbox_y"])), ",").alias("boxes"))


@query("face_lines", "SELECT photo_id, line, printf('person %s · bbox [x=%.3f y=%.3f w=%.3f h=%.3f]', coalesce(person_id::VARCHAR, '—'), bbox_x, bbox_y, bbox_w, bbox_h) AS shown FROM v_face", "v_face")
@query("face_lines_all", "SELECT photo_id, line, printf('person %s · bbox [x=%.3f y=%.3f w=%.3f h=%.3f]', coalesce(person_id::VARCHAR, '—'), bbox_x, bbox_y, bbox_w, bbox_h) AS shown FROM v_face", "v_face")
def _(spark, sf):
    return faces(spark, sf).select("photo_id", "line", X.face_line(F.col("bbox_x"), F.col("bbox_y"), F.col("bbox_w"), F.col("bbox_h"), F.col("person_id")).alias("shown"))


@query("quality_gate", "SELECT photo_id, line, quality FROM v_face WHERE quality IS NULL OR quality >= 0.3", "v_face")
def _(spark, sf):
    return faces(spark, sf).where(I.passes_quality(F.col("quality"))).select("photo_id", "line", "quality")


@query("source_count", "SELECT count(DISTINCT root_id) AS n FROM v_photo_plain WHERE id IN (SELECT photo_id FROM v_face WHERE person_id = 1)", "v_photo_plain", "v_face")
def _(spark, sf):
    return B.source_count(B.photos_for_person(photos(spark, sf), faces(spark, sf), 1))


@query("place_groups", "SELECT cast(round(gps_lat / 0.05) as bigint)::VARCHAR || ',' || cast(round(gps_lon / 0.05) as bigint)::VARCHAR AS key, round(avg(gps_lat), 6) AS lat, round(avg(gps_lon), 6) AS lon, count(*) AS n FROM v_photo_plain WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL GROUP BY 1", "v_photo_plain")
def _(spark, sf):
    return B.place_groups(photos(spark, sf)).select("key", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n")


@query("majority_person", "SELECT root_id, person_id, votes FROM (SELECT root_id, person_id, count(*) AS votes, row_number() OVER (PARTITION BY root_id ORDER BY count(*) DESC, person_id) AS k FROM v_photo_plain p JOIN v_face f ON f.photo_id = p.id WHERE person_id IS NOT NULL GROUP BY root_id, person_id) WHERE k = 1", "v_photo_plain", "v_face")
def _(spark, sf):
    votes = photos(spark, sf).select(F.col("id").alias("photo_id"), "root_id").join(faces(spark, sf).select("photo_id", "person_id"), "photo_id")
    return B.majority(votes, "root_id", "person_id")


# --- rules, geometry and text

MARKERS = " OR ".join(f"contains(lower(relative_path), '{m}')" for m in I.SCREENSHOT_MARKERS)


@query(
    "screenshot_rule",
    f"SELECT id, CASE WHEN {MARKERS} THEN TRUE WHEN taken_at IS NOT NULL THEN FALSE WHEN relative_path LIKE '%.png' THEN TRUE ELSE coalesce(width > 0 AND height > 0 AND greatest(width, height) / least(width, height)::DOUBLE BETWEEN 1.7 AND 2.3, FALSE) END AS is_screenshot FROM v_photo_plain",
    "v_photo_plain",
)
def _(spark, sf):
    rule = I.is_screenshot(X.last_component(F.col("relative_path")), F.col("taken_at").isNotNull(), F.col("relative_path").endswith(".png"), F.col("width"), F.col("height"))
    return photos(spark, sf).select("id", rule.alias("is_screenshot"))


@query("category_priority", "SELECT id, CASE WHEN id % 7 = 0 THEN 'identity' WHEN id % 5 = 0 THEN 'screenshot' WHEN id % 3 = 0 THEN 'document' ELSE 'other' END AS category FROM v_photo_plain", "v_photo_plain")
def _(spark, sf):
    return photos(spark, sf).select("id", I.category(F.col("id") % 7 == 0, F.col("id") % 5 == 0, F.col("id") % 3 == 0).alias("category"))


PHRASES = " OR ".join(f"contains(lower(t), '{p}')" for p in I.IDENTITY_PHRASES)


@query("identity_keywords", f"SELECT id, ({PHRASES}) AS hit FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'Republic of INDIA ' || id WHEN 1 THEN 'Voter card' WHEN 2 THEN 'menu' WHEN 3 THEN 'TYPE P<' ELSE '' END AS t FROM v_photo_plain)", "v_photo_plain")
def _(spark, sf):
    t = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Republic of INDIA "), F.col("id").cast("string"))).when(F.col("id") % 5 == 1, "Voter card").when(F.col("id") % 5 == 2, "menu").when(F.col("id") % 5 == 3, "TYPE P<").otherwise("")
    return photos(spark, sf).select("id", I.has_identity_phrase(t).alias("hit"))


@query("document_like", "SELECT id, (id % 4) / 4.0 >= 0.75 OR (id % 2 = 0 AND (id % 10) / 10.0 >= 0.6) AS hit FROM v_photo_plain", "v_photo_plain")
def _(spark, sf):
    labels = F.array(F.struct(F.when(F.col("id") % 2 == 0, "receipt").otherwise("menu").alias("label"), ((F.col("id") % 10) / 10.0).alias("confidence")))
    return photos(spark, sf).select("id", I.is_document((F.col("id") % 4) / 4.0, labels).alias("hit"))


@query("pet_label", "SELECT id, CASE WHEN greatest((id % 10) / 10.0, (id % 7) / 7.0) >= 0.6 THEN CASE WHEN (id % 10) / 10.0 >= (id % 7) / 7.0 THEN 'cat' ELSE 'dog' END END AS pet FROM v_photo_plain", "v_photo_plain")
def _(spark, sf):
    label = lambda name, c: F.struct(F.lit(name).alias("label"), c.alias("confidence"))
    return photos(spark, sf).select("id", I.pet_kind(F.array(label("Cat_tabby", (F.col("id") % 10) / 10.0), label("Dog", (F.col("id") % 7) / 7.0))).alias("pet"))


@query("exif_taken_at", "SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE taken_at END AS parsed FROM v_photo_plain WHERE taken_at IS NOT NULL", "v_photo_plain")
def _(spark, sf):
    shown = F.when(F.col("id") % 3 == 0, "not a date").otherwise(F.date_format(F.timestamp_seconds("taken_at"), "yyyy:MM:dd HH:mm:ss"))
    return photos(spark, sf).where("taken_at IS NOT NULL").select("id", X.taken_at(shown).alias("parsed"))


@query("gps_sign", "SELECT id, round(gps_lat, 6) AS lat, round(gps_lon, 6) AS lon FROM v_photo_plain WHERE gps_lat IS NOT NULL", "v_photo_plain")
def _(spark, sf):
    side = lambda c, n, p: X.signed(F.abs(c), F.when(F.col(c) < 0, n).otherwise(p), n)
    return photos(spark, sf).where("gps_lat IS NOT NULL").select("id", F.round(side("gps_lat", "S", "N"), 6).alias("lat"), F.round(side("gps_lon", "W", "E"), 6).alias("lon"))


def _rounded(box, *names):
    return [(F.round(box[n], 6) + 0.0).alias(n) for n in names]  # no negative zeros


@query(
    "head_box",
    """SELECT photo_id, line, round(x, 6) AS x, round(y, 6) AS y, round(least(1 - x, w + 2 * w * 0.9), 6) AS w, round(least(1 - y, h + 2 * h * 1.1), 6) AS h FROM (
       SELECT photo_id, line, w, h, greatest(0, lx - w * 0.9) AS x, greatest(0, ly - h * 1.1) AS y FROM (
       SELECT photo_id, line, least(bbox_x, bbox_x + 0.05, bbox_x + 0.02)::DOUBLE AS lx, least(bbox_y, bbox_y + 0.01, bbox_y + 0.08)::DOUBLE AS ly, 0.05::DOUBLE AS w, 0.08::DOUBLE AS h FROM v_face))""",
    "v_face",
)
def _(spark, sf):
    x, y = F.col("bbox_x"), F.col("bbox_y")
    return faces(spark, sf).select("photo_id", "line", I.head_box([x, x + 0.05, x + 0.02], [y, y + 0.01, y + 0.08]).alias("b")).select("photo_id", "line", *_rounded(F.col("b"), "x", "y", "w", "h"))


@query(
    "crop_box",
    """SELECT photo_id, line, floor(x0)::BIGINT AS x, floor(y0)::BIGINT AS y, (ceil(x1) - floor(x0))::BIGINT AS w, (ceil(y1) - floor(y0))::BIGINT AS h FROM (
       SELECT photo_id, line, greatest(l, 0) AS x0, greatest(t, 0) AS y0, least(l + bw * 1.4, width) AS x1, least(t + bh * 1.4, height) AS y1 FROM (
       SELECT photo_id, line, width::DOUBLE AS width, height::DOUBLE AS height, bbox_w * width AS bw, bbox_h * height AS bh, bbox_x * width - bbox_w * width * 0.2 AS l, height - (bbox_y * height - bbox_h * height * 0.2 + bbox_h * height * 1.4) AS t
       FROM v_face JOIN v_photo_plain p ON p.id = photo_id WHERE width IS NOT NULL))""",
    "v_face", "v_photo_plain",
)
def _(spark, sf):
    both = faces(spark, sf).join(photos(spark, sf).select(F.col("id").alias("photo_id"), "width", "height").where("width IS NOT NULL"), "photo_id")
    box = I.crop_box(F.col("bbox_x"), F.col("bbox_y"), F.col("bbox_w"), F.col("bbox_h"), F.col("width"), F.col("height"))
    return both.select("photo_id", "line", box.alias("b")).select("photo_id", "line", *[F.col("b")[n].cast("long").alias(n) for n in ("x", "y", "w", "h")])


@query(
    "map_box",
    """SELECT photo_id, line, round(fx + bbox_x * fw, 6) + 0 AS x, round(fy + (1 - bbox_y - bbox_h) * fh, 6) + 0 AS y, round(bbox_w * fw, 6) AS w, round(bbox_h * fh, 6) AS h FROM (
       SELECT photo_id, line, bbox_x, bbox_y, bbox_w, bbox_h, width * s AS fw, height * s AS fh, (1000 - width * s) / 2 AS fx, (700 - height * s) / 2 AS fy FROM (
       SELECT *, least(1000.0::DOUBLE / width, 700.0::DOUBLE / height) AS s FROM v_face JOIN v_photo_plain p ON p.id = photo_id WHERE width IS NOT NULL))""",
    "v_face", "v_photo_plain",
)
def _(spark, sf):
    both = faces(spark, sf).join(photos(spark, sf).select(F.col("id").alias("photo_id"), "width", "height").where("width IS NOT NULL"), "photo_id")
    fit = I.aspect_fit(F.col("width"), F.col("height"), F.lit(1000.0), F.lit(700.0))
    placed = both.withColumn("fit", fit).select("photo_id", "line", I.map_box(F.col("bbox_x"), F.col("bbox_y"), F.col("bbox_w"), F.col("bbox_h"), F.col("fit")).alias("b"))
    return placed.select("photo_id", "line", *_rounded(F.col("b"), "x", "y", "w", "h"))


@query("file_names", "SELECT id, regexp_extract(relative_path, '([^/]*)$', 1) AS name, regexp_extract(relative_path, '([^/.]*)\\.[^.]*$', 1) AS stem, regexp_extract(relative_path, '\\.([^.]*)$', 1) AS extension, regexp_extract(relative_path, '([^/.]*)\\.[^.]*$', 1) || ' (2).' || regexp_extract(relative_path, '\\.([^.]*)$', 1) AS second FROM v_photo_plain", "v_photo_plain")
def _(spark, sf):
    n = X.last_component(F.col("relative_path"))
    return photos(spark, sf).select("id", n.alias("name"), X.stem(n).alias("stem"), X.extension(n).alias("extension"), X.numbered(n, F.lit(2)).alias("second"))


@query("short_counts", "SELECT person_id, CASE WHEN n >= 1000 THEN printf('%.1fk', n / 1000.0::DOUBLE) ELSE n::VARCHAR END AS shown FROM (SELECT person_id, count(*) AS n FROM v_face WHERE person_id IS NOT NULL GROUP BY 1)", "v_face")
def _(spark, sf):
    n = faces(spark, sf).where("person_id IS NOT NULL").groupBy("person_id").agg(F.count("*").alias("n"))
    return n.select("person_id", X.short_count(F.col("n")).alias("shown"))


@query("category_titles", "SELECT DISTINCT category, CASE category WHEN 'screenshot' THEN 'Screenshots' WHEN 'document' THEN 'Documents' WHEN 'identity' THEN 'Identity & cards' WHEN 'video' THEN 'Videos' ELSE '' END AS title FROM v_photo_plain", "v_photo_plain")
def _(spark, sf):
    return photos(spark, sf).select("category").distinct().select("category", X.title(F.col("category")).alias("title"))


@query("names_cleaned", "SELECT id, nullif(trim('  ' || coalesce(display_name, ' ') || ' '), '') AS name, coalesce(display_name, 'Unnamed') AS shown FROM v_person", "v_person")
def _(spark, sf):
    return view(spark, sf, "v_person").select("id", X.cleaned(F.concat(F.lit("  "), F.coalesce("display_name", F.lit(" ")), F.lit(" "))).alias("name"), X.display_name(F.col("display_name")).alias("shown"))


# --- hashes and vectors


@query("hamming_pairs", "SELECT p.id AS a, q.id AS b, bit_count(xor(p.phash, q.phash))::INT AS distance FROM v_phash p JOIN v_phash q ON p.id < q.id WHERE bit_count(xor(p.phash, q.phash)) <= 6", "v_phash")
def _(spark, sf):
    rows = view(spark, sf, "v_phash")
    near = S.hamming_pairs(rows)
    both = near.union(near.select("b", "a", "distance")).union(rows.select("phash", "phash", F.lit(0)).distinct())
    return rows.toDF("a", "h").join(both.toDF("h", "k", "distance"), "h").join(rows.toDF("b", "k"), "k").where("a < b").select("a", "b", "distance")


SETS = """, edge AS (SELECT p.id AS a, q.id AS b FROM v_photo p JOIN v_photo q ON p.id <> q.id WHERE p.phash IS NOT NULL AND q.phash IS NOT NULL AND p.state <> 'missing' AND q.state <> 'missing' AND bit_count(xor(p.phash, q.phash)) <= 6),
reach AS (SELECT a AS id, a AS root FROM edge UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.id),
comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id),
member AS (SELECT c, p.id, p.size, row_number() OVER (PARTITION BY c ORDER BY coalesce(p.width::BIGINT, 0) * coalesce(p.height, 0) DESC, p.size DESC, p.id) AS rank_in_set, count(*) OVER (PARTITION BY c) AS set_size FROM comp JOIN v_photo p USING (id)),
sets AS (SELECT first_value(id) OVER (PARTITION BY c ORDER BY rank_in_set) AS set_id, rank_in_set::INT AS rank_in_set, id, size, set_size FROM member)
"""


def _sets(spark, sf):
    return S.duplicate_sets(view(spark, sf, "v_photo").select("id", "phash", "size", "width", "height", "state"))


@query("duplicate_sets")
def _(spark, sf):
    return _sets(spark, sf)


@query("duplicate_trim_summary")
def _(spark, sf):
    return B.duplicate_totals(_sets(spark, sf))


@query("duplicate_best")
def _(spark, sf):
    members = _sets(spark, sf)
    return S.set_positions(members)


@query("duplicates_shown")
def _(spark, sf):
    members = _sets(spark, sf)
    pins = members.groupBy("set_id").agg(F.max("id").alias("id")).select("id")
    return S.shown_sets(members, photos(spark, sf), view(spark, sf, "v_root").where("id = 2"), pins).select("set_id", "rank_in_set", "id", "set_size")


@query("duplicates_trimmable")
def _(spark, sf):
    return B.trimmable(_sets(spark, sf)).select("set_id", "id")


for _name, _body in {
    "duplicate_sets": "SELECT set_id, rank_in_set, id, size, set_size FROM sets",
    "duplicate_trim_summary": "SELECT count(DISTINCT set_id) AS sets, count(*) AS photos, count(*) FILTER (WHERE rank_in_set > 1) AS trim_count, coalesce(sum(size) FILTER (WHERE rank_in_set > 1), 0)::BIGINT AS trim_bytes FROM sets",
    "duplicate_best": "SELECT set_id, set_size, row_number() OVER (ORDER BY set_size DESC, set_id) AS position FROM sets WHERE rank_in_set = 1",
    "duplicates_trimmable": "SELECT set_id, id FROM sets WHERE rank_in_set > 1",
    "duplicates_shown": """, pinned AS (SELECT max(id) AS id FROM sets GROUP BY set_id),
        here AS (SELECT s.*, count(*) OVER (PARTITION BY set_id) AS n FROM sets s JOIN v_photo p USING (id) WHERE p.root_id <> 2)
        SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY (id IN (SELECT id FROM pinned)) DESC, rank_in_set)::INT AS rank_in_set, id, n AS set_size FROM here WHERE n > 1""",
}.items():
    SQL[_name] = oracle(SETS + _body, "v_photo", "v_root")


def face_vectors(spark, sf):
    return view(spark, sf, "v_face_vec")


@query("l2_normalize", "SELECT id, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS norm, round(vec[1] / sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS first FROM v_face_vec", "v_face_vec")
def _(spark, sf):
    u = V.l2_normalized(F.col("vec"))
    return face_vectors(spark, sf).select("id", F.round(V.norm(F.col("vec")), 6).alias("norm"), F.round(F.element_at(u, 1), 6).alias("first"))


@query("cosine_pairs_under", "SELECT a.id AS a, b.id AS b, round(list_cosine_distance(a.vec, b.vec), 6) AS distance FROM v_face_vec a JOIN v_face_vec b ON a.id < b.id AND a.kind = b.kind WHERE list_cosine_distance(a.vec, b.vec) < 0.4", "v_face_vec")
def _(spark, sf):
    return S.cosine_pairs(face_vectors(spark, sf), 0.4).select("a", "b", F.round("distance", 6).alias("distance"))


@query("cosine_pairs_by_cells")
def _(spark, sf):
    """As cosine_pairs_under, in blocks so small that all kinds have many, and most of them never meet."""
    return S.cosine_pairs(face_vectors(spark, sf), 0.4, block=64).select("a", "b", F.round("distance", 6).alias("distance"))


SQL["cosine_pairs_by_cells"] = SQL["cosine_pairs_under"]


CENTROID = """, part AS (SELECT person_id, generate_subscripts(vec, 1) AS i, unnest(vec) AS x FROM v_face_vec WHERE person_id IS NOT NULL),
avgs AS (SELECT person_id, i, avg(x) AS m FROM part GROUP BY 1, 2),
cen AS (SELECT person_id, list(m ORDER BY i) AS c FROM avgs GROUP BY 1),
unit AS (SELECT person_id, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM cen),
kinds AS (SELECT person_id, max(kind) AS kind, count(*) AS n FROM v_face_vec WHERE person_id IS NOT NULL GROUP BY 1)
"""


@query("centroids", CENTROID + "SELECT person_id, round(c[1], 6) AS first, round(c[64], 6) AS last FROM unit", "v_face_vec")
def _(spark, sf):
    c = V.centroids(face_vectors(spark, sf).where("person_id IS NOT NULL"), ["person_id"])
    return c.select("person_id", F.round(F.element_at("centroid", 1), 6).alias("first"), F.round(F.element_at("centroid", -1), 6).alias("last"))


def library(spark, sf):
    """(faces, persons) of the vector fixture in the store's shape."""
    rows = face_vectors(spark, sf).select("id", F.col("id").alias("photo_id"), "kind", F.lit("fixture").alias("model"), F.col("vec").alias("embedding"), "person_id")
    c = V.centroids(rows.where("person_id IS NOT NULL").select("id", "person_id", F.col("embedding").alias("vec")), ["person_id"])
    kinds = rows.where("person_id IS NOT NULL").groupBy("person_id").agg(F.max("kind").alias("kind"), F.count("*").alias("face_count"))
    persons = c.join(kinds, "person_id").select(F.col("person_id").alias("id"), F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("long").alias("cover_face_id"), F.lit(False).alias("is_hidden"), "centroid", "face_count", F.when(F.col("kind") == "pet", "pet").alias("kind"), F.lit("fixture").alias("model"), F.lit(0.0).alias("created_at"), F.lit(0.0).alias("updated_at"))
    return rows, persons


def no_constraints(spark):
    return spark.createDataFrame([], "id long, face_a long, face_b long, kind string, created_at double")


@query("suggest_merges", CENTROID + "SELECT a.person_id AS person_a, b.person_id AS person_b, round(list_cosine_distance(a.c, b.c), 6) AS distance FROM unit a JOIN kinds ka ON ka.person_id = a.person_id JOIN unit b ON a.person_id < b.person_id JOIN kinds kb ON kb.person_id = b.person_id WHERE ka.kind = kb.kind AND list_cosine_distance(a.c, b.c) <= 0.8 ORDER BY list_cosine_distance(a.c, b.c), 1, 2 LIMIT 20", "v_face_vec")
def _(spark, sf):
    rows, persons = library(spark, sf)
    return R.suggest_merges(persons, rows, no_constraints(spark), 0.8).select("person_a", "person_b", F.round("distance", 6).alias("distance"))


@query("review_candidates")
def _(spark, sf):
    rows, persons = library(spark, sf)
    found = R.suggest_merges(persons, rows, no_constraints(spark), 0.8, None)
    return R.candidates_for(found, persons, 1, spark.createDataFrame([], "person_a long, person_b long")).select("other", F.round("distance", 6).alias("distance"), X.match_percent(F.col("distance")).alias("percent"), X.review_label(F.col("distance")).alias("label"))


SQL["review_candidates"] = oracle(CENTROID + """SELECT b.person_id AS other, round(d, 6) AS distance, round((1 - d) * 100)::INT AS percent, printf('%s · %.0f%% · %.2f', CASE WHEN d < 0.3 THEN 'likely same' ELSE 'uncertain' END, greatest(0, 1 - d) * 100, d) AS label
 FROM (SELECT b.person_id, list_cosine_distance(a.c, b.c) AS d FROM unit a JOIN kinds ka ON ka.person_id = a.person_id JOIN unit b ON b.person_id <> a.person_id JOIN kinds kb ON kb.person_id = b.person_id WHERE a.person_id = 1 AND ka.kind = kb.kind AND kb.n <= ka.n) b WHERE d <= 0.8""", "v_face_vec")  # fmt: skip

NEAR = CENTROID + """, d AS (SELECT f.id, f.person_id AS own, u.person_id, list_cosine_distance(f.vec, u.c) AS d FROM v_face_vec f JOIN kinds k ON k.kind = f.kind JOIN unit u ON u.person_id = k.person_id),
k AS (SELECT id, own, person_id, d, row_number() OVER (PARTITION BY id ORDER BY d, person_id) AS r FROM d),
two AS (SELECT a.id, a.own, a.person_id, a.d AS best, b.d AS runner_up FROM k a LEFT JOIN k b ON a.id = b.id AND b.r = 2 WHERE a.r = 1)
"""


@query("nearest_two_centroids", NEAR + "SELECT id, person_id, round(best, 6) AS best, round(runner_up, 6) AS runner_up FROM two", "v_face_vec")
def _(spark, sf):
    rows, persons = library(spark, sf)
    near = S.nearest_two(rows.select("id", "kind", F.col("embedding").alias("vec")), persons.select("id", F.coalesce("kind", F.lit("human")).alias("kind"), "centroid"))
    return near.select("id", "person_id", F.round("best", 6).alias("best"), F.round("runner_up", 6).alias("runner_up"))


@query("nearest_two_in_blocks")
def _(spark, sf):
    """As nearest_two_centroids, with centroids beyond what is broadcast."""
    rows, persons = library(spark, sf)
    near = S.nearest_two(rows.select("id", "kind", F.col("embedding").alias("vec")), persons.select("id", F.coalesce("kind", F.lit("human")).alias("kind"), "centroid"), broadcast_bytes=16 << 10)
    return near.select("id", "person_id", F.round("best", 6).alias("best"), F.round("runner_up", 6).alias("runner_up"))


SQL["nearest_two_in_blocks"] = SQL["nearest_two_centroids"]


@query("incremental_attach", NEAR + "SELECT id, person_id FROM two WHERE own IS NULL AND best < CASE WHEN (id - 1) % 10 = 9 THEN 0.5 ELSE 0.4 END AND runner_up - best >= 0.25 * CASE WHEN (id - 1) % 10 = 9 THEN 0.5 ELSE 0.4 END", "v_face_vec")
def _(spark, sf):
    rows, persons = library(spark, sf)
    return C.attach(C.usable(rows).where("person_id IS NULL"), persons).select("id", "person_id")


@query("assign_new", """SELECT id, CASE WHEN ident % 10 = 8 THEN min(id) OVER (PARTITION BY ident) ELSE ident + 1 END AS who, ident % 10 = 8 AS is_new FROM v_face_vec WHERE person_id IS NULL""", "v_face_vec")
def _(spark, sf):
    rows, persons = library(spark, sf)
    found = C.assign_new(rows, persons, next_id=10_000)
    return found.select("id", F.when(F.col("is_new"), F.min("id").over(Window.partitionBy("person_id"))).otherwise(F.col("person_id")).alias("who"), "is_new")


@query("recluster_separated", "SELECT id, min(id) OVER (PARTITION BY ident) AS grp, CASE WHEN ident % 10 = 8 THEN NULL ELSE ident + 1 END AS kept FROM v_face_vec", "v_face_vec")
def _(spark, sf):
    rows, persons = library(spark, sf)
    found = C.recluster(rows, no_constraints(spark), persons, next_id=10_000)
    return found.select("id", "grp", F.when(F.col("reused"), F.col("person_id")).alias("kept"))


@query("linkage_by_rounds", "SELECT id, CASE WHEN id IN (1, 2) THEN 1 ELSE min(id) FILTER (WHERE id NOT IN (1, 2)) OVER (PARTITION BY ident) END AS grp FROM v_face_vec", "v_face_vec")
def _(spark, sf):
    """As recluster_constrained, with every component of more than two faces taken for a large one."""
    rows, persons = library(spark, sf)
    link = spark.createDataFrame([(1, 1, 2, "mustLink", 0.0)], "id long, face_a long, face_b long, kind string, created_at double")
    return C.cluster(C.usable(rows), link, C.Config(), large=2).select("id", "grp")


@query("recluster_constrained", "SELECT id, CASE WHEN id IN (1, 2) THEN 1 ELSE min(id) FILTER (WHERE id NOT IN (1, 2)) OVER (PARTITION BY ident) END AS grp FROM v_face_vec", "v_face_vec")
def _(spark, sf):
    """A must-link of the first faces of two identities: the pair is too far from either on average, so it is a group of its own."""
    rows, persons = library(spark, sf)
    own = C.usable(rows)
    link = spark.createDataFrame([(1, 1, 2, "mustLink", 0.0)], "id long, face_a long, face_b long, kind string, created_at double")
    return C.cluster(own, link, C.Config()).select("id", "grp")


@query("confirm_same", "SELECT id, CASE WHEN person_id = 2 THEN 1 ELSE person_id END AS person_id FROM v_face_vec", "v_face_vec")
def _(spark, sf):
    rows, persons = library(spark, sf)
    return R.confirm_same(persons, rows, no_constraints(spark), 1, 2, 1.0, 1)["face"].select("id", "person_id")


@query("mark_not_person", "SELECT id, CASE WHEN person_id = 1 AND photo_id % 100 = 1 THEN 10000 ELSE person_id END AS person_id FROM (SELECT *, id AS photo_id FROM v_face_vec)", "v_face_vec")
def _(spark, sf):
    rows, persons = library(spark, sf)
    ids = [r.photo_id for r in rows.where("person_id = 1 AND photo_id % 100 = 1").select("photo_id").collect()]  # one person's photos
    return R.mark_not_person(persons, rows, no_constraints(spark), ids, 1, 1.0, 10_000, 1)[0]["face"].select("id", "person_id")


@query("constraint_pairs", "SELECT DISTINCT least(id % 7, id % 5) AS face_a, greatest(id % 7, id % 5) AS face_b, CASE WHEN id % 2 = 0 THEN 'mustLink' ELSE 'cannotLink' END AS kind FROM v_face_vec WHERE id % 7 <> id % 5", "v_face_vec")
def _(spark, sf):
    new = face_vectors(spark, sf).select((F.col("id") % 7).alias("face_a"), (F.col("id") % 5).alias("face_b"), F.when(F.col("id") % 2 == 0, "mustLink").otherwise("cannotLink").alias("kind"))
    return R.with_constraints(no_constraints(spark), new, 1, 0.0).select("face_a", "face_b", "kind")


# --- inventories


@query(
    "scan_diff",
    """SELECT relative_path || CASE WHEN id % 20 = 2 THEN '.moved' ELSE '' END AS relative_path, id,
         CASE id % 20 WHEN 0 THEN CASE WHEN state = 'missing' THEN 'absent' ELSE 'missing' END WHEN 1 THEN 'changed' ELSE 'unchanged' END AS status,
         CASE WHEN id % 20 = 0 THEN 'missing'
              WHEN id % 25 = 0 AND id % 20 <> 2 AND (id % 20 = 1 OR state IN ('missing', 'discovered')) THEN 'embedded'
              WHEN id % 20 = 1 OR state = 'missing' THEN 'discovered' ELSE state END AS state
       FROM v_photo_plain WHERE root_id = 1
       UNION ALL SELECT relative_path || '.new', NULL, 'inserted', 'discovered' FROM v_photo_plain WHERE root_id = 1 AND id % 20 = 4""",
    "v_photo_plain",
)
def _(spark, sf):
    p = photos(spark, sf)
    return N.scan_diff(p, inventory(p).where("root_id = 1"), 1, 2).select("relative_path", "id", "status", "state")


@query("scan_report", "SELECT count(*) FILTER (WHERE id % 20 = 4) AS discovered, count(*) FILTER (WHERE id % 20 = 1) AS changed, count(*) FILTER (WHERE id % 20 > 1) AS unchanged, count(*) FILTER (WHERE id % 20 = 0 AND state <> 'missing') AS missing, count(*) FILTER (WHERE id % 25 = 0 AND id % 20 NOT IN (0, 2)) AS videos FROM v_photo_plain WHERE root_id = 1", "v_photo_plain")
def _(spark, sf):
    p = photos(spark, sf)
    return N.scan_report(N.scan_diff(p, inventory(p).where("root_id = 1"), 1, 2))


@query("mark_missing", "SELECT id, CASE WHEN state = 'missing' THEN 'absent' ELSE 'missing' END AS status FROM v_photo_plain WHERE root_id = 3", "v_photo_plain")
def _(spark, sf):
    return N.mark_missing(photos(spark, sf).where("root_id = 3"), 2).select("id", "status")


@query("upsert_metadata", "SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN 100 END, width) AS width, coalesce(CASE WHEN id % 4 = 0 THEN 1.5 END, gps_lat)::DOUBLE AS gps_lat FROM v_photo_plain", "v_photo_plain")
def _(spark, sf):
    from ..sources.store import with_metadata

    p = photos(spark, sf)
    new = p.select("id", F.when(F.col("id") % 2 == 0, 100).alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("taken_at"), F.when(F.col("id") % 4 == 0, 1.5).alias("gps_lat"), F.lit(None).cast("double").alias("gps_lon"))
    return with_metadata(p, new).select("id", "width", "gps_lat")


@query("media_kinds", "SELECT id, CASE WHEN relative_path LIKE '%.mov' THEN 'video' ELSE 'image' END AS kind FROM v_photo_plain", "v_photo_plain")
def _(spark, sf):
    return photos(spark, sf).select("id", N.media_kind(F.col("relative_path")).alias("kind"))


@query("existing_files", "SELECT id FROM v_photo_plain WHERE id % 20 NOT IN (0, 2)", "v_photo_plain")
def _(spark, sf):
    p = photos(spark, sf)
    return B.existing(p, inventory(p)).select("id")


@query("export_names", "SELECT id, CASE WHEN k = 0 THEN n ELSE regexp_extract(n, '^(.*)\\.', 1) || ' (' || (k + 1) || ').jpg' END AS name FROM (SELECT id, 'IMG_' || (id % 50) || '.jpg' AS n, row_number() OVER (PARTITION BY id % 50 ORDER BY id) - CASE WHEN id % 50 < 5 THEN 0 ELSE 1 END AS k FROM v_photo_plain)", "v_photo_plain")
@query("export_names_all", "SELECT id, CASE WHEN k = 0 THEN n ELSE regexp_extract(n, '^(.*)\\.', 1) || ' (' || (k + 1) || ').jpg' END AS name FROM (SELECT id, 'IMG_' || (id % 50) || '.jpg' AS n, row_number() OVER (PARTITION BY id % 50 ORDER BY id) - CASE WHEN id % 50 < 5 THEN 0 ELSE 1 END AS k FROM v_photo_plain)", "v_photo_plain")
def _(spark, sf):
    wanted = photos(spark, sf).select("id", F.concat(F.lit("IMG_"), (F.col("id") % 50).cast("string"), F.lit(".jpg")).alias("name"))
    taken = spark.range(5).select(F.concat(F.lit("IMG_"), F.col("id").cast("string"), F.lit(".jpg")).alias("name"))
    return N.export_names(wanted, taken)


# --- changes


@query(
    "debounce_sessions",
    """SELECT user_id AS key, min(ts) AS started, max(ts) AS ended, count(*) AS n, count(DISTINCT '/lib/' || (user_id % 5 + 1)) AS n_paths FROM (
       SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
       SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
)
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("/lib/"), (F.col("user_id") % 5 + 1).cast("string")).alias("path"))
    return quiet_sessions(events, "6 hours").select("key", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n", F.size("paths").cast("long").alias("n_paths"))


SQL["debounce_sessions"] = SQL["debounce_sessions"].replace("WITH RECURSIVE \n", "")


from . import corrections, shapes  # noqa: E402, F401  (register their queries)
