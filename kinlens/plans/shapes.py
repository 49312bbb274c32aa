"""Registered queries over landmarks and their fits, sizes as text, and centroids renewed: each face's points derive from its row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import text as X
from ..operators import review as R
from ..tables import ship
from .catalog import CENTROID, faces, library, photos, query

#: A face's number: its photo's and its place there.
_ID = "photo_id * 8 + line"
_FACE = f"(SELECT *, ({_ID})::BIGINT AS id FROM v_face)"
_BYTES = "(size + id) * CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1009 ELSE 1000003 END + id % 1000"


@query("byte_sizes", f"""SELECT id, CASE WHEN n < 1000 THEN n || ' bytes' WHEN n < 1000000 THEN (n + 500) // 1000 || ' KB'
  WHEN n < 1000000000 THEN (n + 50000) // 100000 // 10 || '.' || (n + 50000) // 100000 % 10 || ' MB'
  ELSE (n + 5000000) // 10000000 // 100 || '.' || lpad(((n + 5000000) // 10000000 % 100)::VARCHAR, 2, '0') || ' GB' END AS shown
  FROM (SELECT id, ({_BYTES})::BIGINT AS n FROM v_photo_plain)""", "v_photo_plain")  # fmt: skip
def _(spark, sf):
    return photos(spark, sf).select("id", X.byte_size(F.expr(_BYTES).cast("long")).alias("shown"))


def _numbered(spark, sf):
    return faces(spark, sf).withColumn("id", F.expr(_ID).cast("long"))


#: A face's regions in its box: two points an eye, one of the nose, three of the lips; every eleventh face lacks an eye, every seventh the nose, every fifth the lips.
_SHIFT = "(id % 17) / 100.0"


@query("landmark_points", f"""SELECT id, round(bbox_x + (0.25 + s) * bbox_w, 6) AS left_x, round(1 - (bbox_y + 0.65 * bbox_h), 6) AS left_y,
  round(CASE WHEN id % 7 = 0 THEN bbox_x + (0.45 + s) * bbox_w ELSE bbox_x + 0.5 * bbox_w END, 6) AS nose_x, round(1 - (bbox_y + CASE WHEN id % 7 = 0 THEN 0.65 ELSE 0.5 END * bbox_h), 6) AS nose_y,
  round(bbox_x + CASE WHEN id % 5 = 0 THEN 0.25 + s ELSE 0.3 END * bbox_w, 6) AS corner_x, round(bbox_x + CASE WHEN id % 5 = 0 THEN 0.65 + s ELSE 0.7 END * bbox_w, 6) AS other_x
  FROM (SELECT *, ({_SHIFT})::DOUBLE AS s FROM {_FACE}) WHERE id % 11 <> 0 UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL FROM {_FACE} WHERE id % 11 = 0""", "v_face")  # fmt: skip
def _(spark, sf):
    s = F.expr(_SHIFT).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    none = F.array().cast("array<struct<x:double,y:double>>")
    left = F.when(F.col("id") % 11 == 0, none).otherwise(F.array(point(s + 0.2, 0.6), point(s + 0.3, 0.7)))
    right = F.array(point(s + 0.6, 0.6), point(s + 0.7, 0.7))
    nose = F.when(F.col("id") % 7 == 0, none).otherwise(F.array(point(F.lit(0.5), 0.5)))
    lips = F.when(F.col("id") % 5 == 0, none).otherwise(F.array(*[point(F.lit(x), y) for x, y in ((0.7, 0.2), (0.5, 0.25), (0.3, 0.2))]))
    box = F.struct(*[F.col(f"bbox_{c}").cast("double").alias(c) for c in "xywh"])
    p = _numbered(spark, sf).select("id", I.five_points(left, right, nose, lips, box).alias("p"))
    of = lambda k, c: F.round(F.col("p")[k][c], 6)
    return p.select("id", of(0, "x").alias("left_x"), of(0, "y").alias("left_y"), of(2, "x").alias("nose_x"), of(2, "y").alias("nose_y"), of(3, "x").alias("corner_x"), of(4, "x").alias("other_x"))


#: Unit points before a face's own shifts: five of faces (y from the top), three of pets (y from the bottom).
FACE_POINTS = ((0.3, 0.35), (0.6, 0.36), (0.45, 0.5), (0.35, 0.7), (0.55, 0.71))
PET_POINTS = ((0.3, 0.65), (0.6, 0.64), (0.45, 0.4))
_W, _H = 640, 480


def _fits(batches):
    """(id, a, b, tx, ty) of each face's or pet's points onto the template; of even ids the pairs come the other way round."""
    for pdf in batches:
        for pet, base, turned in ((False, FACE_POINTS, [1, 0, 2, 4, 3]), (True, PET_POINTS, [1, 0, 2])):
            i = pdf["id"].to_numpy()
            i = i[(i % 3 == 0) == pet]
            k = np.arange(len(base))
            p = np.array(base) + np.stack([i[:, None] * (k + 3) % 17, i[:, None] * (k + 5) % 13], 2) / 200
            p[i % 2 == 0] = p[i % 2 == 0][:, turned]
            yield pd.DataFrame(I.template_transforms(p, _W, _H), columns=["a", "b", "tx", "ty"]).assign(id=i)[["id", "a", "b", "tx", "ty"]]


def _values(points, template) -> str:
    side = I.TEMPLATE_SIDE
    return ", ".join(f"({k}, {x}, {y}, {float(u)}, {side - float(v)})" for k, ((x, y), (u, v)) in enumerate(zip(points, template)))


@query("template_transforms", f""", points(pet, k, px, py, u, v) AS (SELECT false, * FROM (VALUES {_values(FACE_POINTS, I.FACE_TEMPLATE)}) UNION ALL SELECT true, * FROM (VALUES {_values(PET_POINTS, I.PET_TEMPLATE)})),
  placed AS (SELECT id, (px + (id * (k + 3) % 17) / 200.0)::DOUBLE * {_W} AS x, (CASE WHEN pet THEN py + (id * (k + 5) % 13) / 200.0 ELSE 1 - (py + (id * (k + 5) % 13) / 200.0) END)::DOUBLE * {_H} AS y, u::DOUBLE AS u, v::DOUBLE AS v FROM (SELECT DISTINCT id FROM {_FACE}) JOIN points ON pet = (id % 3 = 0)),
  means AS (SELECT id, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM placed GROUP BY id),
  fit AS (SELECT id, mx, my, mu, mv, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) / sum((x - mx) ** 2 + (y - my) ** 2) AS a, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) / sum((x - mx) ** 2 + (y - my) ** 2) AS b FROM placed JOIN means USING (id) GROUP BY id, mx, my, mu, mv)
  SELECT id, round(a, 6) AS a, round(b, 6) AS b, round(mu - a * mx + b * my, 4) AS tx, round(mv - b * mx - a * my, 4) AS ty FROM fit""", "v_face")  # fmt: skip
def _(spark, sf):
    ship(spark)
    fits = _numbered(spark, sf).select("id").distinct().mapInPandas(_fits, "id long, a double, b double, tx double, ty double")
    return fits.select("id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("tx", 4).alias("tx"), F.round("ty", 4).alias("ty"))


@query("centroids_refreshed", CENTROID + "SELECT k.person_id AS id, k.n AS face_count, CASE WHEN k.person_id % 3 = 0 THEN round(u.c[1], 6) END AS first, CASE WHEN k.person_id % 3 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS updated_at FROM kinds k JOIN unit u USING (person_id)", "v_face_vec")
def _(spark, sf):
    """People whose centroids were lost: those of every third are made anew, the others' stay as they are."""
    rows, persons = library(spark, sf)
    stale = persons.withColumn("centroid", F.lit(None).cast("array<double>")).withColumn("cover_face_id", F.lit(None).cast("long"))
    touched = persons.where("id % 3 = 0").select(F.col("id").alias("person_id"))
    return R.refreshed(stale, rows, 5.0, touched).select("id", "face_count", F.round(F.element_at("centroid", 1), 6).alias("first"), "updated_at")
