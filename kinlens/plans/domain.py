"""The driver's tables as a media library: one text for each view, in Spark's and in DuckDB's dialect.

Photos are orders, faces are line items, people are suppliers folded to ten, face vectors and hashes come from embeddings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession



@dataclass(frozen=True)
class Dialect:
    """What the two engines spell differently."""

    name: str

    def table(self, t: str) -> str:
        return "{" + t + "}" if self.name == "spark" else t

    def epoch(self, x: str) -> str:
        return f"cast(unix_timestamp(cast({x} as timestamp)) as double)" if self.name == "spark" else f"cast(epoch({x}) as double)"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})" if self.name == "spark" else f"({a} // {b})"

    def mixed(self, a: str, b: str, share: str) -> str:
        """a + share * b, element by element, in doubles."""
        if self.name == "spark":
            return f"zip_with({a}, {b}, (x, y) -> cast(x as double) + {share}D * cast(y as double))"
        return f"list_transform(range(1, len({a}) + 1), lambda i: cast({a}[i] as double) + cast({share} as double) * cast({b}[i] as double))"

    def rising_bits(self, v: str) -> str:
        """Bit i - 1 is set where element i is over element i + 1, for i from 1 to 63."""
        if self.name == "spark":
            return f"aggregate(sequence(1, 63), 0L, (s, i) -> s | if(element_at({v}, i) > element_at({v}, i + 1), shiftleft(1L, i - 1), 0L))"
        return f"list_reduce(list_transform(range(1, 64), lambda i: case when {v}[i] > {v}[i + 1] then cast(1 as bigint) << (i - 1) else cast(0 as bigint) end), lambda a, b: a | b)"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")


def views(d: Dialect) -> dict[str, str]:
    t = d.table
    day = d.epoch("o_orderdate")
    return {
        "v_root": f"SELECT r_regionkey + 1 AS id, '/lib/' || r_name AS display_path, cast(r_regionkey * 100 as double) AS added_at FROM {t('region')}",
        "v_photo_plain": f"""
            SELECT o_orderkey AS id, cast(n_regionkey + 1 as bigint) AS root_id,
              o_orderpriority || '/' || CASE WHEN o_orderkey % 12 = 0 THEN 'Screenshot_' ELSE 'IMG_' END || cast(o_orderkey as string)
                || CASE WHEN o_orderkey % 25 = 0 THEN '.mov' WHEN o_orderkey % 4 = 0 THEN '.png' ELSE '.jpg' END AS relative_path,
              'VOL' AS volume_uuid, o_orderkey AS file_id,
              {day} + 86400 * (o_orderkey % 7) AS mtime,
              CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {day} END AS taken_at,
              cast(round(o_totalprice * 100) as bigint) AS size,
              CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(640 * (1 + o_orderkey % 4) as int) END AS width,
              CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(480 * (1 + o_orderkey % 3) as int) END AS height,
              CASE WHEN o_orderkey % 3 = 0 THEN (c_custkey % 120) - 60 + (o_orderkey % 10) / cast(100 as double) END AS gps_lat,
              CASE WHEN o_orderkey % 3 = 0 THEN c_nationkey * 12 - 150 + (o_orderkey % 7) / cast(100 as double) END AS gps_lon,
              CASE WHEN o_orderstatus = 'F' THEN 'embedded' WHEN o_orderstatus = 'O' THEN 'discovered' WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'missing' END AS state,
              1 AS scan_generation,
              CASE WHEN o_orderstatus = 'O' THEN NULL ELSE {day} + 86400 * (o_orderkey % 7) + 3600 END AS indexed_at,
              CASE o_orderkey % 10 WHEN 0 THEN 'screenshot' WHEN 1 THEN 'document' WHEN 2 THEN 'identity' WHEN 3 THEN 'video' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'other' END AS category,
              CASE o_orderkey % 17 WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' END AS pet_kind,
              o_orderkey % 11 = 0 AS favorite
            FROM {t('orders')} JOIN {t('customer')} ON o_custkey = c_custkey JOIN {t('nation')} ON c_nationkey = n_nationkey""",
        "v_face": f"""
            SELECT l_orderkey AS photo_id, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_suppkey % 10 + 1 END AS person_id,
              CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 10 END AS quality,
              l_discount AS bbox_x, l_tax AS bbox_y, cast(0.2 as double) AS bbox_w, cast(0.2 as double) AS bbox_h,
              CASE WHEN l_partkey % 20 = 0 THEN 'pet' END AS kind, l_linenumber AS line
            FROM {t('lineitem')}""",
        "v_person": f"""
            SELECT k AS id, CASE WHEN k % 4 = 0 THEN NULL ELSE 'Person ' || cast(k as string) END AS display_name, k % 9 = 0 AS is_hidden, cast(NULL as string) AS kind
            FROM (SELECT DISTINCT s_suppkey % 10 + 1 AS k FROM {t('supplier')}) p""",
        "v_face_vec": f"""
            SELECT e.vec_id + 1 AS id, {d.mixed('b.embedding', 'e.embedding', '0.4')} AS vec, e.vec_id % 50 AS ident,
              CASE WHEN (e.vec_id % 50) % 10 = 9 THEN 'pet' ELSE 'human' END AS kind,
              CASE WHEN {d.div('e.vec_id', '50')} % 5 = 4 OR (e.vec_id % 50) % 10 = 8 THEN NULL ELSE e.vec_id % 50 + 1 END AS person_id
            FROM {t('embeddings')} e JOIN {t('embeddings')} b ON b.vec_id = e.vec_id % 50""",
        "v_phash": f"""
            SELECT id, {d.rising_bits('v')} AS phash FROM (
              SELECT e.vec_id AS id, {d.mixed('b.embedding', 'e.embedding', '0.03')} AS v FROM {t('embeddings')} e JOIN {t('embeddings')} b ON b.vec_id = e.vec_id % 100) q""",
    }


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL of ``body`` over the views it names."""
    all_ = views(DUCKDB) | {"v_photo": "SELECT p.*, h.phash FROM v_photo_plain p LEFT JOIN v_phash h ON h.id = p.id"}
    need = ["v_photo_plain", "v_phash", "v_photo"] if "v_photo" in names else []
    need += [n for n in names if n not in need]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({all_[n]})" for n in need) + "\n" + body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; columns that a query doesn't ask for are never read."""
    if name == "v_photo":
        return view(spark, sf_dir, "v_photo_plain").join(view(spark, sf_dir, "v_phash"), "id", "left")
    text = views(SPARK)[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "embeddings") if "{" + t + "}" in text}
    return spark.sql(text, **used)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with their face counts."""
    from ..operators.browse import face_counts

    persons = view(spark, sf_dir, "v_person")
    return persons.join(face_counts(persons, view(spark, sf_dir, "v_face")), "id")


def inventory(photos: DataFrame) -> DataFrame:
    """A second listing: every twentieth file is gone, another changed, another renamed, and another has a new file beside it."""
    from pyspark.sql import functions as F

    k = F.col("id") % 20
    same = photos.where(k != 0).select(
        F.when(k == 2, F.concat("relative_path", F.lit(".moved"))).otherwise(F.col("relative_path")).alias("relative_path"),
        "volume_uuid",
        "file_id",
        F.when(k == 1, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"),
        "size",
        F.col("relative_path").endswith(".mov").alias("is_video"),
        "root_id",
    )
    new = photos.where(k == 4).select(F.concat("relative_path", F.lit(".new")).alias("relative_path"), "volume_uuid", (F.col("file_id") + 1_000_000_000).alias("file_id"), "mtime", "size", F.lit(False).alias("is_video"), "root_id")
    return same.unionByName(new)
