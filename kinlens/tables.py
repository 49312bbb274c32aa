"""Table schemas, and tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMAS = {
    "root": "id long, display_path string, volume_uuid string, bookmark binary, added_at double, last_scanned_at double, scan_generation int",
    "photo": "id long, root_id long, relative_path string, volume_uuid string, file_id long, mtime double, size long, width int, height int, taken_at double, gps_lat double, gps_lon double, state string, scan_generation int, indexed_at double, category string, phash long, pet_kind string, favorite boolean",
    "person": "id long, display_name string, cover_face_id long, is_hidden boolean, centroid array<double>, face_count long, kind string, model string, created_at double, updated_at double",
    "face": "id long, photo_id long, bbox_x double, bbox_y double, bbox_w double, bbox_h double, roll double, yaw double, pitch double, quality double, embedding array<float>, model string, dim int, person_id long, kind string, created_at double",
    "face_constraint": "id long, face_a long, face_b long, kind string, created_at double",
}
#: States of a photo.
STATES = ("discovered", "detected", "embedded", "failed", "missing")

_shipped: set[str] = set()
_own_folder: dict[str, str] = {}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def ship(spark: SparkSession) -> None:
    """Give executors this package through Spark's own file server, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="kinlens-")) / "kinlens_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); in local mode, where none is set, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="kinlens-shared-")
    return _own_folder[app]


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage of ``df`` with a Parquet table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_tables(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinlens_path = path
    return out


def written_sorted(df: DataFrame, what: str, key: str, buckets: int) -> DataFrame:
    """Like :func:`written`, as a table bucketed by ``key`` with one sorted file a bucket: merge joins and aggregates on ``key`` read it without an
    exchange, and within :func:`sorted_scans` without a sort. :func:`discard` drops it."""
    spark = df.sparkSession
    name = f"kinlens_{what}_{uuid.uuid4().hex}"
    path = f"{_own_tables(spark)}/{name}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._kinlens_path, out._kinlens_table = path, name
    return out


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made and run here take a bucket of one sorted file as sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _own_tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/kinlens/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder; results that read them end here."""
    for t in spark.catalog.listTables(pattern="kinlens_*"):
        if t.tableType == "EXTERNAL":
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    _delete(spark, _own_tables(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*frames: DataFrame | None) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_kinlens_path", None)
        if hasattr(df, "_kinlens_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._kinlens_table}")
        if path:
            _delete(df.sparkSession, path)
