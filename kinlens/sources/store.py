"""A snapshot store: tables as versioned Parquet folders, published together by one manifest.

Files go through Hadoop's file systems, so a store lives wherever Spark reads and writes. A manifest names the folders of each
table and the next id of each; it is written under another name and renamed, so a reader sees a whole snapshot or the one before. Ids
are never given twice.

A table is a base and levels of changes over it, each with rows (new ones, and new versions of known ids) and a list of ids that are gone. A
change writes what it changes; a reader takes base and levels in one union and leaves out, by one anti join, the rows whose id a later level
names. Past MOST_LEVELS levels they become one, or a new base where they hold a share of LARGE_SHARE of it, so each row is written again a few times
however many changes there are. Old folders stay until ``vacuum``, for those who read an older snapshot.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import SCHEMAS, empty, schema

VERSION = 6
METADATA = ("width", "height", "taken_at", "gps_lat", "gps_lon")
#: Levels of changes that a table has at most, and the share of the base's rows from which on they become a new base.
MOST_LEVELS, LARGE_SHARE = 8, 0.25


class Files:
    """The few file operations that a store needs."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, p: str, text: str) -> None:
        stream = self.fs.create(self.path(p), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, a: str, b: str) -> bool:
        return self.fs.rename(self.path(a), self.path(b))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)


class Store:
    """Tables of :data:`kinlens.tables.SCHEMAS` under a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.base = spark, path.rstrip("/")
        self.files = Files(spark, path)
        try:
            self.manifest = self._latest()
        except (ValueError, KeyError, TypeError):  # a manifest that can't be read: put the store aside and begin anew
            aside = f"{self.base}.corrupt-{uuid.uuid4().hex[:8]}"
            self.files.rename(self.base, aside)
            self.manifest = self._fresh()

    @staticmethod
    def _fresh() -> dict:
        return {"version": VERSION, "snapshot": 0, "tables": {}, "next_id": {}}

    def _latest(self) -> dict:
        found = [n for n in self.files.names(f"{self.base}/manifests") if n.endswith(".json")]
        if not found:
            return self._fresh()
        m = json.loads(self.files.read(f"{self.base}/manifests/{found[-1]}"))
        m["tables"], m["next_id"], m["snapshot"]  # noqa: B018  (missing keys are a corrupt manifest)
        return m

    def table(self, name: str) -> DataFrame:
        """The current snapshot of a table; columns that it was written without are null."""
        entry = self._entry(self.manifest, name)
        return self._read(name, entry) if entry else empty(self.spark, name)

    @staticmethod
    def _entry(manifest: dict, name: str) -> dict | None:
        """{base, n, levels} of a table; a manifest of before there were levels has the base's folder alone."""
        entry = manifest["tables"].get(name)
        return {"base": entry, "n": 0, "levels": []} if isinstance(entry, str) else entry

    def _read(self, name: str, entry: dict) -> DataFrame:
        rows = self._stacked(name, [entry["base"], *(x["rows"] for x in entry["levels"])])
        return self._latest_rows(rows, entry["levels"]).select(*schema(name).fieldNames()) if entry["levels"] else rows.drop("_level")

    def _stacked(self, name: str, folders: list[str | None], first: int = 0) -> DataFrame:
        """The rows of folders with their level."""
        parts = [self.spark.read.schema(schema(name)).parquet(f"{self.base}/{f}").withColumn("_level", F.lit(k)) for k, f in enumerate(folders, first) if f]
        out = parts[0] if parts else empty(self.spark, name).withColumn("_level", F.lit(0))
        for x in parts[1:]:  # MOST_LEVELS at most
            out = out.unionByName(x)
        return out

    def _latest_rows(self, rows: DataFrame, levels: list[dict]) -> DataFrame:
        """Rows (with ``_level``) whose id no later level names."""
        named = [self.spark.read.schema("id long").parquet(f"{self.base}/{f}").select(F.col("id").alias("_id"), F.lit(k).alias("_by")) for k, x in enumerate(levels, 1) for f in (x["rows"], x["gone"]) if f]
        ids = named[0]
        for x in named[1:]:
            ids = ids.union(x)
        ids = ids.groupBy("_id").agg(F.max("_by").alias("_by"))
        return rows.join(ids, (F.col("id") == F.col("_id")) & (F.col("_level") < F.col("_by")), "left_anti")

    def next_id(self, name: str) -> int:
        return self.manifest["next_id"].get(name, 1)

    def mark(self, name: str) -> int | None:
        """The number that was last published under a name (:meth:`commit`)."""
        return self.manifest.get("marks", {}).get(name)

    def commit(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]] | None = None, marks: dict[str, int] | None = None, /, **tables: DataFrame) -> None:
        """Write the given tables whole, and of those in ``changes`` the rows that are new or have new values (one an id) and the ids (id) of
        those that are gone; publish all together, and with them ``marks``, such as the number of a stream's batch. The next ids rise over all ids
        written, and never fall."""
        n = self.manifest["snapshot"] + 1
        new = json.loads(json.dumps(self.manifest)) | {"snapshot": n}
        new["marks"] = new.get("marks", {}) | (marks or {})
        for name, df in tables.items():
            new["tables"][name] = {"levels": []} | dict(zip(("base", "n"), self._written(name, df, n, new)))
        for name, (rows, gone) in (changes or {}).items():
            entry = self._entry(new, name)
            if entry is None:
                entry = {"levels": []} | dict(zip(("base", "n"), self._written(name, empty(self.spark, name), n, new)))
            level = dict(zip(("rows", "n"), self._written(name, rows, n, new) if rows is not None else (None, 0))) | {"gone": None}
            if gone is not None:
                level["gone"] = f"{name}/gone-{n:08d}-{uuid.uuid4().hex[:8]}"
                gone.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct().write.parquet(f"{self.base}/{level['gone']}")
            entry["levels"].append(level)
            new["tables"][name] = self._compacted(name, entry, n, new) if len(entry["levels"]) > MOST_LEVELS else entry
        draft, final = f"{self.base}/manifests/.draft-{uuid.uuid4().hex}", f"{self.base}/manifests/{n:08d}.json"
        self.files.write(draft, json.dumps(new))
        if self.files.exists(final) or not self.files.rename(draft, final):
            self.files.delete(draft)
            raise RuntimeError(f"snapshot {n} was published by another writer")
        self.manifest = new

    def _written(self, name: str, df: DataFrame, n: int, new: dict) -> tuple[str, int]:
        """The folder that rows were written to, and their number; the next id rises over theirs."""
        folder = f"{name}/v={n:08d}-{uuid.uuid4().hex[:8]}"
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(name).fields]).write.parquet(f"{self.base}/{folder}")
        top = self.spark.read.schema(schema(name)).parquet(f"{self.base}/{folder}").agg(F.max("id").alias("top"), F.count("*").alias("n")).first()
        new["next_id"][name] = max(new["next_id"].get(name, 1), (top["top"] or 0) + 1)
        return folder, top["n"]

    def _compacted(self, name: str, entry: dict, n: int, new: dict) -> dict:
        """The levels as one, or as a new base where they are large."""
        if sum(x["n"] for x in entry["levels"]) >= LARGE_SHARE * entry["n"]:
            return {"levels": []} | dict(zip(("base", "n"), self._written(name, self._read(name, entry), n, new)))
        rows = self._latest_rows(self._stacked(name, [x["rows"] for x in entry["levels"]], 1), entry["levels"])
        level = dict(zip(("rows", "n"), self._written(name, rows, n, new))) | {"gone": None}
        lists = [f"{self.base}/{x['gone']}" for x in entry["levels"] if x["gone"]]
        if lists:
            level["gone"] = f"{name}/gone-{n:08d}-{uuid.uuid4().hex[:8]}"
            self.spark.read.schema("id long").parquet(*lists).distinct().write.parquet(f"{self.base}/{level['gone']}")
        return entry | {"levels": [level]}

    def reserve(self, name: str, count: int) -> int:
        """The first of ``count`` new ids; they are taken even if no row keeps them."""
        first = self.next_id(name)
        self.manifest["next_id"][name] = first + count
        return first

    def vacuum(self) -> None:
        """Delete folders that the current snapshot doesn't name."""
        entries = [self._entry(self.manifest, name) for name in self.manifest["tables"]]
        held = {f for e in entries for f in (e["base"], *(f for x in e["levels"] for f in (x["rows"], x["gone"])))}
        for name in SCHEMAS:
            for folder in self.files.names(f"{self.base}/{name}"):
                if f"{name}/{folder}" not in held:
                    self.files.delete(f"{self.base}/{name}/{folder}")


def with_metadata(photos: DataFrame, new: DataFrame) -> DataFrame:
    """Photos with metadata (id and METADATA) written over; a null leaves what was there."""
    n = new.select("id", *[F.col(c).alias(f"_{c}") for c in METADATA])
    both = photos.join(n, "id", "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in METADATA else F.col(c) for c in photos.columns])


def with_values(photos: DataFrame, new: DataFrame) -> DataFrame:
    """Photos with the other columns of ``new`` (id, ...) written over, nulls included, where ``new`` has the id."""
    names = [c for c in new.columns if c != "id"]
    n = new.select("id", *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_has"))
    both = photos.join(n, "id", "left")
    return both.select(*[F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in photos.columns])


def with_root(roots: DataFrame, path: str, volume: str | None, bookmark: bytes | None, now: float, next_id: int) -> DataFrame:
    """Roots with a folder added, or its volume and, if given, its bookmark renewed."""
    own = F.col("display_path") == path
    if roots.where(own).isEmpty():
        row = roots.sparkSession.createDataFrame([(next_id, path, volume, bookmark, now, None, 0)], schema("root"))
        return roots.unionByName(row)
    return roots.withColumns({"volume_uuid": F.when(own, F.lit(volume)).otherwise(F.col("volume_uuid")), "bookmark": F.when(own & F.lit(bookmark is not None), F.lit(bookmark)).otherwise(F.col("bookmark"))})


def dead_constraints(constraints: DataFrame, dead: DataFrame) -> DataFrame:
    """Ids of the constraints that name one of the ``dead`` faces (id)."""
    of = lambda c: constraints.join(dead.select(F.col("id").alias(c)), c, "left_semi").select("id")
    return of("face_a").union(of("face_b"))


def without_photos(photos: DataFrame, faces: DataFrame, constraints: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The three tables without photos (id), their faces, and those faces' constraints."""
    dead = faces.join(gone.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").select("id")
    left = constraints.join(dead.select(F.col("id").alias("face_a")), "face_a", "left_anti").join(dead.select(F.col("id").alias("face_b")), "face_b", "left_anti")
    return {"photo": photos.join(gone.select("id"), "id", "left_anti").select(*photos.columns), "face": faces.join(dead, "id", "left_anti").select(*faces.columns), "face_constraint": left.select(*constraints.columns)}
