"""A journal of folder changes: each observation lists the roots anew, and what differs from the listing before is a batch of a stream.

A journal is a folder of versions. A version holds the listing of all roots and the changes since the version before; it is put together under another
name and published by one rename, so a reader sees all of it or nothing, and an observation that fails is made again from the last published listing.
:meth:`Journal.stream` reads the changes as a stream of files: Spark's checkpoint remembers what was read, so each change arrives once, across
restarts too. Listings and differences are Spark jobs, whatever a root's size; what passes the driver is one row a root.

Defined results: only media count, as in a scan. A root's first listing is no change. A root that can't be listed (an unmounted volume) keeps its listing,
and what changed meanwhile arrives when it is back; a root that is removed leaves without changes. A file that moves within its root is one change (renamed)
where the file system has inodes, and otherwise one deleted and one created; of several files of one inode, the first by path moves. Renames must be
atomic where the journal lies, as they are on hdfs and local disks, and only one program may observe.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.inventory import listed_with_inodes
from ..sources.store import Files
from ..tables import discard, written

CHANGES = "key long, kind string, path string, moved_from string, ts timestamp"
LISTING = "root_id long, relative_path string, volume_uuid string, file_id long, mtime double, size long"
#: Seconds after a change for which observations are published though nothing changed: their marks bring the stream's watermark past it.
SETTLE = 5.0
#: Times in a row that a stream may fail before :func:`supervise` gives up.
MOST_FAILURES = 3


class Journal:
    """Versions of listings and changes under a folder."""

    def __init__(self, spark: SparkSession, path: str, settle: float = SETTLE) -> None:
        self.spark, self.base, self.settle = spark, path.rstrip("/"), settle
        self.files = Files(spark, path)

    def versions(self) -> list[int]:
        return [int(n) for n in self.files.names(f"{self.base}/versions") if n.isdigit()]

    def _folder(self, version: int) -> str:
        return f"{self.base}/versions/{version:08d}"

    def stream(self) -> DataFrame:
        """The changes (key, kind, path, moved_from, ts) as they are published, the key being the root's id; marks have a null key."""
        self.files.fs.mkdirs(self.files.path(f"{self.base}/versions"))
        return self.spark.readStream.schema(CHANGES).parquet(f"{self.base}/versions/*/changes")

    def observe(self, roots: DataFrame, now: float | None = None) -> dict[str, int]:
        """List the roots (id, display_path) and publish what changed; numbers of changes by kind."""
        now = float(now or time.time())
        self.files.delete(f"{self.base}/drafts")
        known = self.versions()
        last = known[-1] if known else 0
        for v in known[:-1]:  # listings that a later one stands for, of observations that ended before they could delete them
            self.files.delete(f"{self._folder(v)}/listing")
        before = json.loads(self.files.read(f"{self._folder(last)}/state.json")) if last else {"roots": {}, "changed": None, "ts": 0.0}
        wanted = {str(r["id"]): r["display_path"] for r in roots.select("id", "display_path").collect()}  # one row a folder that a person chose
        held = {k for k, path in before["roots"].items() if wanted.get(k) == path}
        now_listed, frames = {}, []
        for k, path in wanted.items():
            try:
                own = listed_with_inodes(self.spark, path)
            except PySparkException as e:
                if "NotADirectoryError" not in str(e):
                    raise
                continue
            now_listed[k] = path
            frames.append(own.select(F.lit(int(k)).alias("root_id"), "relative_path", "volume_uuid", "file_id", "mtime", "size"))
        old = self.spark.read.schema(LISTING).parquet(f"{self._folder(last)}/listing") if last else self.spark.createDataFrame([], LISTING)
        new = self.spark.createDataFrame([], LISTING)
        for f in frames:
            new = new.unionByName(f)
        new = written(new, "listing")
        both = [int(k) for k in held & now_listed.keys()]
        found = written(differences(old.where(F.col("root_id").isin(both)), new.where(F.col("root_id").isin(both))), "differences")
        counts = {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        away = held - now_listed.keys()
        watched = now_listed | {k: before["roots"][k] for k in away}
        changed = now if counts else before["changed"]
        settling = before["changed"] is not None and before["ts"] < before["changed"] + self.settle
        if counts or settling or watched != before["roots"] or not last:
            paths = self.spark.createDataFrame([(int(k), p.rstrip("/")) for k, p in watched.items()], "root_id long, root string")
            full = lambda c: F.concat("root", F.lit("/"), F.col(c))
            at = F.lit(now).cast("timestamp")
            rows = found.join(F.broadcast(paths), "root_id").select(F.col("root_id").alias("key"), "kind", full("relative_path").alias("path"), full("moved_from").alias("moved_from"), at.alias("ts"))
            mark = self.spark.range(1).select(F.lit(None).cast("long").alias("key"), F.lit("mark").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("moved_from"), at.alias("ts"))
            kept = old.where(F.col("root_id").isin([int(k) for k in away]))
            self._publish(last + 1, new.unionByName(kept), rows.unionByName(mark), {"roots": watched, "changed": changed, "ts": now})
            if last:
                self.files.delete(f"{self._folder(last)}/listing")
        discard(new, found)
        return counts

    def _publish(self, version: int, listing: DataFrame, changes: DataFrame, state: dict) -> None:
        draft = f"{self.base}/drafts/{uuid.uuid4().hex}"
        listing.write.parquet(f"{draft}/listing")
        changes.write.parquet(f"{draft}/changes")
        self.files.write(f"{draft}/state.json", json.dumps(state))
        self.files.fs.mkdirs(self.files.path(f"{self.base}/versions"))
        if self.files.exists(self._folder(version)) or not self.files.rename(draft, self._folder(version)):
            raise RuntimeError(f"version {version} was published by another observer")

    def forget(self, before: int) -> None:
        """Delete the changes of versions that every stream has read; the last version stays."""
        for v in self.versions()[:-1]:
            if v < before:
                self.files.delete(self._folder(v))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(root_id, relative_path, kind, moved_from) between two listings: created, modified, renamed and deleted."""
    key = ["root_id", "relative_path"]
    a = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in ("volume_uuid", "file_id", "mtime", "size")], F.lit(True).alias("was"))
    b = new.select(*key, "volume_uuid", "file_id", "mtime", "size", F.lit(True).alias("is"))
    both = a.join(b, key, "full")
    same = F.lit(True)
    for c in ("volume_uuid", "file_id", "mtime", "size"):
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    kind = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "deleted").when(~same, "modified")
    both = written(both.withColumn("kind", kind).where("kind IS NOT NULL"), "changed")
    inode = ["root_id", "volume_uuid", "file_id"]
    came = both.where("kind = 'created' AND volume_uuid IS NOT NULL AND file_id IS NOT NULL").groupBy(*inode).agg(F.min("relative_path").alias("relative_path"))
    went = both.where("kind = 'deleted' AND o_volume_uuid IS NOT NULL AND o_file_id IS NOT NULL")
    went = went.groupBy("root_id", F.col("o_volume_uuid").alias("volume_uuid"), F.col("o_file_id").alias("file_id")).agg(F.min("relative_path").alias("moved_from"))
    moved = written(came.join(went, inode).select("root_id", "relative_path", "moved_from"), "moved")
    rest = both.select("root_id", "relative_path", "kind")
    rest = rest.join(moved.select("root_id", "relative_path").unionByName(moved.select("root_id", F.col("moved_from").alias("relative_path"))), key, "left_anti")
    return rest.withColumn("moved_from", F.lit(None).cast("string")).unionByName(moved.select("root_id", "relative_path", F.lit("renamed").alias("kind"), "moved_from"))


def supervise(observe: Callable[[], object], start: Callable[[], StreamingQuery], every: float, stop: threading.Event) -> None:
    """Observe every few seconds until ``stop`` is set, beside a stream that is started again when it fails, as from a change that another
    writer published first; what it was at is read again. A stream that fails MOST_FAILURES times in a row, without a finished batch between, raises."""
    query, failures, done = start(), 0, -1
    try:
        while not stop.wait(every):
            observe()
            progress = query.lastProgress
            if progress is not None and progress["batchId"] > done:
                done, failures = progress["batchId"], 0
            if not query.isActive:
                failures += 1
                if failures >= MOST_FAILURES:
                    raise query.exception() or RuntimeError("the stream of changes ended")
                query = start()
    finally:
        query.stop()
