"""Watching for changes: a stream of changed paths, coalesced until it is quiet, drives incremental scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.browse import under_roots

QUIET = "2 seconds"
CHANGES = "path string, ts timestamp"


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change records (JSON lines: path, ts) that a watcher drops into a folder."""
    return spark.readStream.schema(CHANGES).json(folder)


def with_roots(changed: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, ts, path): changes under the roots (id, display_path) that hold them, by the same rule as :func:`~kinlens.operators.browse.affected_roots`."""
    own = roots.select(F.col("id").alias("key"), "display_path")
    return under_roots(changed, roots).join(own, "display_path").select("key", "ts", "path")


def quiet_sessions(events: DataFrame, quiet: str = QUIET) -> DataFrame:
    """(key, started, ended, n, paths): runs of events (key, ts, path) with less than ``quiet`` between them.

    All paths of a run are kept, not only those of its last batch. Batch or, with a watermark, streaming.
    """
    runs = events.groupBy("key", F.session_window("ts", quiet)).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.collect_set("path").alias("paths"))
    return runs.select("key", "started", "ended", "n", "paths")


def watch(events: DataFrame, rescan: Callable[[int, list[str]], None], checkpoint: str, quiet: str = QUIET, late: str = "1 seconds", with_paths: bool = True, **trigger) -> StreamingQuery:
    """Call ``rescan(root id, paths)`` for every run of changes once it is quiet; with ``with_paths`` off, ``paths`` is empty and only the ids of
    changed roots, no more than there are roots, leave the executors. Events of a null key move the watermark on, and are no change."""
    events = events.withWatermark("ts", late)
    if with_paths:
        runs = quiet_sessions(events, quiet)
    else:
        runs = events.groupBy("key", F.session_window("ts", quiet)).agg(F.max("ts").alias("ended")).select("key", "ended")

    def each(batch: DataFrame, _: int) -> None:
        batch = batch.where("key IS NOT NULL")
        if with_paths:
            found = batch.groupBy("key").agg(F.flatten(F.collect_list("paths")).alias("paths")).collect()
        else:
            found = batch.select("key", F.array().cast("array<string>").alias("paths")).distinct().collect()
        for r in found:
            rescan(r["key"], sorted(set(r["paths"])))

    return runs.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def assign_stream(new_faces: DataFrame, assign: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Give each batch of new faces and its number to ``assign``, which may get a batch again after a crash, under the same number."""
    return new_faces.writeStream.foreachBatch(assign).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
