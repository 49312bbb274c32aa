"""Folders and file contents, listed and read where tasks run: no path, name or content passes through the driver.

Paths without a scheme are on a file system that executors mount; others (hdfs, s3a, gs, file) go through Arrow's file systems. Names are
taken as they are, so what Spark's own file sources hide or can't spell (``_DSC0001.jpg``, ``_raw/``, ``a:b.jpg``, ``[1].jpg``) is found and read.

A folder is listed in rounds over a table of folders: each round lists the folders that the one before found, dealt out anew, and then the
files' sizes and times are looked up, dealt out by name. So neither a deep tree nor one folder of a million files is work of one task: of such a folder
one task streams the names, and no more than that.

Defined results: links are not followed; hidden files and folders (a dot first) and packages are left out; a folder or file that goes meanwhile, or may not
be read, is left out of a listing; a root that is no folder is an error; a file that can't be opened, or is longer than ``longest``, has null content and
harms no other.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, ship, written

#: Folders that are one document, and are not looked into.
PACKAGES = ("app", "bundle", "photoslibrary", "framework", "plugin", "pkg", "rtfd", "xcodeproj")
#: Names of an Arrow batch, bytes of one, and bytes that one task is to read, about.
NAMES, BATCH_BYTES, TASK_BYTES = 10_000, 8 << 20, 128 << 20
#: Bytes of a file at most, which have to be a value of a row.
LONGEST = 1 << 30

ENTRIES = "relative_path string, is_folder boolean, mtime double, size long"
FILES = "relative_path string, volume_uuid string, file_id long, mtime double, size long"
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]+):")


def _remote(path: str):
    """(Arrow's file system, path within it), or null for a path without a scheme."""
    if not _SCHEME.match(path):
        return None
    from pyarrow import fs

    scheme = _SCHEME.match(path)[1]
    if scheme == "file":  # as Hadoop spells it, with any number of slashes, and characters as they are
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    base, inner = re.match(r"^([^:]+://[^/]*)(.*)$", path.replace("s3a:", "s3:", 1) if scheme == "s3a" else path).groups()
    system, place = fs.FileSystem.from_uri(base)
    return system, place.rstrip("/") + inner if place not in ("", "/") else inner


def _wanted(name: str, is_folder: bool) -> bool:
    return not name.startswith(".") and not (is_folder and name.rpartition(".")[0] and name.rpartition(".")[2].lower() in PACKAGES)


def _entries(root: str, folder: str) -> Iterator[tuple]:
    """(relative path, whether a folder, time, size) of what is in a folder; time and size where they cost nothing."""
    path = f"{root}/{folder}" if folder else root
    under = f"{folder}/" if folder else ""
    if (remote := _remote(path)) is not None:
        from pyarrow import fs

        for x in remote[0].get_file_info(fs.FileSelector(remote[1], allow_not_found=True)):
            if x.type in (fs.FileType.File, fs.FileType.Directory) and _wanted(x.base_name, x.type == fs.FileType.Directory):
                yield under + x.base_name, x.type == fs.FileType.Directory, x.mtime_ns / 1e9 if x.mtime_ns is not None else None, x.size
        return
    try:
        with os.scandir(path or "/") as found:
            for x in found:
                is_folder = x.is_dir(follow_symlinks=False)
                if (is_folder or x.is_file(follow_symlinks=False)) and _wanted(x.name, is_folder):
                    yield under + x.name, is_folder, None, None
    except (FileNotFoundError, PermissionError, NotADirectoryError):
        return


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == NAMES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _dealt(df: DataFrame, n: int, column: str) -> DataFrame:
    """``n`` rows dealt out to as many tasks as there are, or are worth it."""
    return df.repartition(max(1, min(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))), column)


def files_under(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, volume_uuid, file_id, mtime, size) of the files under a folder; volume and inode where there are such."""
    ship(spark)
    root = root.rstrip("/")
    entries_schema, files_schema = _arrow(ENTRIES), _arrow(FILES)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                yield from _batches(_entries(root, folder), entries_schema)

    def details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b: pa.RecordBatch) -> Iterator[tuple]:
            for path, _, mtime, size in zip(*(c.to_pylist() for c in b.columns)):
                if size is not None:
                    yield path, None, None, mtime, size
                    continue
                try:
                    s = os.lstat(f"{root}/{path}")
                except OSError:  # gone, or not ours to read
                    continue
                if stat.S_ISREG(s.st_mode):
                    yield path, str(s.st_dev), s.st_ino, s.st_mtime, s.st_size

        for b in batches:
            yield from _batches(rows(b), files_schema)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # where folders are read, not on the driver
        from pyarrow import fs

        remote = _remote(root)
        if remote is None and not os.path.isdir(root or "/") or remote is not None and remote[0].get_file_info(remote[1]).type != fs.FileType.Directory:
            raise NotADirectoryError(root)
        yield from batches

    level = written(spark.createDataFrame([("",)], "folder string").mapInArrow(check, "folder string").mapInArrow(look, ENTRIES), "entries")
    levels = [level]
    while n := level.where("is_folder").count():
        level = written(_dealt(level.where("is_folder").select("relative_path"), n, "relative_path").mapInArrow(look, ENTRIES), "entries")
        levels.append(level)
    found = levels[0]
    for x in levels[1:]:  # as many as the tree is deep
        found = found.union(x)
    found = found.where("NOT is_folder")
    out = written(_dealt(found, found.count(), "relative_path").mapInArrow(details, FILES), "files")
    discard(*levels)
    return out


def _content(path: str, longest: int) -> bytes | None:
    try:
        if (remote := _remote(path)) is not None:
            if remote[0].get_file_info(remote[1]).size > longest:
                return None
            with remote[0].open_input_stream(remote[1]) as f:
                return f.read()
        with open(path, "rb") as f:
            return None if os.fstat(f.fileno()).st_size > longest else f.read()
    except (OSError, ValueError, TypeError, pa.ArrowException):  # this file's trouble alone
        return None


def contents(paths: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(id, content) of files (id, path, size): one row each, null where a file can't be read.

    Paths are dealt out by a hash of their id to tasks of TASK_BYTES about, and opened there; a batch holds BATCH_BYTES or one file.
    """
    ship(paths.sparkSession)
    sums = paths.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(sums.n, max(paths.sparkSession.sparkContext.defaultParallelism, -(-sums.bytes // TASK_BYTES))))
    schema = _arrow("id long, content binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for b in batches:
            for i, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                content = _content(path, longest) if path else None
                ids.append(i)
                held.append(content)
                size += len(content or b"") + 64
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], schema=schema)
                    ids, held, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.binary())], schema=schema)

    return paths.select("id", "path").repartition(tasks, "id").mapInArrow(read, "id long, content binary")
