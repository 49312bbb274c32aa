"""Line dedup over batches with levelled sorted runs of line hashes, in DataFrame operations only.

A run is a table of (key, n_docs, keeper), bucketed and sorted by the line's hash, so that merge joins read it as it lies. Batches come
in descending order of document id, cut at quantiles. The keys of a new batch are merge-anti-joined against the runs, one after the other:
those that no run holds get their keeper, the largest document of the batch; the others only add their document
counts. Both go into one new run of level 0. When a level holds ``fanout`` runs they are compacted into one
run of the next level, so a batch meets a logarithmic number of runs.

Defined results: a null or empty text is one empty line; a null document id orders below all others and its
lines count as one document's; rows that repeat a document id are one document for counting and are each cleaned;
line keys under ``least_chars`` code points are never dropped; an empty table gives no rows; extra columns
of the input, whatever their names, pass through ``dedup``, but for those with its own names in any case of letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import sorted_scans, written_sorted
from .common import BLANKS, discard, lower_ascii, written

LEAST_CHARS = 20
LEAST_DOCS = 3
BATCHES = 5
FANOUT = 3
#: Stands in for a null document id, below every other.
NO_ID = -(1 << 63)


def split_lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line):
    """The line without surrounding blanks and with A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def line_hash(key):
    """128 bits of the key: what is stored and joined."""
    return F.unhex(F.md5(key.cast("binary")))


class SortedRuns:
    """Levelled sorted runs of line hashes: ``add`` a batch, then read ``totals``."""

    def __init__(self, partitions: int, fanout: int = FANOUT) -> None:
        self.partitions, self.fanout = partitions, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def _run(self, rows: DataFrame) -> DataFrame:
        with sorted_scans(rows.sparkSession):
            return written_sorted(rows, "run", "key", self.partitions)

    def held(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: (key, n_docs, keeper), one row a key; its documents order below those of all batches before."""
        if runs := self.held():
            with sorted_scans(batch.sparkSession):
                new = batch.select("key", "keeper")
                for run in runs:
                    new = new.hint("merge").join(run.select("key"), "key", "left_anti")
                batch = batch.drop("keeper").hint("merge").join(new, "key", "left")
                self.levels[0].append(self._run(batch))
        else:
            self.levels[0].append(self._run(batch))
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._run(summed(level)))
            discard(*level)
            level.clear()

    def totals(self) -> DataFrame | None:
        runs = self.held()
        return summed(runs) if runs else None


def summed(runs: list[DataFrame]) -> DataFrame:
    """(key, n_docs, keeper) over all runs.

    They are read as plain files: Spark 4.1 plans a union of equally bucketed tables without an exchange, but its columnar scans put
    the buckets one after the other, so that a key's rows would not meet.
    """
    rows = None
    for r in runs:
        plain = r.sparkSession.read.schema(r.schema).parquet(r._kinlens_path)
        rows = plain if rows is None else rows.unionByName(plain)
    return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(lines, repeated): lines as (id, version, at, key) for long enough keys, and (key, keeper) of the repeated ones."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("version"), F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
    keyed = row.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= least_chars)
    lines = written(keyed.select("id", "version", "at", line_hash(F.col("line")).alias("key")), "lines")
    # a batch holds about as many lines as another, wherever their ids lie
    cuts = lines.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)] or [0.5], 1000)).first()[0] or []
    tops = [None, *sorted(set(cuts if batches > 1 else []), reverse=True), None]
    runs = SortedRuns(parts)
    for top, low in zip(tops, tops[1:]):
        batch = lines if top is None else lines.where(F.col("id") <= top)
        batch = batch if low is None else batch.where(F.col("id") > low)
        # the partial sum holds a document once: (key, id) first, then ids are counted
        runs.add(batch.select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")))
    # written, so that the join with the lines has a plain exchange on either side, whose skewed partitions can be split
    repeated = written(runs.totals().where(F.col("n_docs") >= least_docs).select("key", "keeper"), "repeated")
    discard(*runs.held())
    return lines, repeated


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """The input's columns and rows with two more: ``kept_text``, and ``line_counts`` (n_lines, n_dropped)."""
    lines, repeated = repeated_lines(docs, least_chars, least_docs, batches)
    # a repeated key can be on a third of all lines; the join deals such a key out in pieces
    dropped = lines.join(repeated, "key").where(F.col("id") < F.col("keeper")).groupBy("id", "version").agg(F.collect_set("at").alias("drop"))
    dropped = dropped.select(F.struct("id", "version").alias("which"), "drop")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("kept_text", "line_counts")]).alias("doc"))
    whole = whole.withColumn("which", F.struct(F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("doc.text").alias("version")))
    found = whole.join(dropped, "which", "left").withColumn("lines", split_lines(F.col("doc.text")))
    n = F.size("lines")
    # array_except hashes, so long documents with many repeated lines stay linear
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("drop")), lambda i: F.col("lines")[i])
    made = found.select(
        "doc",
        F.when(F.col("drop").isNull(), F.coalesce("doc.text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("_text"),
        F.struct(n.cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped")).alias("_counts"),
    )
    return made.select("doc.*", F.col("_text").alias("kept_text"), F.col("_counts").alias("line_counts"))


#: DuckDB SQL of op6's rows.
SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM t),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE k.doc_id < r.keeper)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE r.key IS NULL OR k.doc_id >= r.keeper), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY k.doc_id
"""
