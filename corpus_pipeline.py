"""A corpus pipeline: reject low quality, drop repeated lines, keep one of near copies, redact secrets, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of documents.

Defined results: null and empty texts get the classifier's prior like any text; null ids pass every stage but are linked with
nothing; of the rows of one id, near duplicates remove those whose text is a copy of another document's, no others, and of rows alike in id and
text one stays; columns beyond those of documents are left behind; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlens.llm import lines, neardup, packing, quality, secrets
from kinlens.llm.common import discard, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents under this score go.
LEAST_QUALITY = 0.7


def _document(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, with ``text`` from another column and its length brought up to date."""
    new = F.col(text)
    return df.select("doc_id", new.alias("text"), "lang", "source", F.coalesce(F.char_length(new), F.lit(0)).cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.scored(docs, model).where(F.col("quality_score") >= LEAST_QUALITY).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _document(lines.dedup(docs.select(*COLUMNS)), "kept_text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    row = ["doc_id", "version"]
    found = neardup.near_duplicates(docs).where("doc_id IS NOT NULL").groupBy(*row).agg(F.min("kept").alias("kept"), F.count("*").alias("copies"))
    found = written(found.where("NOT kept OR copies > 1"), "found")
    docs = docs.withColumn("version", neardup.text_version(F.col("text"))).join(found.where("NOT kept").select(*row), row, "left_anti")
    if not found.where("kept").isEmpty():  # rows that are alike: one of each, summed up where they lie before they are shuffled
        alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("alone")
        docs = docs.groupBy(*row, alone).agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("doc")).select("doc_id", "doc.*")
    return docs.select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _document(secrets.redact(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.certified_packing(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL has no tokenizer and no trained classifier; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the places of the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # of tables, those that the stage before wrote
    return STAGES[-1][1](spark, docs, sf_dir)
