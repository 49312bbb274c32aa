"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chroma, embeddings, lines, middle, neardup, neighbours, packing, quality, repair, secrets
from .common import table, written


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out)
    found = quality.scored(docs, quality.fit(docs, labels)).withColumnRenamed("quality_score", "score")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-second excerpts of every fiftieth recording, with all their alignments among all recordings of ``embeddings`` as audio."""
    vectors = table(spark, sf_dir, "embeddings")
    recordings = written(chroma.fingerprints(chroma.rendered(vectors)), "prints")
    excerpts = written(chroma.fingerprints(chroma.rendered(vectors.where("vec_id % 50 = 0"), 1.01, 3.01)), "excerpts")
    return chroma.alignments(recordings, excerpts)


def op3_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(neighbours.usable(table(spark, sf_dir, "embeddings")), "vectors")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op4_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed_matrices(table(spark, sf_dir, "documents"))
    return rows.select("sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.certified_packing(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "line_counts.*", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), "base_sha256", spans.alias("spans"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.QUERY_PERCENT).drop("version")


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("mask", chat.mask_text(F.col("mask")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.repaired(repair.damaged(turns), turns)


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def queries() -> dict:
    return {"op1_quality": op1_quality, "op2_chroma": op2_chroma, "op3_collision_counting": op3_collision_counting, "op4_token_matrices": op4_token_matrices, "op5_best_fit": op5_best_fit, "op6_line_dedup": op6_line_dedup, "op7_secrets": op7_secrets, "op8_near_duplicates": op8_near_duplicates, "op9_perspectives": op9_perspectives, "op10_bpe": op10_bpe, "op11_conversation_repair": op11_conversation_repair, "op12_cross_polytope": op12_cross_polytope, "op13_fill_in_middle": op13_fill_in_middle}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": lines.SQL, "op8_near_duplicates": neardup.SQL, "op9_perspectives": chat.SQL, "op12_cross_polytope": embeddings.SQL, "op13_fill_in_middle": middle.SQL}
