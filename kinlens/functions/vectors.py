"""Vector expressions over ``array<float>`` or ``array<double>`` columns, computed in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A fixed value: norms up to this count as zero.
ZERO_NORM = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _products(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """The dot product; 0 where the lengths differ."""
    return F.when(F.size(a) == F.size(b), _products(a, b)).otherwise(0.0)


def norm(v: Column) -> Column:
    return F.sqrt(_products(v, v))


def l2_normalized(v: Column) -> Column:
    """``v`` at length 1; as it is where its norm is zero."""
    n = norm(v)
    return F.when(n > ZERO_NORM, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where the lengths differ, a vector is empty or a norm is zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > ZERO_NORM), _products(a, b) / n).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """The vector of a blob; empty where its size is no positive multiple of four."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4") if len(b) >= 4 and len(b) % 4 == 0 else np.empty(0, np.float32))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, order: str) -> DataFrame:
    """(keys, mean, n): element-wise mean by group, over vectors as long as the group's first by ``order``; others are skipped.

    Sums by position are partial aggregates, so a group of any size is summed before it is shuffled.
    """
    rows = df.where(F.size(vector) > 0)
    lengths = rows.groupBy(*keys).agg(F.min_by(F.size(vector), F.col(order)).alias("_len"))
    same = rows.join(lengths, keys).where(F.size(vector) == F.col("_len"))
    parts = same.select(*keys, F.posexplode(doubles(F.col(vector))).alias("_at", "_x")).groupBy(*keys, "_at").agg(F.avg("_x").alias("_x"), F.count("*").alias("n"))
    return parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias("mean"), F.max("n").alias("n"))


def centroids(df: DataFrame, keys: list[str], vector: str = "vec", order: str = "id") -> DataFrame:
    """(keys, centroid, n): the mean of each group at length 1."""
    return mean_vectors(df, keys, vector, order).select(*keys, l2_normalized(F.col("mean")).alias("centroid"), "n")
