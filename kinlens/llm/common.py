"""What the operators of this subpackage share: tables, Arrow batches, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import discard, ship, written

__all__ = ["BLANKS", "discard", "lower_ascii", "map_batches", "mix64", "shingle_hashes", "ship", "small_batches", "table", "word_hashes", "written"]

#: ``[\x20\x09-\x0D]``, the white space of every contract here.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a batch that are Python objects at once.
ROWS = 512
#: Bytes of an Arrow batch, of which a task holds some outside the heap and in its worker; Spark's own default is eight times that.
BATCH_BYTES, SPARK_BATCH_BYTES = "8m", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES from now on, where the session has Spark's default: rows here hold texts, sets and registers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, SPARK_BATCH_BYTES):
        spark.conf.set(name, BATCH_BYTES)


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with plain lists: ``fn`` gets an iterator of {column: values} and yields the same."""
    small_batches(df.sparkSession)
    ship(df.sparkSession)
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(struct)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS))
        rows = ({n: c.to_pylist() for n, c in zip(names, b.columns)} for b in parts)
        for out in fn(rows):
            yield pa.RecordBatch.from_arrays([pa.array(out[n], f.type) for n, f in zip(struct.fieldNames(), sent)], schema=sent)

    if not any("." in n for n in [*names, *struct.fieldNames()]):
        sent = target
        return df.mapInArrow(run, struct)
    # mapInArrow would take a name with a dot for a field of a column: names of our own on the way
    sent = pa.schema([f.with_name(f"c{k}") for k, f in enumerate(target)])
    plain = T.StructType([T.StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(struct.fields)])
    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, plain).toDF(*struct.fieldNames())


def lower_ascii(c):
    """A-Z to a-z and nothing else; ``lower`` is the cheaper form of it for pure ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


_WEIGHTS = np.empty(0, np.uint64)


def _weights(n: int) -> np.ndarray:
    """Odd pseudo-random multipliers for positions in a word."""
    global _WEIGHTS
    if len(_WEIGHTS) < n:
        _WEIGHTS = mix64(np.arange(1, max(n, 4096) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _WEIGHTS


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


#: Bytes of a text that are hashed at once, about: the arrays take some forty times as much.
BLOCK = 1 << 18


def _cut(raw: bytes) -> Iterator[bytes]:
    """``raw`` in blocks that end between words; a longer word is in one block."""
    at = 0
    while at < len(raw):
        end = at + BLOCK
        while end < len(raw) and not _BLANK[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, in order."""
    return np.concatenate([np.empty(0, np.uint64), *map(_block_hashes, _cut(raw))])


def _block_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    inside = ~_BLANK[b]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    kept = b[inside]
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    w = _weights(int(lengths.max()))
    terms = (kept.astype(np.uint64) + np.uint64(1)) * w[place]
    return mix64(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(raw: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of lower-cased text; short texts are one shingle."""
    words = word_hashes(raw.lower())
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    at = _weights(size)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * at[i]
    return np.unique(mix64(total + np.uint64(width)))
