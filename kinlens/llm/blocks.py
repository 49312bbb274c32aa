"""A stated query set against all rows, in blocks: each block of rows builds an index once, and the queries stream past it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, small_batches

#: Rows and bytes of a block at most (about: blocks are dealt by a hash of the id), and the least number of blocks, for small inputs to use more than
#: one core.
BLOCK_ROWS, BLOCK_BYTES = 65_536, 64 << 20
LEAST_BLOCKS = 8


def search_blocks(rows: DataFrame, queries: DataFrame, build: Callable[[pa.RecordBatch], object], ask: Callable[[object, pa.RecordBatch], Iterator[dict[str, list]]], schema: str, weight: Column, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` and ``queries`` have the same columns, the first of them the id.

    Rows are dealt into blocks by a hash of their id, into as many as ``weight``, a row's bytes, asks for; queries go to every block, so
    their copies grow as queries times blocks, as comparisons do. A task sorts a block's rows
    before its queries, gives the rows to ``build`` and each batch of queries to ``ask``. What a task holds is one
    block, its index and a batch of queries, however many queries there are.
    """
    small_batches(rows.sparkSession)
    ship(rows.sparkSession)
    names = rows.columns
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("bytes")).first()
    blocks = max(LEAST_BLOCKS, -(-size.n // block_rows), -(-size.bytes // block_bytes))
    held = rows.select(F.pmod(F.xxhash64(names[0]), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), *names)
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), *names)
    dealt = held.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "side", names[0])
    struct = T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, index = None, [], None
        for b in batches:
            at = 0
            which = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            while at < len(which):
                end = at + 1
                while end < len(which) and which[end] == which[at]:
                    end += 1
                piece = b.slice(at, end - at).select(names)
                if which[at][0] != block:
                    block, parts, index = which[at][0], [], None
                if which[at][1] == 0:
                    parts.append(piece)
                elif parts or index is not None:
                    if index is None:
                        index = build(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
                        parts = []
                    for out in ask(index, piece):
                        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
                at = end

    return dealt.mapInArrow(run, struct)
