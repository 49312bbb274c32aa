"""Packing documents into fixed-length sequences: best-fit decreasing, lower bounds and exchange.

``packed_matrices`` packs token ids where they are read and returns id matrices, cumulative segment lengths
and positions; bins are found with a segment tree over residual capacities. ``certified_packing`` plans
places only: each partition's best-fit-decreasing result is held against dual-feasible-function lower
bounds, and partitions with a gap exchange their unfilled sequences' pieces and pack again, until a round saves nothing.

Defined results: null and empty texts are the end id alone (one piece of length 1); a document longer than a
sequence is cut without loss; repeated rows are packed once each; an empty table gives no rows. Sequence ids are unique
numbers without meaning: they come from partition and group numbers, so they change with the layout of the files read.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_letters, in_pieces, pretokens, tokenizer_source, trimmed
from .common import discard, map_batches, written

CAPACITY = 1024
END_ID = 2
#: Entries of a worker's memo of pre-token ids, and the length of those that it keeps when full; workers outlive their stage.
MEMO, SHORT = 200_000, 6
#: Pieces packed together by ``packed_matrices``, and about as many in a partition of ``certified_packing``.
MATRIX_PIECES = 4096
PARTITION_PIECES = 16_384
#: Share of its sequences, the emptiest, that a partition at its bound offers in the first phase, and their least number.
OFFERED, LEAST_OFFERED = 1 / 50, 8


class WordIds(dict):
    """Ids as the tokenizers library gives them, remembered by pre-token: pre-tokens are encoded independently.

    Where the file's ids are in the order of its merges, a new pre-token goes through the same merges as byte ranks in
    tiktoken, which takes a third of the time; else, and for texts with special strings, through tokenizers.
    """

    def __init__(self, source: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = None
        model = json.loads(source)["model"]
        if [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]] == list(range(256, 256 + len(model["merges"]))):
            import tiktoken

            letters = byte_letters()
            ranks = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items()}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __missing__(self, word: str) -> bytes:
        if self.ranked is not None:
            ids = self.ranked.encode_single_piece(word.encode())
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        found = self[word] = array("I", ids).tobytes()
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > MEMO:
            short = trimmed(self, MEMO, SHORT)
            self.clear()
            self.update(short)
        return [b"".join(map(self.__getitem__, pretokens(t))) if t and not any(s in t for s in self.specials) else self.whole(t or "") for t in texts]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_ids: dict[int, WordIds] = {}


def word_ids(source: str) -> WordIds:
    key = hash(source)
    if key not in _ids:
        _ids[key] = WordIds(source)
    return _ids[key]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, but for the first, which takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, first if first and not s else capacity) for s in starts]


def cut_batches(batches, source: str, capacity: int) -> Iterator[dict[str, list]]:
    """Batches of documents as batches of pieces: doc_id, piece, start, length, and ids with the end id."""
    coder, end = word_ids(source), np.array([END_ID], "<u4").tobytes()
    for b in batches:
        for s in in_pieces(b["text"]):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids")}
            for doc, ids in zip(b["doc_id"][s], coder.encode(b["text"][s])):
                ids += end
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    for name, value in zip(out, (doc, k, start, length, ids[4 * start : 4 * (start + length)])):
                        out[name].append(value)
            yield out


def encoded_pieces(docs: DataFrame, tokenizer: str | None, capacity: int) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and the piece's number ``row`` (partition and place in it)."""
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_source(tokenizer))

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for b in cut_batches(batches, source.value, capacity):
            n = len(b["doc_id"])
            yield b | {"ids_crc32": list(map(zlib.crc32, b["ids"])), "row": list(range(at, at + n))}
            at += n

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


class CapacityTree:
    """A segment tree over residual capacities: each leaf holds the open bins of one capacity, each inner node their number."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The open bin of least capacity that is at least ``least``, taken out; (capacity, bin)."""
        k = least + self.leaves
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins."""
    tree = CapacityTree(capacity)
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            room, at = capacity, made
            made += 1
        else:
            room, at = found
        bins[i], offsets[i] = at, capacity - room
        if room > n:
            tree.put(room - n, at)
    return bins, offsets, made


def fractional_bound(counts: np.ndarray, capacity: int) -> float:
    """Bins that any packing needs, before rounding up: the best of several families of dual feasible functions over counts by length."""
    size = np.arange(capacity + 1)
    best = float(counts @ size) / capacity
    number = np.concatenate([[0], np.cumsum(counts)])
    volume = np.concatenate([[0], np.cumsum(counts * size)])
    for k in range(1, capacity // 2 + 1):
        # over capacity - k: a bin each; above half: a bin each, with room left; from k to half: what that room can't hold
        large = number[-1] - number[capacity - k + 1]
        half, top = capacity // 2 + 1, capacity - k + 1
        middle, middle_volume = number[top] - number[half], volume[top] - volume[half]
        small = volume[half] - volume[k]
        best = max(best, float(large + middle) + max(0, int(small - (middle * capacity - middle_volume))) / capacity)
    for p in range(1, 24):
        # u_p: a multiple of capacity / (p + 1) keeps its share, others go down to a multiple of 1 / p
        scaled = size * (p + 1)
        share = np.where(scaled % capacity == 0, scaled // capacity * p, scaled // capacity * (p + 1))
        best = max(best, float(counts @ share) / (p * (p + 1)))
    return best


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    return math.ceil(fractional_bound(counts, capacity) - 1e-9)


def packed_matrices(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, pieces: int = MATRIX_PIECES, pad_id: int = 0) -> DataFrame:
    """Rows of one packed id matrix: sequence_id, n_tokens, doc_ids, pieces, ``cu_seqlens`` (0 first, n_tokens last),
    ``input_ids`` and ``position_ids`` (binary, little-endian unsigned 32-bit, ``capacity`` entries, positions restart
    at every segment; the padding has ``pad_id`` and position 0).

    Every ``pieces`` pieces of a partition are packed as they come: no shuffle, memory bounded by
    ``pieces * capacity`` ids, and a lost task is simply run again.
    """
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_source(tokenizer))

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def packed() -> Iterator[dict[str, list]]:
            nonlocal made, held
            lengths = np.array([h[2] for h in held], np.int64)
            bins, offsets, n = best_fit_decreasing(lengths, capacity)
            order = np.lexsort((offsets, bins))
            firsts = np.searchsorted(bins[order], np.arange(n + 1))
            out: dict[str, list] = {}
            for k in range(n):
                inside = order[firsts[k] : firsts[k + 1]].tolist()
                ids, positions = np.full(capacity, pad_id, "<u4"), np.zeros(capacity, "<u4")
                for i in inside:
                    at, length = offsets[i], lengths[i]
                    ids[at : at + length] = np.frombuffer(held[i][3], "<u4")
                    positions[at : at + length] = np.arange(length)
                ends = [int(offsets[i] + lengths[i]) for i in inside]
                row = {"sequence_id": (part << 40) + made, "n_tokens": ends[-1], "doc_ids": [held[i][0] for i in inside], "pieces": [held[i][1] for i in inside], "cu_seqlens": [0, *ends], "input_ids": ids.tobytes(), "position_ids": positions.tobytes()}
                made += 1
                for name, value in row.items():
                    out.setdefault(name, []).append(value)
                if len(out["sequence_id"]) == 256:
                    yield out
                    out = {}
            held = []
            if out:
                yield out

        for b in cut_batches(batches, source.value, capacity):
            for row in zip(b["doc_id"], b["piece"], b["length"], b["ids"]):
                held.append(row)
                if len(held) == pieces:
                    yield from packed()
        if held:
            yield from packed()

    return map_batches(docs.select("doc_id", "text"), run, "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary")


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the rows of :func:`packed_matrices` as Parquet, one file a partition."""
    packed_matrices(docs, **options).write.parquet(path)


_PIECE = ("doc_id", "piece", "start", "length", "ids_crc32", "row")
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, grp long, bin long, offset long, n_bins long, least_bins long, phase int"


def _pack_partition(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best-fit decreasing of a partition; ``phase`` says when a piece's sequence is offered for exchange: from phase 0, from 1, or never (2)."""
    pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable", ignore_index=True)
    lengths = pdf["length"].to_numpy(np.int64)
    bins, offsets, n = best_fit_decreasing(lengths, CAPACITY)
    fill = np.bincount(bins, lengths, n).astype(np.int64)
    least = fractional_bound(np.bincount(lengths, minlength=CAPACITY + 1), CAPACITY)
    phase = np.full(n, 2, np.int32)
    if n - least > 1e-9:  # else its share of sequences is the least that it can be
        phase[:] = 1
        over = n > math.ceil(least - 1e-9)
        phase[np.argsort(fill, kind="stable")[: n if over else max(LEAST_OFFERED, int(n * OFFERED))]] = 0
        phase[fill == CAPACITY] = 2
    return pdf.assign(bin=bins, offset=offsets, n_bins=n, least_bins=math.ceil(least - 1e-9), phase=phase[bins])


def _packed(pieces: DataFrame, rows: int, salt: int, bins: int | None = None) -> DataFrame:
    """Pieces dealt by their number into partitions of about PARTITION_PIECES, and packed; rows that are alike are dealt apart, too.

    Pieces of ``bins`` sequences go to partitions of LEAST_OFFERED sequences' pieces at least, however small those are."""
    groups = max(1, round(rows / PARTITION_PIECES) if bins is None else min(round(rows / PARTITION_PIECES), bins // LEAST_OFFERED))
    dealt = pieces.select(*_PIECE, F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(groups)).alias("grp"))
    return written(dealt.groupBy("grp").applyInPandas(_pack_partition, _PACKED), f"packed-{salt}").withColumn("round", F.lit(salt))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def certified_packing(docs: DataFrame, tokenizer: str | None = None, rounds: int | None = None) -> DataFrame:
    """Places of all pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and per piece the
    number of sequences ``n_bins`` of the partition that placed it with its lower bound ``least_bins``.

    A partition whose sequences are over its bound offers all that are not full; one that meets it is proven optimal and
    offers its emptiest, for the fraction that its bound was rounded up by. Offered pieces of all partitions are dealt anew among
    fewer partitions and packed again, as long as that saves sequences; then all unfilled sequences are offered, but for those of partitions
    without any slack, again as long as that saves some (or for ``rounds`` rounds, where a caller bounds the time). It ends early at the
    lower bound over all pieces. Only lengths move, never ids.
    """
    pieces = written(encoded_pieces(docs, tokenizer, CAPACITY), "pieces")
    counts = np.zeros(CAPACITY + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # CAPACITY rows at most
        counts[r["length"]] = r["count"]
    least = lower_bound(counts, CAPACITY)
    held = [_packed(pieces, int(counts.sum()), 0)]
    discard(pieces)
    made = held[0].where("offset = 0").count()
    phase, k = 0, 0
    while made > least and (rounds is None or k < rounds):
        k += 1
        gives = F.col("phase") <= phase
        now = _union(held)
        stats = now.agg(F.count_if(gives & (F.col("offset") == 0)).alias("bins"), F.count_if(gives).alias("rows"), F.count_distinct(F.when(gives, F.struct("round", "grp"))).alias("groups")).first()
        saved = 0
        if stats.groups > 1:  # else there is nothing to exchange with
            again = _packed(now.where(gives), stats.rows, k, stats.bins)
            saved = stats.bins - again.where("offset = 0").count()
            if saved > 0:
                held = [*(x.where(~gives) for x in held), again]
                made -= saved
            else:
                discard(again)
        if saved <= 0:
            if phase:
                break
            phase = 1
    identity = F.shiftleft(F.col("round").cast("long"), 48) + F.shiftleft("grp", 20) + F.col("bin")
    return _union(held).withColumn("sequence_id", identity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_bins", "least_bins")


def packing_report(packed: DataFrame) -> DataFrame:
    """One row: sequences made, and the lower bound over all pieces from their counts by length (1024 numbers at most)."""
    counts = packed.groupBy("length").count().collect()
    by = np.zeros(CAPACITY + 1, np.int64)
    for r in counts:
        by[r["length"]] = r["count"]
    return packed.agg(F.count_distinct("sequence_id").alias("sequences")).withColumn("least_sequences", F.lit(lower_bound(by, CAPACITY)))
