"""Chroma audio fingerprints of media columns, and their alignment.

Audio is cut into overlapping frames; each frame's power spectrum is folded to twelve pitch classes and normalised. Sixteen
rectangle filters over the running (time, class) image, evaluated with an integral image, each give two bits: one packed
32-bit integer a frame. Recordings can align at every offset with enough votes in a histogram over equal high halves of the
integers; the bit error over the overlap decides, and the best offset of a recording is its alignment (one for each recording,
however often it holds the query). Runs of equal high halves vote as ranges: four steps of the histogram's second difference each.

False matches are held down by evidence: for each query the best bit errors of all recordings that have an offset with enough
votes, but for those under ``most_error``, give a mean and a deviation of unrelated recordings; if theirs is a normal distribution,
fewer than ``false_matches`` of n of them are expected ``sqrt(2 ln(n / false_matches))`` deviations under the mean, and an alignment above that
isn't told from chance and goes. Under LEAST_BACKGROUND such recordings there is no evidence, and ``most_error`` alone decides.

Defined results: null, empty or too short audio has an empty fingerprint and aligns with nothing; silence has a
fingerprint of equal integers and aligns with silence; an odd last byte is no sample; repeated rows are each a
recording; ids that are null are fingerprinted and not aligned; ties go to the smaller id, then the smaller offset.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import search_blocks
from .common import map_batches, written

RATE = 5512
FRAME, HOP = 1024, 256
#: Pitches from A1 to about the ninth overtone of A4.
LOWEST, HIGHEST = 55.0, 2400.0
WIDEST = 16
#: (kind, first class, classes, frames) of the filters, by rule: kinds in turn, heights and widths spread over the image.
FILTERS = [(k % 6, (5 * k) % 12, 2 + (k * 3) % 9, 4 + 4 * (k % 4)) for k in range(16)]
#: Half width of the quantiser's middle cells, in log units, and what is added to levels for quiet areas.
STEP, LEAST_LEVEL = 0.6, 0.02
#: An alignment needs these shares of equal high halves and of overlap of the query's integers, and a bit error at most (a default, for copies
#: that are noisy, resampled or encoded anew, too; among thousands of pairs unrelated recordings come under it now and then).
LEAST_VOTES, LEAST_OVERLAP, MOST_ERROR = 0.05, 0.5, 0.2
#: Chance alignments a query that are put up with, and the unrelated recordings from which their distribution is known.
FALSE_MATCHES, LEAST_BACKGROUND = 0.01, 30
#: Bytes of fingerprints of a block, and pairs of runs or offsets that are held at once.
BLOCK_BYTES, HELD = 16 << 20, 1 << 20


def samples(media: bytes | None, rate: int | None) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] of raw 16-bit little-endian audio or of a WAV file, with the rate."""
    if not media:
        return np.empty(0), rate or RATE
    if media[:4] == b"RIFF":
        with wave.open(io.BytesIO(media)) as w:
            rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
            raw = w.readframes(w.getnframes())
        if width == 1:
            x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
        else:
            x = np.frombuffer(raw[: len(raw) // width * width], {2: "<i2", 4: "<i4"}[width]).astype(float) / 2.0 ** (8 * width - 1)
        x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)
    else:
        x = np.frombuffer(media[: len(media) // 2 * 2], "<i2").astype(float) / 32768
    return x, rate or RATE


def _resampled(x: np.ndarray, rate: int) -> np.ndarray:
    if rate == RATE or not len(x):
        return x
    at = np.arange(int(len(x) * RATE / rate)) * rate / RATE
    wide = max(1, round(rate / RATE))
    if wide > 1:  # a running mean against aliases
        c = np.concatenate([[0], np.cumsum(x)])
        left, right = np.maximum(np.arange(len(x)) - wide // 2, 0), np.minimum(np.arange(len(x)) + (wide + 1) // 2, len(x))
        x = (c[right] - c[left]) / (right - left)
    return np.interp(at, np.arange(len(x)), x)


_fold: np.ndarray | None = None
_window = np.hanning(FRAME)


def pitch_classes(x: np.ndarray) -> np.ndarray:
    """Normalised pitch-class frames (frames, 12)."""
    global _fold
    if _fold is None:
        f = np.fft.rfftfreq(FRAME, 1 / RATE)
        _fold = np.zeros((len(f), 12))
        inside = (f >= LOWEST) & (f <= HIGHEST)
        _fold[np.flatnonzero(inside), np.round(12 * np.log2(f[inside] / 440)).astype(int) % 12] = 1
    if len(x) < FRAME:
        return np.empty((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = []
    for k in range(0, len(frames), 2048):
        power = np.abs(np.fft.rfft(frames[k : k + 2048] * _window, axis=1)) ** 2
        out.append(power @ _fold)
    chroma = np.concatenate(out)
    norm = np.sqrt((chroma**2).sum(1, keepdims=True))
    return np.where(norm > 1e-6, chroma / np.maximum(norm, 1e-12), 0)


def fingerprint(chroma: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each frame from which a widest filter fits."""
    n = len(chroma) - WIDEST + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    image = np.zeros((len(chroma) + 1, 25))  # classes wrap around
    image[1:, 1:] = np.cumsum(np.cumsum(np.concatenate([chroma, chroma], 1), 0), 1)
    t = np.arange(n)

    def area(t0, t1, c0, c1):
        return image[t + t1, c1] - image[t + t0, c1] - image[t + t1, c0] + image[t + t0, c0]

    out = np.zeros(n, np.uint32)
    for k, (kind, c, h, w) in enumerate(FILTERS):
        ht, wt = h // 2, w // 2
        # the part that counts for, by kind: all, lower classes, earlier frames, a checkerboard, middle classes, middle frames
        parts = [[(0, w, 0, h)], [(0, w, 0, ht)], [(0, wt, 0, h)], [(0, wt, 0, ht), (wt, w, ht, h)], [(0, w, h // 3, h - h // 3)], [(w // 4, w - w // 4, 0, h)]][kind]
        a, size = sum(area(t0, t1, c + c0, c + c1) for t0, t1, c0, c1 in parts), sum((t1 - t0) * (c1 - c0) for t0, t1, c0, c1 in parts)
        if kind:
            b, rest = area(0, w, c, c + h) - a, h * w - size
        else:  # against all twelve classes
            b, rest = area(0, w, 0, 12), 12 * w
        value = np.log((LEAST_LEVEL + a / size) / (LEAST_LEVEL + b / rest))
        cell = (value >= -STEP).astype(np.uint32) + (value >= 0) + (value >= STEP)
        out = (out << np.uint32(2)) | (cell ^ (cell >> np.uint32(1))).astype(np.uint32)  # neighbours differ in one bit
    return out


def fingerprints(media: DataFrame, key: str = "rec_id", audio: str = "audio", rate: str = "rate") -> DataFrame:
    """(rec_id, prints): the packed integers of every recording, little-endian in a binary column."""

    def run(batches):
        for b in batches:
            for k in range(0, len(b["audio"]), 64):
                part = slice(k, k + 64)
                prints = [fingerprint(pitch_classes(_resampled(*samples(a, r)))).astype("<u4").tobytes() for a, r in zip(b["audio"][part], b["rate"][part])]
                yield {"rec_id": b["rec_id"][part], "prints": prints}

    rows = media.select(F.col(key).cast("long").alias("rec_id"), F.col(audio).alias("audio"), F.col(rate).alias("rate"))
    return map_batches(rows, run, "rec_id long, prints binary")


def runs(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high half, start, length) of the runs of equal high halves."""
    high = prints >> np.uint32(16)
    starts = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(high) else np.empty(0, np.int64)
    return high[starts], starts, np.diff(np.append(starts, len(high)))


class PrintIndex:
    """Runs of equal high halves, sorted by the half, then the recording."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.ids = batch.column(0).to_pylist()
        self.prints = [np.frombuffer(p, "<u4") for p in batch.column(1).to_pylist()]
        each = [runs(p) for p in self.prints]
        rec = np.repeat(np.arange(len(each), dtype=np.uint64), [len(r[0]) for r in each])
        code = np.concatenate([*(r[0] for r in each), np.empty(0, np.uint32)]).astype(np.uint64) << np.uint64(32) | rec
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.start, self.length = (np.concatenate([*(r[k] for r in each), np.empty(0, np.int64)]).astype(np.int32)[order] for k in (1, 2))
        self.longest = max(map(len, self.prints), default=0)

    def candidates(self, query: np.ndarray, first: int = 0, last: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(recording, offset of the query in it, votes) wherever there are enough votes, in order; whole recordings at a time."""
        last = len(self.ids) if last is None else last
        half, at, size = runs(query)
        key = half.astype(np.uint64) << np.uint64(32)
        low, high = np.searchsorted(self.code, key | np.uint64(first)), np.searchsorted(self.code, key | np.uint64(last))
        each = high - low
        if each.sum() > HELD and last - first > 1:
            middle = (first + last) // 2
            yield from self.candidates(query, first, middle)
            yield from self.candidates(query, middle, last)
            return
        if not each.sum():
            return
        found = np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        own, length = np.repeat(size, each), self.length[found].astype(np.int64)
        span = self.longest + len(query) + 2
        zero = (self.code[found] & np.uint64(0xFFFFFFFF)).astype(np.int64) * (2 * span) + self.start[found] - np.repeat(at, each) - own + 1 + span
        # two runs vote for a trapezium of offsets: its second difference is four steps
        places, back = np.unique(np.concatenate([zero, zero + own, zero + length, zero + own + length]), return_inverse=True)
        ones = np.ones(len(zero))
        slope = np.cumsum(np.bincount(back, np.concatenate([ones, -ones, -ones, ones]))).round().astype(np.int64)
        gaps = np.diff(places, append=places[-1])
        before = np.concatenate([[0], np.cumsum(slope * gaps)[:-1]])  # votes just before each place
        need = max(2, LEAST_VOTES * len(query))
        use = np.flatnonzero((gaps > 0) & (np.maximum(before + slope, before + slope * gaps) >= need))
        ends = np.cumsum(gaps[use])
        for part in np.split(np.arange(len(use)), np.flatnonzero(np.diff(ends // HELD)) + 1) if len(use) else []:
            k, n = use[part], gaps[use[part]]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            votes = np.repeat(before[k] + slope[k], n) + np.repeat(slope[k], n) * step
            code = (np.repeat(places[k], n) + step)[votes >= need]
            yield code // (2 * span), code % (2 * span) - span, votes[votes >= need]

    def errors(self, query: np.ndarray, rec: int, offsets: np.ndarray) -> np.ndarray:
        """Bit errors of the query over its overlap with a recording at each offset; 2 where the overlap is too short."""
        p, n = self.prints[rec], len(query)
        out = np.full(len(offsets), 2.0)
        inside = np.flatnonzero((offsets >= 0) & (offsets + n <= len(p)))
        for part in np.array_split(inside, max(1, len(inside) * n // HELD)) if len(inside) else []:
            windows = np.lib.stride_tricks.sliding_window_view(p, n)[offsets[part]]
            out[part] = np.bitwise_count(windows ^ query).sum(1, dtype=np.int64) / (32 * n)
        for k in np.flatnonzero((offsets < 0) | (offsets + n > len(p))).tolist():
            offset = int(offsets[k])
            s, e = max(0, -offset), min(n, len(p) - offset)
            if e - s >= max(1, LEAST_OVERLAP * n):
                out[k] = np.bitwise_count(query[s:e] ^ p[s + offset : e + offset]).sum(dtype=np.int64) / (32 * (e - s))
        return out

    def align(self, query: np.ndarray, most_error: float) -> tuple[list[tuple[object, int, int, float]], tuple[int, float, float]]:
        """(class, offset of the query in the recording, votes, bit error) of every class of recordings that aligns: of its offsets with enough
        votes, the one of the least bit error, then of most votes, then the smallest. And of the other classes with such an offset the number, sum and sum
        of squares of their least bit errors."""
        best: dict[int, tuple[float, int, int]] = {}
        for rec, offset, votes in self.candidates(query):
            edges = np.flatnonzero(np.diff(rec, prepend=-1)).tolist()
            for s, e in zip(edges, [*edges[1:], len(rec)]):
                error = self.errors(query, int(rec[s]), offset[s:e])
                k = np.lexsort((offset[s:e], -votes[s:e], error))[0]
                r = int(rec[s])
                best[r] = min(best.get(r, (3.0, 0, 0)), (float(error[k]), -int(votes[s + k]), int(offset[s + k])))
        near = [(self.ids[r], offset, -v, error) for r, (error, v, offset) in best.items() if error <= most_error]
        rest = np.array([error for error, _, _ in best.values() if most_error < error <= 1])
        return near, (len(rest), float(rest.sum()), float((rest**2).sum()))


def _ask(most_error: float, index: PrintIndex, batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
    """The alignments of each query in a block, and a row without a twin for the block's background."""
    for q, prints in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        found, (n, total, squares) = index.align(np.frombuffer(prints, "<u4"), most_error)
        rows = [(*x, 0, 0.0, 0.0) for x in found] + ([(None, 0, 0, 0.0, n, total, squares)] if n else [])
        if rows:
            yield {"asked": [q] * len(rows)} | dict(zip(("twin", "offset", "votes", "bit_error", "n", "total", "squares"), map(list, zip(*rows))))


def _classes(rows: DataFrame) -> DataFrame:
    """(twin, prints) of the different fingerprints of ``rows`` that aren't empty."""
    return rows.where(F.octet_length("prints") > 0).groupBy("twin").agg(F.first("prints").alias("prints"))


def alignments(recordings: DataFrame, queries: DataFrame, k: int | None = None, most_error: float = MOST_ERROR, false_matches: float | None = FALSE_MATCHES) -> DataFrame:
    """(query_id, rank, rec_id, offset, votes, bit_error): each query's alignments, or the ``k`` best; both inputs as :func:`fingerprints` gives them.

    Equal fingerprints are one class in the search; the result has a row for every recording of a class. Without ``false_matches`` all
    alignments up to ``most_error`` are returned.
    """
    rows, asked = (x.where("rec_id IS NOT NULL").withColumn("twin", F.unhex(F.sha2("prints", 256))) for x in (recordings, queries))
    schema = "asked binary, twin binary, offset int, votes int, bit_error double, n long, total double, squares double"
    found = written(search_blocks(_classes(rows), _classes(asked), PrintIndex, partial(_ask, most_error), schema, F.octet_length("prints"), block_bytes=BLOCK_BYTES), "found")
    near = found.where("twin IS NOT NULL").drop("n", "total", "squares")
    if false_matches is not None:
        others = found.where("twin IS NULL").groupBy("asked").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares"))).where(F.col("n") >= LEAST_BACKGROUND)
        mean = F.col("total") / F.col("n")
        spread = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
        limits = others.select("asked", (mean - F.sqrt(2 * F.log(F.col("n") / false_matches)) * spread).alias("limit"))
        near = near.hint("merge").join(limits, "asked", "left").where("limit IS NULL OR bit_error <= limit").drop("limit")
    named = near.hint("merge").join(asked.select(F.col("rec_id").alias("query_id"), F.col("twin").alias("asked")), "asked")
    named = named.hint("merge").join(rows.select("rec_id", "twin"), "twin")
    order = Window.partitionBy("query_id").orderBy("bit_error", "rec_id", "offset")
    out = named.withColumn("rank", F.row_number().over(order))
    return (out if k is None else out.where(F.col("rank") <= k)).select("query_id", "rank", "rec_id", "offset", "votes", "bit_error")


def rendered(vectors: DataFrame, first: float = 0.0, last: float = 4.0) -> DataFrame:
    """A media column for tables that have none: every vector played as sixteen quarter-second chords of two tones.

    (rec_id, audio, rate); ``first`` and ``last`` cut an excerpt, in seconds. Vectors that are null or hold null or non-finite
    components have null audio.
    """

    def play(v):
        if not v or any(x is None or not np.isfinite(x) for x in v):
            return None
        c = np.resize(np.array(v, float), 64).reshape(16, 4)
        t = np.arange(int(first * RATE), int(last * RATE)) / RATE
        note = np.minimum((t * 4).astype(int), 15)
        # each component is spread over two octaves; the third balances the two tones
        pitch = 110 * 2 ** (np.floor((c[:, :2] * 64) % 24) / 12)
        level = 0.3 + 0.4 / (1 + np.exp(-8 * c[:, 2]))
        x = level[note] * np.sin(2 * np.pi * pitch[note, 0] * t) + (1 - level[note]) * np.sin(2 * np.pi * 2 * pitch[note, 1] * t)
        return (x * 16000).astype("<i2").tobytes()

    def run(batches):
        for b in batches:
            for k in range(0, len(b["rec_id"]), 64):
                part = slice(k, k + 64)
                yield {"rec_id": b["rec_id"][part], "audio": [play(v) for v in b["vector"][part]], "rate": [RATE] * len(b["rec_id"][part])}

    rows = vectors.select(F.col("vec_id").cast("long").alias("rec_id"), F.col("embedding").alias("vector"))
    return map_batches(rows, run, "rec_id long, audio binary, rate int")
