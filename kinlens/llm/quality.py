"""Quality classifier: supervised subword embeddings.

Words ``[^\\x20\\x09-\\x0D]+`` and character n-grams of the whole text (code points, blanks included) are hashed to rows of a table of
learned vectors; a document is the average of its rows, and a softmax layer gives the probability of label 1. Trained
by stochastic gradient descent in numpy on labelled documents in hash order of their ids: at most ``sample`` of them, and as many as
have ``sample_bytes`` of features together. Since the output layer is linear, scoring uses each row's vector times the output
layer: one number a row, the same score.

Defined results: a null or empty text has no features and gets the learned prior; without labelled rows (or of one
label only) every score is that label's share, 0.5 without any; a document with both labels counts as both;
null labels and labels of unknown documents don't count; of several texts of an id the smallest is learned; repeated rows get
the same score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import in_pieces
from .common import BLANKS, discard, map_batches, mix64, written

#: The most labelled documents that training reads, and bytes of their features (table rows and counts): bounds on the model's training, not
#: on what is scored.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
BUCKETS = 1 << 17
WIDTH = 12
EPOCHS = 6
RATE = 0.4
GRAMS = (3, 4)
#: Characters of a text taken at a time; n-grams and words go on across blocks, so features don't depend on it.
BLOCK = 1 << 18


class Embeddings(NamedTuple):
    """What training learns: the table of vectors, the output layer (label, vector) and its bias."""

    table: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Softmax over the output layer of the rows' average."""
        z = self.bias.astype(float)
        if len(rows):
            z = z + self.out.astype(float) @ self.table[rows].mean(0, dtype=float)
        p = np.exp(z - z.max())
        return p / p.sum()

    def collapsed(self) -> Model:
        return Model(self.table.astype(float) @ (self.out[1].astype(float) - self.out[0]), float(self.bias[1]) - float(self.bias[0]))


class Model(NamedTuple):
    """Output-layer logit (label 1 minus label 0) of every table row, and of the bias."""

    logits: np.ndarray
    bias: float


def _scaled(x: np.ndarray) -> np.ndarray:
    return mix64(x * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def feature_blocks(text: str | None) -> Iterator[np.ndarray]:
    """Table rows of a text's words and n-grams, a block at a time."""
    text = text or ""
    top = np.uint64(BUCKETS - 1)
    blank = np.array([ord(c) for c in BLANKS], np.uint32)
    open_sum, open_length = np.uint64(0), 0  # of the word that goes on from the block before
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK + max(GRAMS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = min(BLOCK, len(text) - at)
        for n in GRAMS:
            count = min(own, len(codes) - n + 1)
            if count > 0:
                h = codes[:count].copy()
                for i in range(1, n):
                    h = h * np.uint32(0x01000193) + codes[i : i + count]
                h = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                yield ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32)
        block = codes[:own]
        inside = ~np.isin(block, blank) if block.max() > 127 else ~_ASCII_BLANK[block]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        whole = at + own == len(text)
        found = []
        if open_length and not inside[0]:  # it ended with the block before
            found.append(np.array([open_sum]) + np.uint64(open_length))
            open_sum, open_length = np.uint64(0), 0
        if len(starts):
            lengths = ends - starts
            first = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum()), dtype=np.uint64) - np.repeat(first, lengths).astype(np.uint64)
            if open_length:
                place[: lengths[0]] += np.uint64(open_length)
            weights = _PLACES[place] if int(place.max()) < len(_PLACES) else _scaled(place + np.uint64(1))
            sums = np.add.reduceat((block[inside].astype(np.uint64) + np.uint64(1)) * weights, first)
            sums[:1] += open_sum
            lengths[0] += open_length
            goes_on = inside[-1] and not whole
            open_sum, open_length = (sums[-1], int(lengths[-1])) if goes_on else (np.uint64(0), 0)
            found.append((sums + lengths.astype(np.uint64))[: len(sums) - goes_on])
        for x in found:
            yield (mix64(x) & top).astype(np.int32)


_PLACES = _scaled(np.arange(1, 4097, dtype=np.uint64))
_ASCII_BLANK = np.zeros(128, bool)
_ASCII_BLANK[[ord(c) for c in BLANKS]] = True


def features(text: str | None) -> list[np.ndarray]:
    """All table rows of a text, as often as its words and n-grams occur."""
    return list(feature_blocks(text))


def score(model: Model, text: str | None) -> float:
    n, total = 0, 0.0
    for rows in feature_blocks(text):
        n += len(rows)
        total += float(model.logits[rows].sum())
    return float(1 / (1 + np.exp(-np.clip((total / n if n else 0.0) + model.bias, -60, 60))))


def _counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text, with their exact counts."""
    counts = np.zeros(BUCKETS, np.int64)
    for rows in feature_blocks(text):
        counts += np.bincount(rows, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def labelled_features(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, label, rows, counts) of the sampled documents, one row each: the distinct table rows of each, with their counts, in 16 bits
    where all of a document's fit and else in 32."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("label")).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "label").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    # an id can be on a third of all rows; the partial minimum leaves one a task
    found = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            for s in in_pieces(b["text"]):
                each = [_counted(t) for t in b["text"][s]]
                yield {"doc_id": b["doc_id"][s], "label": b["label"][s], "rows": [u.astype("<i4").tobytes() for u, _ in each], "counts": [c.astype("<u2" if c.max(initial=0) < 1 << 16 else "<u4").tobytes() for _, c in each]}

    return map_batches(found, run, "doc_id long, label int, rows binary, counts binary")


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, rows, counts) of the labelled documents that training reads, ordered by id, within both bounds."""
    known = written(labelled_features(docs, labels, sample), "features")
    sizes = known.select("doc_id", "label", (F.octet_length("rows") + F.octet_length("counts")).alias("size")).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "label").collect()
    within = {(r["doc_id"], r["label"]) for r, end in zip(sizes, np.cumsum([r["size"] for r in sizes]).tolist()) if end <= sample_bytes}
    if len(within) < len(sizes):
        ids = known.sparkSession.createDataFrame(sorted(within), known.select("doc_id", "label").schema)
        known = known.join(F.broadcast(ids), ["doc_id", "label"], "left_semi").select(known.columns)  # at most ``sample`` rows
    out = []
    for r in known.toLocalIterator():
        rows = np.frombuffer(r["rows"], "<i4")  # views of what came, no copies
        out.append((r["doc_id"], r["label"], rows, np.frombuffer(r["counts"], "<u2" if 2 * len(r["counts"]) == len(r["rows"]) else "<u4")))
    discard(known)
    return [x[1:] for x in sorted(out, key=lambda x: x[:2])]


def trained(bags: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 0) -> Embeddings:
    """Stochastic gradient descent on the driver over (label, rows, counts); the result is of fixed size."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            label, at, counts = bags[k]
            weight = counts.astype(np.float32)
            weight /= max(weight.sum(), 1)
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            hidden = weight @ table[at]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1  # the gradient of the loss by the two logits
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= rate * p
            # a row's step is relative to its share of the text, as if each of its occurrences had been stepped
            table[at] -= (rate * np.minimum(weight * 64, 1))[:, None] * back
    return Embeddings(table, out, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, seed: int = 0) -> Model:
    bags = sampled(docs, labels, sample, sample_bytes)
    y = {label for label, _, _ in bags}
    if len(y) < 2:
        share = float(np.clip(y.pop(), 1e-6, 1 - 1e-6)) if y else 0.5
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    return trained(bags, seed).collapsed()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``quality_score`` (in place of a column of that name)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b | {"quality_score": [score(held.value, t) for t in b["text"]]}

    fields = [f for f in docs.schema.fields if f.name.lower() != "quality_score"]
    docs = docs.select(*[f"`{f.name}`" for f in fields])
    return map_batches(docs, run, T.StructType([*fields, T.StructField("quality_score", T.DoubleType())]))
