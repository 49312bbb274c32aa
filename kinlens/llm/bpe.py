"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens of a batch form one long symbol list. An index maps every adjacent pair that has
a merge rank to all its positions; the lowest active rank is applied at all its positions, left to right,
and the lists of the pairs it touches are updated, until no rank is active. Encoded pre-tokens are kept
per worker in a bounded memo, so a batch only indexes words it has not met.

Defined results: a null or empty text has no ids and decodes to the empty text; a text of any length is
encoded whole; repeated rows give repeated results; ids that the vocabulary lacks are an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches

#: The pre-token pattern of this vocabulary's byte-level splitter.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the memo of a worker; when full, it keeps the short pre-tokens, which most of a text consists of.
MEMO, SHORT = 1_000_000, 8

_SPLIT = regex.compile(PATTERN)
#: The same for texts of Latin letters up to U+024F, with the classes written out: twice as fast, and the rule of such texts.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_LATIN_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
_NOT_LATIN = re.compile("[^\t-\r -ɏ]")
_BEYOND_LATIN = re.compile("[԰-\U0010ffff]")


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def pretokens(text: str) -> list[str]:
    """The text cut into pre-tokens; characters that this Unicode version has not assigned are neither letters nor numbers."""
    if not _NOT_LATIN.search(text):
        return _LATIN_SPLIT.findall(text)
    if _BEYOND_LATIN.search(text):
        new = {ord(c): "͸" for c in set(text) if c >= "԰" and unicodedata.category(c) == "Cn"}
        if new:
            at, out = 0, []
            for w in _SPLIT.findall(text.translate(new)):
                out.append(text[at : at + len(w)])
                at += len(w)
            return out
    return _SPLIT.findall(text)


def trimmed(memo: dict, most: int = MEMO, short: int = SHORT) -> dict:
    """The short pre-tokens of a full memo, or an empty one if those alone fill half of it."""
    kept = {w: x for w, x in memo.items() if isinstance(w, int) or len(w) <= short}
    return kept if len(kept) <= most // 2 else {}


class Vocabulary:
    """Merge ranks, byte symbols and token bytes of a byte-level BPE tokenizer file (its JSON text)."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        letters = byte_letters()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.specials.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        self.width = size
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[a] * size + ids[b], (rank, ids[a + b]))
        self.split_specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.memo: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each pre-token, by one pair occurrence index over all of them."""
        raw = [w.encode() for w in words]
        bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
        codes = np.frombuffer(b"\0".join([*raw, b""]), np.uint8).astype(np.int64)
        start = self.byte_ids[codes]
        start[bounds[1:] - 1] = -1  # a wall between words
        n, size, merges = len(start), self.width, self.merges
        index = self._first_index(start)
        active = [(merges[pair][0], pair) for pair in index]
        heapq.heapify(active)
        symbols = start.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while active:
            _, pair = heapq.heappop(active)
            a, b = divmod(pair, size)
            made = merges[pair][1]
            found = index.pop(pair)
            found.sort()
            for i in found:
                j = after[i]
                if symbols[i] != a or symbols[j] != b:
                    continue  # a merge to the left took one of the two
                k = after[j]  # there is a wall at least
                symbols[i], symbols[j] = made, -2
                after[i], before[k] = k, i
                if symbols[k] >= 0 and (new := made * size + symbols[k]) in merges:
                    if new in index:
                        index[new].append(i)
                    else:
                        index[new] = [i]
                        heapq.heappush(active, (merges[new][0], new))
                h = before[i]
                if h >= 0 and symbols[h] >= 0 and (new := symbols[h] * size + made) in merges:
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        heapq.heappush(active, (merges[new][0], new))
        flat = np.array(symbols, np.int64)
        alive = flat >= 0
        ends = np.concatenate([[0], np.cumsum(alive)])[bounds]
        ids = flat[alive].astype("<u4").tobytes()
        return [ids[4 * s : 4 * e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _first_index(self, symbols: np.ndarray) -> dict[int, list[int]]:
        """Positions of every adjacent pair of bytes that has a rank."""
        at = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
        pairs = symbols[at] * self.width + symbols[at + 1]
        order = np.argsort(pairs, kind="stable")
        at, pairs = at[order], pairs[order]
        firsts = np.flatnonzero(np.diff(pairs, prepend=-1)).tolist()
        return {pair: at[s:e].tolist() for s, e in zip(firsts, [*firsts[1:], len(at)]) if (pair := int(pairs[s])) in self.merges}

    def segments(self, text: str) -> list[str | int]:
        """Pre-tokens and, for the vocabulary's special strings, their ids."""
        if self.split_specials is None or not any(s in text for s in self.specials):
            return pretokens(text)
        out: list[str | int] = []
        for part in self.split_specials.split(text):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                out.extend(pretokens(part))
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.segments(t) if t else [] for t in texts]
        fresh = set().union(*cut) - self.memo.keys()
        if len(self.memo) + len(fresh) > MEMO:
            self.memo = trimmed(self.memo)
            fresh = set().union(*cut) - self.memo.keys()
        words = [w for w in fresh if isinstance(w, str)]
        self.memo.update(zip(words, self.encode_words(words)))
        self.memo.update((i, np.array([i], "<u4").tobytes()) for i in fresh if not isinstance(i, str))
        return [b"".join(map(self.memo.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_known: dict[str, Vocabulary] = {}


def vocabulary(source: str) -> Vocabulary:
    """The vocabulary of a tokenizer file's text, made once per worker."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _known:
        _known[key] = Vocabulary(source)
    return _known[key]


def in_pieces(texts: list, chars: int = 4_000_000) -> Iterator[slice]:
    """Slices of at most about ``chars`` characters, so that a batch of long texts is not held encoded at once."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def tokenizer_source(path: str | None = None) -> str:
    """Text of the tokenizer file, read on the driver and sent to the workers (a vocabulary file is of fixed size)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_and_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per document: its key, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` text."""
    spark: SparkSession = docs.sparkSession
    source = spark.sparkContext.broadcast(tokenizer_source(tokenizer))

    def run(batches):
        v = vocabulary(source.value)
        for b in batches:
            for s in in_pieces(b["text"]):
                ids = v.encode(b["text"][s])
                yield {key: b[key][s], "ids": ids, "decoded": [v.decode(x) for x in ids]}

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, docs[text].alias("text")), run, f"{key} {kind}, ids binary, decoded string")
