"""Fill-in-middle: texts cut at two places into prefix, middle and suffix, which are put in another order between marks.

The units of a text are the isolated matches of the tokenizers library's Split pre-tokenizer, which needs no training and gives each match's
code-point offsets. The array of offsets has two levels: matches of STEP units each, and, of those matches in which an offset is wanted,
single units. The lengths of the arrays give n, and the unit of a rank has its offset at that rank, so a text is never spread out into a
Python object a unit.

A document's form and its two cuts come from the SHA-256 of ``seed:doc_id``, so they are the same on every run and every cluster. Forms: ``psm`` (prefix,
suffix, middle), ``spm`` (suffix first), and ``plain`` (the text as it is).

Defined results: null and empty texts are plain, with the empty output; a text that holds one of the marks is plain, since it could not be
taken apart again; a null id hashes as the empty string; repeated rows are rendered as often as they occur, alike; texts of any length are cut into
chunks for the pre-tokenizer, between units; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .bpe import in_pieces
from .common import map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of a hundred that are rearranged, and how many of a hundred of those have their suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = 1
#: Units of a match of the first level.
STEP = 64
#: Code points that the pre-tokenizer gets at once, about.
CHUNK = 1 << 18
#: What a text is counted and cut in: a pattern whose matches cover any text, and one of the places where a text can be cut without cutting
#: a match (None: anywhere).
UNITS = {
    "char": (r"[\s\S]", None),
    "word": (r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+", re.compile(r"(?<=[^ \t\n\x0b\f\r])(?=[ \t\n\x0b\f\r])")),
    "line": (r"[^\n]*\n|[^\n]+", re.compile(r"(?<=\n)")),
}


class Offsets:
    """The units of texts, by rank."""

    def __init__(self, unit: str = "char", step: int = STEP, chunk: int = CHUNK) -> None:
        pattern, self.cut = UNITS[unit]
        self.step, self.chunk = step, chunk
        self.single = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.several = pre_tokenizers.Split(Regex(f"(?:{pattern}){{1,{step}}}"), "isolated")

    def _chunks(self, text: str):
        at = 0
        while at < len(text):
            end = at + self.chunk
            if self.cut is not None and end < len(text):
                place = self.cut.search(text, end)
                end = place.start() if place else len(text)
            yield at, text[at:end]
            at = end

    def read(self, text: str) -> int:
        """Take in a text; the number of its units."""
        self.text, self.firsts, self.spans, n = text, [], [], 0
        for at, chunk in self._chunks(text):
            spans = [(at + s, at + e) for _, (s, e) in self.several.pre_tokenize_str(chunk)]
            self.firsts.append(n)
            self.spans.append(spans)
            n += self.step * (len(spans) - 1) + len(self._units(spans[-1]))
        self.n = n
        return n

    def _units(self, span: tuple[int, int]) -> list[int]:
        """Offsets of the single units of a match of the first level."""
        return [span[0] + s for _, (s, _) in self.single.pre_tokenize_str(self.text[span[0] : span[1]])]

    def at(self, rank: int) -> int:
        """Where the unit of a rank starts; the text's end for the rank after the last."""
        if rank >= self.n:
            return len(self.text)
        k = bisect_right(self.firsts, rank) - 1
        block, inside = divmod(rank - self.firsts[k], self.step)
        return self._units(self.spans[k][block])[inside]


def _arranged(text: str, h: list[int], offsets: Offsets, rate: int, suffix_first: int) -> tuple:
    """(n, form, code points of the prefix, of the middle, output)"""
    n = offsets.read(text)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = offsets.at(first), offsets.at(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = "char", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output), one for each row of ``docs``: ``n`` counts units, the others code points."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.substring(digest, 1, 32).alias("digest"))
    names = ("n", "form", "prefix_chars", "middle_chars", "output")

    def run(batches):
        offsets = Offsets(unit)
        for b in batches:
            for s in in_pieces(b["text"]):
                made = [_arranged(t, [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)], offsets, rate, suffix_first) for t, d in zip(b["text"][s], b["digest"][s])]
                yield {"doc_id": b["doc_id"][s], **{name: [m[k] for m in made] for k, name in enumerate(names)}}

    return map_batches(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: a mark can't lie across a cut, so each is found where it was put."""
    between = lambda start, end: output.substr(start, end - start)
    m, s, p = (F.instr(output, mark) for mark in (MIDDLE, SUFFIX, PREFIX))
    middle = output.substr(m + 3, F.char_length(output))
    psm = F.concat(between(F.lit(4), s), middle, between(s + 3, m))
    spm = F.concat(between(p + 3, m), middle, between(F.lit(4), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


#: DuckDB SQL of the query's rows.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
c AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1, n) AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
