"""Multi-party perspective rotation of conversations, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, the
others as named users and system turns as they are; the mask names the character spans (start, end exclusive)
that the assistant is to learn. Conversations are rendered in parts of ``part_turns`` turn numbers, and a part of more turns
than that (turn numbers can be null or repeated) in sections of so many; a section of more than
``section_chars`` code points in pieces, cut where the running length passes a multiple of that. So a conversation of any length never meets in one task. A
piece is a row, and holds ``section_chars`` and its last text at most. Only parts beyond one section or piece are numbered, and sorted for that.

Defined results: a null text is empty; a null role is the participant "unknown"; a null turn orders first, in
part 0; rows with a null conversation id are each a conversation of their own; repeated rows are rendered as often as they occur; ties of a turn order by
role, then by the text's MD5; a conversation of system turns alone has no participant and so no row; an empty table gives none. Control
marks within a text lose their bar, and a shown role has an underscore for each of ``<|>`` and of control characters, so that neither can
forge a turn; ``perspective`` is the role as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from ..tables import written

PART_TURNS = 512
SECTION_CHARS = 16 << 20
SYSTEM = "system"


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, section_chars: int = SECTION_CHARS) -> DataFrame:
    """Rows (conv_id, perspective, part, section, piece, n_turns, text, mask): ``mask`` is an array of (start, end)."""
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select(
        F.struct("conv_id", alone.alias("alone")).alias("which"),
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long").alias("part"),
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|", "< ").alias("text"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"),
        F.monotonically_increasing_id().alias("row"),  # so that equal rows can lie in several range partitions
    )
    rows = written(rows, "turns")
    key, order = ["which", "part"], ["turn", "role", "tie", "row"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.char_length("text").cast("long")).alias("chars"))
    large = written(sizes.where((F.col("n") > part_turns) | (F.col("chars") > section_chars)).select(*key), "large-parts")
    zero = F.lit(0).cast("long")
    if large.isEmpty():
        placed = rows.withColumns({"section": zero, "piece": zero})
    else:  # a part can hold a third of all rows; the joins deal it out in pieces
        cut = numbered(rows.hint("merge").join(large, key, "left_semi"), [F.col(c) for c in (*key, *order)], 0, "at")
        firsts = cut.groupBy(*key).agg(F.min("at").alias("first"))
        cut = cut.hint("merge").join(firsts, key).withColumn("section", F.expr(f"(at - first) div {int(part_turns)}"))
        before = Window.partitionBy(*key, "section").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # over part_turns rows at most
        cut = cut.withColumn("chars", F.coalesce(F.sum(F.char_length("text").cast("long")).over(before), zero)).withColumn("piece", F.expr(f"chars div {int(section_chars)}"))
        rest = rows.hint("merge").join(large, key, "left_anti").withColumns({"section": zero, "piece": zero})
        placed = rest.unionByName(cut.select(*rest.columns))
    parts = placed.groupBy(*key, "section", "piece").agg(F.sort_array(F.collect_list(F.struct(*order, "text"))).alias("turns"))
    speakers = rows.where(F.col("role") != SYSTEM).select("which", F.col("role").alias("perspective")).distinct()
    views = parts.join(speakers, "which")
    shown = lambda role: F.regexp_replace(role, r"[<|>\x00-\x1f\x7f]", "_")
    mine = lambda t: t["role"] == F.col("perspective")
    head = lambda t: F.when(mine(t), F.lit("<|assistant|>\n")).when(t["role"] == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), shown(t["role"]), F.lit("|>\n")))
    made = views.withColumn("said", F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit("<|end|>\n")).alias("body"), mine(t).alias("mine"))))
    size = lambda s: F.char_length(s["head"]) + F.char_length(s["body"])
    step = lambda acc, s: F.struct((acc["at"] + size(s)).alias("at"), F.when(s["mine"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.char_length(s["head"])).alias("start"), (acc["at"] + size(s)).alias("end"))))).otherwise(acc["spans"]).alias("spans"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return made.select(
        F.col("which.conv_id").alias("conv_id"),
        "perspective",
        "part",
        "section",
        "piece",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("said", lambda s: F.concat(s["head"], s["body"])), "").alias("text"),
        F.aggregate("said", zero, step, lambda acc: acc["spans"]).alias("mask"),
    )


def mask_text(mask):
    """A mask as ``start:end`` joined by commas."""
    return F.array_join(F.transform(mask, lambda m: F.concat_ws(":", m["start"], m["end"])), ",")


#: DuckDB SQL of op9's rows.
SQL = r"""
WITH t AS (SELECT conv_id, coalesce(floor(turn / 512), 0)::BIGINT AS part, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT conv_id, part, role, replace(text, '<|', '< ') AS text, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS n FROM t),
r AS (SELECT *, n // 512 AS section, (coalesce(sum(length(text)) OVER (PARTITION BY conv_id, part, n // 512 ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 16777216)::BIGINT AS piece FROM o),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
v AS (SELECT r.conv_id, p.perspective, r.part, r.section, r.piece, r.n, r.role = p.perspective AS mine,
  CASE WHEN r.role = p.perspective THEN '<|assistant|>' WHEN r.role = 'system' THEN '<|system|>' ELSE '<|user name=' || regexp_replace(r.role, '[<|>\x00-\x1f\x7f]', '_', 'g') || '|>' END || chr(10) AS head,
  r.text || '<|end|>' || chr(10) AS body FROM r JOIN p ON r.conv_id = p.conv_id),
s AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part, section, piece ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM v)
SELECT conv_id, perspective, part, section, piece, count(*)::BIGINT AS n_turns, string_agg(head || body, '' ORDER BY n) AS text,
  coalesce(string_agg((pos + length(head))::BIGINT || ':' || (pos + length(head) + length(body))::BIGINT, ',' ORDER BY pos) FILTER (WHERE mine), '') AS mask
FROM s GROUP BY conv_id, perspective, part, section, piece
"""
