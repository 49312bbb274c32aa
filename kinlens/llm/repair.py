"""Structure repair of conversations by A* on the edit lattice.

A conversation's rows, in order of their turns, become an alternation ``(s?(ua)+)?`` of role initials by keeping, relabelling and
deleting rows and inserting empty turns. A node of the lattice is (rows done, state of the alternation); the search takes nodes in order of
(cost + heuristic, audit), where the audit is the edits' initials so far. The heuristic sums, over the rows left, the deletions that are
mandatory (blank and repeated rows) and the charge of one that no edit of a truncated row goes below; it is consistent, so a node's first visit is
its cheapest with the ASCII-least audit.

A conversation of more than ``section_rows`` rows or ``section_bytes`` is cut into sections of bounded size, which are searched from every state
to every state in tasks of their own: insertions come before a row of their section (those at the end in the last), so that two audits of one
section never begin alike to the end, and the cheapest way through sections and states, with the first audit at ties, is the whole search's. Only these
few numbers a section of a long conversation meet in one place.

Defined results: null roles and texts are one space (which is blank); rows of one turn are taken by role, then text, null turns first; rows of a null
conversation id are one conversation; repeated rows are duplicates of the first; roles count by their first letter (an empty role by none, and is never
kept); very long texts pass through as they are, one section at least for each ``section_bytes``; an empty table gives no rows; other columns are
left behind.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import map_batches, written

SECTION_ROWS, SECTION_BYTES = 512, 16 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after a system turn, after a user's, after an assistant's; where a state's next initial leads.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that relabelling and inserting give in a state, and where it leads.
WANTED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
STATES, ENDS = (0, 1, 2, 3), (0, 3)
FAULTS = ("", "blank", "duplicate", "truncated")
#: What a row that isn't blank holds, and what one that isn't truncated ends in.
VISIBLE, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def search(initials: str, faults: list[str], entry: int, last: bool) -> dict[int, tuple[int, str]]:
    """For every state that the rows can end in from ``entry``: the least cost and its ASCII-least audit. Of the ``last`` section only
    states that a conversation may end in, with insertions after the last row."""
    n = len(initials)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if faults[i] in ("blank", "duplicate") else TRUNCATED if faults[i] else 0)
    heap, done, found = [(rest[0], "", 0, entry)], set(), {}
    goals = len(ENDS if last else STATES)
    while heap and len(found) < goals:
        f, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        cost = f - rest[i]
        if i == n and (q in ENDS or not last):
            found[q] = cost, audit
            if last:  # the first end is the cheapest
                break
        to = WANTED[q][1]
        if i < n or last:
            heapq.heappush(heap, (cost + INSERT + rest[i], audit + "I", i, to))
        if i < n:
            after, fault = rest[i + 1], faults[i]
            heapq.heappush(heap, (cost + DELETE + after, audit + "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                charge = TRUNCATED if fault else 0
                heapq.heappush(heap, (cost + REROLE + charge + after, audit + "R", i + 1, to))
                if (q, initials[i]) in NEXT:
                    heapq.heappush(heap, (cost + KEEP + charge + after, audit + "K", i + 1, NEXT[q, initials[i]]))
    return found


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with every twentieth row dropped, emptied, unpunctuated, repeated or relabelled, by a hash of its place."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.where("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _sectioned(rows: DataFrame, section_rows: int, section_bytes: int) -> tuple[DataFrame, bool]:
    """``rows`` with their section, the number of sections, whether role and text came in an earlier section, and a number in order;
    and whether a conversation has several sections.

    Conversations of one section aren't numbered: their rows are ordered where they meet.
    """
    size = F.octet_length("role") + F.octet_length("text")
    sums = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("most"))
    long = written(sums.where((F.col("n") > section_rows) | ((F.col("bytes") > section_bytes) & (F.col("n") > 1))), "long")
    whole = {"section": F.lit(0).cast("long"), "sections": F.lit(1).cast("long"), "seen": F.lit(False), "at": F.lit(0).cast("long")}
    if long.isEmpty():
        return rows.withColumns(whole), False
    each = F.least(F.lit(section_rows), F.greatest(F.lit(1), F.lit(section_bytes).cast("long") / F.greatest(F.col("most"), F.lit(1)))).cast("long")
    long = long.select(F.col("conv_id").alias("_conv"), each.alias("each"), F.ceil(F.col("n") / each).alias("sections"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    parts = rows.hint("merge").join(long, same).withColumn("tie", F.monotonically_increasing_id())  # so that equal rows can lie in several range partitions
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    parts = numbered(parts, order, 0, "at")
    firsts = parts.groupBy(F.col("conv_id").alias("_of")).agg(F.min("at").alias("first"))
    parts = parts.hint("merge").join(firsts, F.col("conv_id").eqNullSafe(F.col("_of"))).withColumn("section", F.expr("(at - first) div each"))
    parts = written(parts.withColumn("said", F.sha2(F.concat_ws("\n", "role", "text"), 256)).drop("tie", "_conv", "_of", "first", "each"), "sections")
    earliest = parts.groupBy(F.col("conv_id").alias("_of"), F.col("said").alias("_said")).agg(F.min("section").alias("earliest"))
    met = parts.hint("merge").join(earliest, F.col("conv_id").eqNullSafe(F.col("_of")) & (F.col("said") == F.col("_said")))
    met = met.withColumn("seen", F.col("section") > F.col("earliest"))
    others = rows.hint("merge").join(long.select("_conv"), same, "left_anti").withColumns(whole)
    return others.unionByName(met.select(*others.columns)), True


def _groups(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    """Rows of one (conv_id, section) together."""
    group: dict[str, list] = {}
    for b in batches:
        marks = list(zip(b["conv_id"], b["section"]))
        start = 0
        while start < len(marks):
            end = start + 1
            while end < len(marks) and marks[end] == marks[start]:
                end += 1
            if group and (group["conv_id"][0], group["section"][0]) != marks[start]:
                yield group
                group = {}
            for name in b:
                group.setdefault(name, []).extend(b[name][start:end])
            start = end
    if group:
        yield group


def _faults(group: dict[str, list]) -> tuple[str, list[str]]:
    """Role initials and faults of a section's rows."""
    said, out = set(), []
    for role, text, blank, cut, seen in zip(group["role"], group["text"], group["blank"], group["cut"], group["seen"]):
        fault = "blank" if blank else "duplicate" if seen or (role, text) in said else "truncated" if cut else ""
        said.add((role, text))
        out.append(fault)
    return "".join((r or "?")[0] for r in group["role"]), out


def _ways(batches):
    """A row for each way through a section: cost, and place of its audit among those of the same entry."""
    for g in _groups(batches):
        initials, faults = _faults(g)
        conv, section, last = g["conv_id"][0], g["section"][0], g["section"][0] == g["sections"][0] - 1
        out = {"conv_id": [], "section": [], "entry": [], "exit": [], "cost": [], "place": []}
        for p in STATES:
            found = search(initials, faults, p, last)
            for place, q in enumerate(sorted(found, key=lambda q: found[q][1])):
                for name, v in zip(out, (conv, section, p, q, found[q][0], place)):
                    out[name].append(v)
        yield out


def _route(ways: list) -> list[tuple[int, int, int]]:
    """(section, entry, exit) of the cheapest way through all sections: from the last backwards, each state's best cost to the end."""
    by: dict[int, list] = {}
    for w in ways:
        by.setdefault(w["section"], []).append((w["entry"], w["exit"], w["cost"], w["place"]))
    best: dict[int, int] = dict.fromkeys(STATES, 0)
    choice: dict[int, dict[int, int]] = {}
    for k in sorted(by, reverse=True):
        options: dict[int, list] = {}
        for p, q, cost, place in by[k]:
            if q in best:
                options.setdefault(p, []).append((cost + best[q], place, q))
        choice[k] = {p: min(o)[2] for p, o in options.items()}
        best = {p: min(o)[0] for p, o in options.items()}
    out, state = [], 0
    for k in sorted(by):
        out.append((k, state, choice[k][state]))
        state = choice[k][state]
    return out


LOG = "conv_id long, section long, step long, edit string, fault string, turn long, was string, role string, text string, cost long"


def _log(batches):
    """The edits of each section, from its entry to its exit."""
    for g in _groups(batches):
        initials, faults = _faults(g)
        found = search(initials, faults, g["entry"][0], g["section"][0] == g["sections"][0] - 1)
        audit = found[g["exit"][0]][1] if g["exit"][0] >= 0 else next(iter(found.values()))[1]
        out: dict[str, list] = {name.split()[0]: [] for name in LOG.split(", ")}
        i, q = 0, g["entry"][0]
        for step, e in enumerate(audit):
            at = None if e == "I" else i
            role, to = WANTED[q]
            if e == "K":
                role, to = g["role"][i], NEXT[q, initials[i]]
            elif e == "D":
                role, to = None, q
            fault = faults[at] if at is not None else ""
            cost = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[e] + (TRUNCATED if fault == "truncated" and e != "D" else 0)
            row = (g["conv_id"][0], g["section"][0], step, e, fault, None if at is None else g["turn"][at], None if at is None else g["role"][at], role, None if e == "D" else "" if at is None else g["text"][at], cost)
            for name, v in zip(out, row):
                out[name].append(v)
            i, q = i + (at is not None), to
        yield out


def edits(turns: DataFrame, section_rows: int = SECTION_ROWS, section_bytes: int = SECTION_BYTES) -> tuple[DataFrame, bool]:
    """(edits, whether a conversation is in several sections). Edits have a row for each step of a conversation's audit: ``edit`` (K, R, D or I), the row's ``fault``,
    ``turn`` and role before (``was``), ``role`` and ``text`` after (null where it goes), and its cost. The repaired conversation is what isn't
    deleted, by section and step; rows of one section lie together, in order."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    rows, several = _sectioned(rows, section_rows, section_bytes)
    rows = rows.withColumns({"blank": ~F.col("text").rlike(VISIBLE), "cut": ~F.col("text").rlike(ENDED)})
    order = ["conv_id", "section", "at", F.col("turn").asc_nulls_first(), "role", "text"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, "conv_id", "section").sortWithinPartitions(*order)
    names = ["conv_id", "section", "sections", "at", "turn", "role", "text", "blank", "cut", "seen"]
    way = {"entry": F.lit(0), "exit": F.lit(-1)}
    if not several:
        return map_batches(dealt(rows.select(*names).withColumns(way)), _log, LOG), False
    rows = written(rows.select(*names), "rows")
    ways = map_batches(dealt(rows.where("sections > 1")), _ways, "conv_id long, section long, entry int, exit int, cost long, place int")
    met = ways.groupBy("conv_id").agg(F.collect_list(F.struct("section", "entry", "exit", "cost", "place")).alias("ways"))

    def routes(batches):
        for b in batches:
            out = {"_conv": [], "_section": [], "entry": [], "exit": []}
            for conv, found in zip(b["conv_id"], b["ways"]):
                for k, p, q in _route(found):
                    for name, v in zip(out, (conv, k, p, q)):
                        out[name].append(v)
            yield out

    routed = written(map_batches(met, routes, "_conv long, _section long, entry int, exit int"), "routes")
    long = rows.where("sections > 1").hint("merge").join(routed, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("section") == F.col("_section"))).drop("_conv", "_section")
    return map_batches(dealt(rows.where("sections = 1").withColumns(way).unionByName(long)), _log, LOG), True


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


class _Tally:
    """A conversation's sums, taken up row by row: no texts are held."""

    def __init__(self) -> None:
        self.audit, self.cost, self.illegal, self.counts = [], 0, 0, dict.fromkeys(FAULTS, 0)
        self.digest, self.begun, self.before = hashlib.sha256(), False, None
        self.low = self.high = None
        self.turns = 0

    def add(self, edit, fault, turn, was, role, text, cost) -> None:
        self.audit.append(edit)
        self.cost += cost
        if edit != "I":
            self.counts[fault] += 1
            if self.before is not None:
                self.illegal += (self.before[:1] + was[:1]) not in LEGAL
            self.before = was
            if turn is not None:
                self.turns += turn != self.high
                self.low, self.high = turn if self.low is None else self.low, turn
        if edit != "D":
            self.digest.update((b"\n" if self.begun else b"") + f"{role}:{text}".encode())
            self.begun = True

    def row(self, conv) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (conv, gaps, *(self.counts[k] for k in FAULTS[1:]), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def summaries(log: DataFrame, several: bool) -> DataFrame:
    """One row for each conversation of :func:`edits`: faults, cost, audit and the digest of what is left, taken in one pass over its rows in order."""

    def run(batches):
        conv, tally = None, None
        for b in batches:
            out: dict[str, list] = {name.split()[0]: [] for name in SUMMARY.split(", ")}
            for row in zip(*(b[c] for c in ("conv_id", "edit", "fault", "turn", "was", "role", "text", "cost"))):
                if tally is None or row[0] != conv:
                    if tally is not None:
                        for name, v in zip(out, tally.row(conv)):
                            out[name].append(v)
                    conv, tally = row[0], _Tally()
                tally.add(*row[1:])
            yield out
        if tally is not None:
            yield {name.split()[0]: [v] for name, v in zip(SUMMARY.split(", "), tally.row(conv))}

    if several:
        parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        log = log.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "section", "step")
    return map_batches(log, run, SUMMARY)


def repaired(turns: DataFrame, of: DataFrame, section_rows: int = SECTION_ROWS, section_bytes: int = SECTION_BYTES) -> DataFrame:
    """Summaries of every conversation of ``of`` after the repair of ``turns``; one without rows left has zeros, an empty audit and an empty text's digest."""
    found = summaries(*edits(turns, section_rows, section_bytes)).withColumnRenamed("conv_id", "_conv")
    ids = of.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    names = [x.split() for x in SUMMARY.split(", ")[1:]]
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return out.select("conv_id", *[F.coalesce(n, none.get(n, F.lit(0).cast("long"))).alias(n) for n, _ in names])
