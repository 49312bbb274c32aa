"""MinHash near-duplicates with HyperMinHash registers.

A document's set is the distinct 5-word shingles of its lower-cased text, as 64-bit hashes. One hash a shingle
fills 256 registers: the top bits choose the register, the rest its value, of which the leading-zero count of the
register's least hash and ten mantissa bits are kept. Empty registers borrow
from filled ones, and bands of registers are the candidate keys, as wide as lets a pair at the threshold miss all of them
with a probability of at most 4e-9: 51 bands of five at a similarity of 0.8, 42 of six at 0.85. Candidates whose collision-corrected estimate
lies six standard deviations under the threshold are dropped; the rest are confirmed on the full sets.

Equal sets are one class from the start, so copies never meet each other. Of a band key's classes each is
first held against the smallest one; what is linked then counts as one component, and only classes of different
components that share a key are compared further. From then on a key is those of its classes that aren't linked with its first one, which stands for
the others. In large keys those outside the largest component are held against further
members, for a few rounds as long as a tenth of their pairs link, and what is settled doesn't enter the next; what is left is compared on registers and where
it lies, in blocks: those outside a key's largest component with all others, so a key of S classes with M outside costs about M * S / BLOCK rows, S at least. Those
with a rival that the estimate leaves come again with their full sets.

Defined results: a null, empty or blank text has the empty set and is linked with nothing; a text of fewer than five
words is one shingle; repeated rows of a document are one document in the components and each keep their row; of an id with several texts each is
linked by its own set, and names what it reaches by the same id; null ids are kept, linked with nothing, and their component is
null; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .bpe import in_pieces
from .common import discard, map_batches, mix64, shingle_hashes, written

SHINGLE = 5
#: 100 * intersection >= percent * union, unless a caller has another percentage; and that of the registered query.
PERCENT, QUERY_PERCENT = 80, 85
REGISTERS = 256
MANTISSA = 10
#: The chance at most that a pair at the threshold shares no band.
MOST_MISSED = 4e-9
#: Classes of one key that are held against each other in one place.
BLOCK = 512
#: Rounds at most in which large keys of several components are held against another member of their largest one, and the share of a
#: round's pairs that has to link for another to follow: where fewer do, rounds settle next to nothing and blocks have the rest either way.
STAR_ROUNDS = 3
LEAST_LINKED = 0.1
#: Bits of the filter that keeps texts out of a shuffle: 4 MB.
FILTER_BITS = 1 << 25
#: Standard deviations of slack of the estimate.
SLACK = 6.0


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (unsigned 16 bits; 0: empty): leading zeros + 1 above ten mantissa bits of each register's least hash."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        h = mix64(shingles ^ np.uint64(0x5851F42D4C957F2D))
        at = (h >> np.uint64(56)).astype(np.int64)
        low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(low, at, h << np.uint64(8))
        used = np.zeros(REGISTERS, bool)
        used[at] = True
        v = low[used]
        # the exponent of the value as a double is its bit length, but for rounding up next to a power of two: both registers of a pair round alike
        length = np.frexp(v.astype(np.float64))[1].astype(np.int64)
        zeros = np.minimum(64 - length, 62)
        shift = (zeros + 1).astype(np.uint64)
        mantissa = (v << shift) >> np.uint64(64 - MANTISSA)
        out[used] = ((zeros + 1) << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    return out


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that a register of two disjoint sets of ``n`` and ``m`` shingles holds the same value: over every
    leading-zero count, two exponential minima in the same of 2^10 cells of its octave."""
    a, b = np.asarray(n, float)[:, None] / REGISTERS, np.asarray(m, float)[:, None] / REGISTERS
    top = 2.0 ** -np.arange(0, 56, dtype=float)[None]
    s = a + b
    cell = top / 2 / (1 << MANTISSA)
    return (cell * a * b / s * (np.exp(-s * top / 2) - np.exp(-s * top))).sum(1)


def estimate(r: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected similarity of rows of registers, and the number of registers that either fills."""
    filled = ((r > 0) | (q > 0)).sum(1)
    same = ((r == q) & (r > 0)).sum(1) / np.maximum(filled, 1)
    c = expected_collisions(n, m)
    return np.clip((same - c) / (1 - c), 0, 1), filled


def text_version(text):
    """What tells the texts of one id apart."""
    return F.xxhash64(text)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, version, n, twin, regs): a hash of the text, set size, a 128-bit sum of the set (equal sets, equal sums), and registers (binary)."""

    def run(batches):
        for b in batches:
            for s in in_pieces(b["text"]):
                sets = [shingle_hashes((t or "").encode()) for t in b["text"][s]]
                twin = [mix64(x).sum(dtype=np.uint64).tobytes() + mix64(x ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).tobytes() for x in sets]
                yield {"doc_id": b["doc_id"][s], "version": b["version"][s], "n": [len(x) for x in sets], "twin": twin, "regs": [registers(x).astype("<u2").tobytes() for x in sets]}

    return map_batches(docs.select("doc_id", "text", text_version(F.col("text")).alias("version")), run, "doc_id long, version long, n long, twin binary, regs binary")


_ORDERS = mix64(np.arange(REGISTERS * REGISTERS, dtype=np.uint64)).reshape(REGISTERS, REGISTERS)
_PLACES = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def band_width(percent: int) -> int:
    """Registers of a band: as many as let a pair at the threshold miss all bands no more often than MOST_MISSED."""
    t = percent / 100
    return max([b for b in range(1, 33) if (1 - t**b) ** (REGISTERS // b) <= MOST_MISSED], default=1)


def densified(regs: np.ndarray) -> np.ndarray:
    """Rows of registers without empty ones: an empty register takes the value of the filled one that comes first in its own
    random order, so that each agrees with another set's as often as the sets are similar, however small they are."""
    out = regs.copy()
    for k in np.flatnonzero((regs == 0).any(1) & (regs > 0).any(1)).tolist():
        filled = np.flatnonzero(regs[k])
        empty = np.flatnonzero(regs[k] == 0)
        out[k, empty] = regs[k, filled[np.argmin(_ORDERS[empty][:, filled], 1)]]
    return out


def keys_of(regs: np.ndarray, percent: int) -> np.ndarray:
    """Keys of every band (rows, bands) of rows of registers."""
    width = band_width(percent)
    bands = REGISTERS // width
    parts = densified(regs)[:, : bands * width].reshape(-1, bands, width).astype(np.uint64)
    return mix64((parts * _PLACES[:width]).sum(2, dtype=np.uint64) + mix64(np.arange(bands, dtype=np.uint64) + np.uint64(977))).view(np.int64)


def band_keys(classes: DataFrame, percent: int) -> DataFrame:
    """(key, band, id, n) for each band of a class."""

    def run(batches):
        for b in batches:
            regs = np.frombuffer(b"".join(b["regs"]), "<u2").reshape(-1, REGISTERS)
            yield {"id": b["id"], "n": b["n"], "keys": list(keys_of(regs, percent))}

    rows = map_batches(classes.select("id", "n", "regs"), run, "id long, n long, keys array<long>")
    return rows.select("id", "n", F.posexplode("keys").alias("band", "key"))


def _near_in_size(n, m, percent: int):
    """The smaller set can hold the share of the larger one that the threshold asks for."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the estimate does not rule out."""
    r = written(among(classes.select("id", "n", "regs"), "id", pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), "registers")
    both = pairs.hint("merge").join(r.toDF("a", "n_a", "regs_a"), "a").hint("merge").join(r.toDF("b", "n_b", "regs_b"), "b")

    def run(batches):
        for x in batches:
            p = np.frombuffer(b"".join(x["regs_a"]), "<u2").reshape(-1, REGISTERS)
            q = np.frombuffer(b"".join(x["regs_b"]), "<u2").reshape(-1, REGISTERS)
            j, filled = estimate(p, q, np.array(x["n_a"]), np.array(x["n_b"]))
            t = percent / 100
            keep = j >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(filled, 1))
            yield {"a": [v for v, k in zip(x["a"], keep) if k], "b": [v for v, k in zip(x["b"], keep) if k]}

    return map_batches(both, run, "a long, b long")


def among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``rows`` whose ``column`` is in ``wanted`` (one column of that name, distinct).

    A hashed bitmap of the wanted ids, of FILTER_BITS at most whatever their number, goes to every task and keeps most other
    rows out of the shuffle; the join behind it decides.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    maps = wanted.select(at(column).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    byte = "cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_at) div 8 + 1 as int), 1)), 16, 10) as int)"
    is_set = F.expr(f"(shiftright({byte}, cast(bitmap_bit_position(_at) % 8 as int)) & 1) = 1")
    near = rows.withColumn("_at", at(column)).withColumn("_bucket", F.bitmap_bucket_number("_at")).join(F.broadcast(maps), "_bucket").where(is_set)
    return near.select(*rows.columns).hint("merge").join(wanted, column, "left_semi")


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles): the full sets of the wanted classes (id), sorted 64-bit hashes in a binary column, from the text that stands for each."""
    places = written(among(classes.select("id", "doc_id", "version"), "id", wanted), "places")
    texts = among(docs.select("doc_id", "text"), "doc_id", places.select("doc_id").distinct()).withColumn("version", text_version(F.col("text")))
    texts = texts.hint("merge").join(places, ["doc_id", "version"]).groupBy("id").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            for s in in_pieces(b["text"]):
                yield {"id": b["id"][s], "shingles": [shingle_hashes((t or "").encode()).astype("<u8").tobytes() for t in b["text"][s]]}

    out = written(map_batches(texts, run, "id long, shingles binary"), "sets")
    discard(places)
    return out


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    pairs = written(pairs, "pairs")
    sets = sets_of(docs, classes, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    both = pairs.hint("merge").join(sets.toDF("a", "s_a"), "a").hint("merge").join(sets.toDF("b", "s_b"), "b")

    def run(batches):
        for x in batches:
            keep = []
            for p, q in zip(x["s_a"], x["s_b"]):
                u, v = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                keep.append(bool(linked(u, [v], percent)[0]))
            yield {"a": [v for v, k in zip(x["a"], keep) if k], "b": [v for v, k in zip(x["b"], keep) if k]}

    out = written(map_batches(both, run, "a long, b long"), "links")
    discard(pairs, sets)
    return out


def linked(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sorted sets reach the threshold with ``own``."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    shared = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * shared >= percent * (len(own) + sizes - shared)


def linked_classes(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the classes (id, doc_id, version, n, regs) that are linked with another."""
    rows = band_keys(classes, percent)
    counts = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("first")).where("size > 1")
    shared = written(rows.join(counts, "key").select("key", "band", "id", "n", "size", F.col("first.id").alias("head"), F.col("first.n").alias("n_head")), "shared")

    stars = shared.where("id <> head").where(_near_in_size(F.col("n"), F.col("n_head"), percent))
    tried = written(stars.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "tried")
    links = confirmed(estimated(tried, classes, percent), docs, classes, percent)
    found = components(links)
    left = mixed_keys(unsettled(shared, links), found)
    for k in range(STAR_ROUNDS):
        large = left.where(F.col("n_top") + F.col("n_rest") > BLOCK)
        head = large.where("is_top").groupBy("key").agg(F.min_by(F.struct("id", "n"), F.xxhash64("id", F.lit(k))).alias("head"))
        rest = large.where("NOT is_top").hint("merge").join(head, "key").where(_near_in_size(F.col("n"), F.col("head.n"), percent))
        again = written(rest.select(F.least("head.id", "id").alias("a"), F.greatest("head.id", "id").alias("b")).distinct(), "tried")
        pairs = again.count()
        new = confirmed(estimated(again, classes, percent), docs, classes, percent) if pairs else again
        settled = new.count()
        discard(again)
        if not settled:
            discard(new)
            break
        both = written(links.union(new), "links")
        discard(links, new, found)
        links, found = both, components(both)
        if settled < LEAST_LINKED * pairs:
            break
        before, left = left, mixed_keys(left.select("key", "band", "id", "n", "w"), found)
        discard(before)
    # what still shares a key across components: all classes of those keys
    open_keys = written(left.select("key").distinct(), "keys")
    discard(left)
    left = mixed_keys(shared.hint("merge").join(open_keys, "key", "left_semi").select("key", "band", "id", "n", F.lit(1).cast("long").alias("w")), found)
    regs = written(among(classes.select("id", "regs"), "id", left.select("id").distinct()), "registers")
    close = written(in_groups(in_blocks(left.drop("w").hint("merge").join(regs, "id")), partial(close_members, percent=percent), PLACE), "close")
    sets = sets_of(docs, classes, close.select("id").distinct())
    more = written(in_groups(close.hint("merge").join(regs.hint("merge").join(sets, "id"), "id"), partial(links_of, percent=percent), "a long, b long").distinct(), "links")
    if not more.isEmpty():
        discard(found)
        found = components(links.union(more))
    discard(shared, tried, links, open_keys, left, regs, close, sets, more)
    return found


def unsettled(shared: DataFrame, links: DataFrame) -> DataFrame:
    """(key, band, id, n, w) of the keys that hold classes not linked with their first: those, each for itself, and the first for the rest (so many
    are ``w``); of large keys some others, too, as further members to hold against."""
    linked_ones = links.select(F.col("a").alias("head"), F.col("b").alias("id"))
    rest = written(shared.where("id <> head").hint("merge").join(linked_ones, ["head", "id"], "left_anti"), "rest")
    keys = rest.groupBy("key").agg(F.count("*").alias("apart"), *[F.min(c).alias(c) for c in ("band", "size", "head", "n_head")])
    large = shared.where(F.col("size") > BLOCK)
    others = large.groupBy("key", "band").agg(*[F.min_by(F.struct("id", "n"), F.xxhash64("id", F.lit(k))).alias(f"m{k}") for k in range(STAR_ROUNDS)])
    others = others.hint("merge").join(keys.select("key"), "key", "left_semi").select("key", "band", F.explode(F.array_distinct(F.array(*[f"m{k}" for k in range(STAR_ROUNDS)]))).alias("m"))
    w = lambda c: c.cast("long").alias("w")
    out = rest.select("key", "band", "id", "n", w(F.lit(1))).union(keys.select("key", "band", "head", "n_head", w(F.col("size") - F.col("apart"))))
    return out.union(others.select("key", "band", "m.id", "m.n", w(F.lit(0))))


def mixed_keys(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, band, id, n, w, component, is_top, n_top, n_rest) of the keys of ``rows`` (key, band, id, n, w) that hold several components: whether a
    class is of its key's largest component, and how many classes, by weight, are and aren't. Components only merge, so no other key can
    become mixed later."""
    where = written(rows.hint("merge").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")  # read twice
    each = where.groupBy("key", "component").agg(F.sum("w").alias("c"))
    tops = each.groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("top")).where(F.col("size") > F.col("top.c"))
    tops = tops.select("key", F.col("top.component").alias("top"), F.col("top.c").alias("n_top"), (F.col("size") - F.col("top.c")).alias("n_rest"))
    out = written(where.hint("merge").join(tops, "key").withColumn("is_top", F.col("component") == F.col("top")).drop("top"), "mixed")
    discard(where)
    return out


#: A class in a group: a key's pair of blocks, and which of the two it is from.
PLACE = "key long, i int, j int, side int, band int, id long, n long, component long"


def in_blocks(rows: DataFrame) -> DataFrame:
    """Classes (key, band, id, n, component, is_top, n_top, n_rest, regs) in their groups.

    The classes of a key's largest component, and the rest of it, are each dealt into blocks of about BLOCK. Blocks of the rest meet all
    blocks of the largest component (groups i, -1 - j) and each other (i, j); those of the largest component don't meet. A group is two blocks
    at most.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    rows = rows.withColumns({"tops": blocks("n_top"), "rests": blocks("n_rest")})
    rows = rows.withColumn("at", F.pmod(F.xxhash64("id"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("rests"))).cast("int"))
    names = ["key", "i", "j", "side", "band", "id", "n", "component", "regs"]
    rest = rows.where("NOT is_top")
    dealt = [
        (rows.where("is_top"), F.sequence(F.lit(0), F.col("rests") - 1), F.col("at"), -1 - F.col("other"), 0),
        (rest, F.sequence(F.lit(0), F.col("tops") - 1), F.col("other"), -1 - F.col("at"), 1),
        (rest, F.sequence("at", F.col("rests") - 1), F.col("at"), F.col("other"), 0),
        (rest.where("at > 0"), F.sequence(F.lit(0), F.col("at") - 1), F.col("other"), F.col("at"), 1),
    ]
    out = None
    for part, others, i, j, side in dealt:
        part = part.withColumn("other", F.explode(others)).withColumns({"i": i, "j": j, "side": F.lit(side)}).select(*names)
        out = part if out is None else out.unionByName(part)
    return out


def in_groups(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` of every group (key, i, j) of rows, which come to it together."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "id")

    def run(batches):
        group: dict[str, list] = {}
        for x in batches:
            marks = list(zip(x["key"], x["i"], x["j"]))
            start = 0
            while start < len(marks):
                end = start + 1
                while end < len(marks) and marks[end] == marks[start]:
                    end += 1
                if group and (group["key"][0], group["i"][0], group["j"][0]) != marks[start]:
                    yield fn(group)
                    group = {}
                for name in x:
                    group.setdefault(name, []).extend(x[name][start:end])
                start = end
        if group:
            yield fn(group)

    return map_batches(dealt, run, schema)


def rivals(group: dict[str, list], percent: int):
    """For the classes of a group outside its largest component: (class, those of other components that the estimate does not rule out).

    A pair comes at the first band that it shares, once: with all of the largest component, and with those after it of the others. What
    the receiver writes into ``component`` counts from then on.
    """
    ids, n = np.array(group["id"]), np.array(group["n"])
    component = np.unique(group["component"], return_inverse=True)[1]
    if component.max() == 0:
        return
    side, band = np.array(group["side"]), group["band"][0]
    regs = np.frombuffer(b"".join(group["regs"]), "<u2").reshape(-1, REGISTERS)
    keys = keys_of(regs, percent)[:, :band]
    within = group["i"][0] == group["j"][0]
    big = component == np.argmax(np.bincount(component))
    t = percent / 100
    for k in np.flatnonzero(~big).tolist():
        other = (component != component[k]) & (big | (np.arange(len(ids)) > k)) & (np.minimum(n, n[k]) * 100 >= np.maximum(n, n[k]) * percent)
        if not within:
            other &= side != side[k]
        at = np.flatnonzero(other)
        at = at[~(keys[at] == keys[k]).any(1)]  # else an earlier band has the pair
        if len(at):
            j, filled = estimate(regs[at], np.broadcast_to(regs[k], (len(at), REGISTERS)), n[at], np.full(len(at), n[k]))
            at = at[j >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(filled, 1))]
            if len(at):
                yield k, at, component


def close_members(group: dict[str, list], percent: int) -> dict[str, list]:
    """The classes of a group that have a rival in it, and so are to come again with their full sets."""
    close = np.zeros(len(group["id"]), bool)
    for k, at, _ in rivals(group, percent):
        close[k] = close[at] = True
    return {name: [v for v, c in zip(group[name], close) if c] for name in ("key", "i", "j", "side", "band", "id", "n", "component")}


def links_of(group: dict[str, list], percent: int) -> dict[str, list]:
    """Links (a, b) of a group, as many as connect what all its links connect."""
    ids, sets, out = group["id"], [np.frombuffer(s, "<u8") for s in group["shingles"]], {"a": [], "b": []}
    for k, at, component in rivals(group, percent):
        at = at[linked(sets[k], [sets[x] for x in at.tolist()], percent)]
        for c in np.unique(component[at]).tolist():
            x = int(at[np.argmax(component[at] == c)])
            out["a"].append(min(ids[k], ids[x]))
            out["b"].append(max(ids[k], ids[x]))
        component[np.isin(component, component[at])] = component[k]
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept, version), one for each row of ``docs``; similar by ``percent`` or more are linked. ``version``
    is :func:`text_version` of the row's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = written(sketches(docs), "sketches")
    classes = sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("twin", "n").agg(F.min(F.struct("doc_id", "version")).alias("first"), F.first("regs").alias("regs"))
    classes = written(classes.select("twin", "n", "regs", "first.doc_id", "first.version", F.monotonically_increasing_id().alias("id")), "classes")
    found = linked_classes(classes, docs, percent)
    named = classes.select("twin", "n", "id", "doc_id").join(found, "id", "left")
    # components are of classes; what they are called by is the smallest document of theirs
    names = named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("name"))
    named = named.join(names, "component", "left").select("twin", "n", F.coalesce("name", "doc_id").alias("component"))
    # copies can be a third of all rows and share one class; the join deals such a class out in pieces
    out = sketch.drop("regs").hint("merge").join(named, ["twin", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "version")


#: DuckDB SQL of the rows at QUERY_PERCENT: every pair of documents that shares a shingle, and what they reach.
SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {QUERY_PERCENT} * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept FROM t LEFT JOIN n USING (doc_id) JOIN c ON c.id = t.doc_id
"""
