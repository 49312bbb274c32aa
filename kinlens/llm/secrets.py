"""Secret scans: base patterns, and assignment-aware lexing of source and configuration syntax.

The lexer reads name-literal pairs: ``name = "x"``, ``name: x``, ``"name": "x"``, ``name: type = "x"``, ``var name type = "x"``,
``a["name"] = "x"``, ``#define name "x"``, ``ENV name x``, ``<name>x</name>``, ``--name x``; strings with prefixes, in triple quotes and
back quotes, in parentheses, on the next line, and block scalars. Further lists, tuples and calls as values, compound operators, conditional values,
up to sixteen names with as many values, attributes ``key="name" value="x"``, calls with a name and a default, setters, ``set name x``, and bearer
headers; a literal in a call or a list that is a sensitive name itself is no value. It propagates constants (``a = "x"; token = a``, and ``+`` of literals and
names, also ``a.strip()``), and scores a literal by the most sensitive of the targets that it reaches and by how random the target's value looks.
Each literal comes once; time grows with the text, not with its chains. Only texts that hold a sensitive name are lexed.

Defined results: a null or empty text has no spans; texts are read whole, whatever their length; repeated
rows give repeated results. Offsets are code points, ends exclusive. A name means its latest assignment above.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame

from .bpe import in_pieces
from .common import map_batches

KINDS = ("assign", "access", "hex", "named")
#: The base patterns, each with the least length of what it takes.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # runs end where they end, so the least length can stand in the pattern
HEX = re.compile(r"[0-9a-f]{32,}")
#: Words of target names and their sensitivity.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0, "access_key": 1.0, "accesskey": 1.0, "private_key": 1.0, "privatekey": 1.0, "client_key": 0.8, "auth_key": 0.9, "authkey": 0.9, "credential": 0.9, "signing_key": 0.9, "encryption_key": 0.9, "connection_string": 0.8, "bearer": 0.8}
#: Words that make a name or a literal a placeholder.
HARMLESS = ("example", "placeholder", "changeme", "your", "xxxx", "dummy", "sample", "redacted", "none", "null", "true", "false")
#: A literal counts from this score and length.
LEAST_SCORE, LEAST_LITERAL = 0.55, 8

_STEM = re.compile("|".join(sorted(SENSITIVE, key=len, reverse=True)))
#: Found in every lower-cased text that holds a name to which :func:`sensitivity` gives anything: words can be joined as in camelCase.
_GATE = re.compile("|".join(sorted({w.replace("_", "[-_.]?") for w in SENSITIVE}, key=len, reverse=True)))
#: Words of placeholders and of names, for how much of a literal they make up.
_PLAIN = re.compile("|".join(sorted([*HARMLESS, *(w.replace("_", "[-_.]?") for w in SENSITIVE)], key=len, reverse=True)))
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
#: A string with its prefix; runs are possessive, so that no text is read again and again.
_STRING = (
    r"""(?:(?<![A-Za-z0-9_])[A-Za-z]{1,2})?(?:\"\"\"[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+\"\"\"|\'\'\'[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+\'\'\'"""
    r"""|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`[^`\n]*+`)"""
)
_TYPE = r"[&*]*+(?:'[a-z]++[ \t]++)?[A-Za-z_][\w.]*+(?:[\[<][\w., |\[<]*+[\]>]++)?(?:[ \t]*+\|[ \t]*+[\w.]++)*+[?*&!]*+"
#: What can stand behind an operator: strings in parentheses, one or a bare word with what is added to it, a string on the next line, a block scalar.
_VALUE = (
    rf"""\([ \t]*+(?:\n\s*+)?{_STRING}(?:\s*+\+?\s*+{_STRING})*+"""
    rf"""|(?:{_STRING}|[^\s"'`+,;#<>(){{}}\[\]|]++(?<!:))(?:[ \t]*+\+[ \t]*+(?:\\?\n[ \t]*+)?(?:{_STRING}|{_NAME})|[ \t]*+{_STRING})*+"""
    rf"""|\\?\n[ \t]*+{_STRING}(?![ \t]*+[:=])|[|>][-+]?[ \t]*+\n[ \t]++[^\s"'`]++"""
)
_PAIR = re.compile(
    rf"""(?P<q>["']?)(?<![A-Za-z0-9_.\-])(?:(?:var|const)[ \t]++(?P<go>{_NAME})(?=[ \t]+[\w\[\]*.]++[ \t]*+=))?(?P<name>(?(go)[ \t]++[\w\[\]*.]++|{_NAME}))(?P=q)[ \t]*+(?:\[\w*+\][ \t]*+|\][ \t]*+)?"""
    rf"""(?::[ \t]*+(?P<type>{_TYPE})[ \t]*+(?==(?![=>])))?(?P<op>:=|=>|=(?![=>])|:(?![:=]))[ \t]*+(?P<value>{_VALUE})"""
    rf"""|<(?P<tag>{_NAME})>(?P<inner>[^<>\n]*+)</(?P=tag)>"""
    rf"""|(?<![\w-])--(?P<flag>[A-Za-z][A-Za-z0-9_\-]*+)[ \t]++(?P<given>[^\s"'-][^\s"']*+)"""
    rf"""|(?:\#[ \t]*+define|(?<![\w-])(?:ENV|setenv))[ \t]++(?P<macro>{_NAME})[ \t]++(?P<body>{_STRING}|[^\s"'`(]++)"""
)
_PART = re.compile(
    r"""\"\"\"((?:[^"\\]|\\[\s\S]|"(?!""))*+)\"\"\"|\'\'\'((?:[^'\\]|\\[\s\S]|'(?!''))*+)\'\'\'|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`"""
    r"""|([^\s"'`+]++)(?!["'`])|[A-Za-z]{1,2}(?=["'`])"""
)
_IDENTIFIER = re.compile(_NAME + r"\Z")
_GAP = r"[ \t]*+(?:\n[ \t]*+)?"
_LIST = rf"{_STRING}(?:{_GAP},{_GAP}{_STRING})*+"
#: Forms beyond a name, an operator and a value that begins at once; what can be long and precede a string is bounded, so that no line is read again and again.
_FORMS = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])(?P<name>{_NAME})["']?[ \t]*+(?:(?:\+|\|\||\?\??|\.)=[ \t]*+(?P<more>{_STRING}|[A-Za-z0-9+/_.=-]++)"""
    rf"""|(?:(?:\+|\|\||\?\??|:)?=(?![=>])|:(?![:=]))[ \t]*+(?:(?:[\[{{(]|[A-Za-z_][\w.]{{0,99}}+[\[({{]){_GAP}(?P<list>{_LIST})|\\\n[ \t]*+(?P<next>{_STRING})"""
    rf"""|[^\n"'`?:;,#=]{{1,200}}+\?[ \t]*+(?P<yes>{_STRING})[ \t]*+:[ \t]*+(?P<no>{_STRING})?+))"""
    rf"""|(?<![A-Za-z0-9_.\-])(?P<names>{_NAME}(?:[ \t]*+,[ \t]*+{_NAME}){{1,15}}+)[ \t]*+=(?![=>])[ \t]*+\(?(?P<values>{_LIST})"""
    rf"""|(?<![\w-])(?:key|name|id)[ \t]*+=[ \t]*+(?P<key>{_STRING})\s++value[ \t]*+=[ \t]*+(?P<held>{_STRING})"""
    rf"""|(?<=[\w])\({_GAP}(?P<given>{_STRING})[ \t]*+,{_GAP}(?P<default>{_STRING})"""
    rf"""|(?<![A-Za-z0-9])(?:set|with|use|add)_?(?P<setter>[A-Za-z]\w{{0,99}}+)\({_GAP}(?P<set>{_STRING})(?![ \t]*+,{_GAP}["'])"""
    rf"""|(?m:^)[ \t]*+(?:set|setx|export)[ \t]++(?P<variable>{_NAME})[ \t]++(?P<word>{_STRING}|[^\s"'`=(]++)"""
    rf"""|[Aa]uthorization["']?\]?[ \t]*+[:=,][ \t]*+["']?(?P<scheme>[Bb]earer|[Tt]oken)[ \t]++(?P<bearer>[A-Za-z0-9+/_.=~-]++)"""
)
#: Groups of _FORMS: of the target's name, and of what holds its literals.
_TARGETS = {"more": "name", "list": "name", "next": "name", "yes": "name", "no": "name", "held": "key", "default": "given", "set": "setter", "word": "variable", "bearer": "scheme"}


class Literal(NamedTuple):
    """A literal of a pair: its target's name, its text, where it stands, and its score."""

    name: str
    value: str
    start: int
    end: int
    score: float


def sensitivity(name: str) -> float:
    """The highest sensitivity of a name's words; ``camelCase`` and ``kebab-case`` count as ``snake_case``."""
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().replace("-", "_").replace(".", "_")
    found = _STEM.findall(snake)
    return 0.0 if not found or not set(snake.split("_")).isdisjoint(HARMLESS) else max(SENSITIVE[m] for m in found)


def placeholder(value: str) -> bool:
    """A word of the literal (without digits at its end) says so, or half of it consists of such words and of target names."""
    low = value.lower()
    if any(w.rstrip("0123456789") in HARMLESS for w in re.split(r"[^a-z0-9]+", low)):
        return True
    plain = sum(len(m[0]) for m in _PLAIN.finditer(low))
    return plain * 2 >= len(low) and any(w in low for w in HARMLESS)


class _Sum:
    """Characters of a value that is put together: their number, shares and classes. Those beyond ASCII are folded to 128 kinds, and numbers
    are scaled down when a value doubles on and on, so that it is of bounded size."""

    __slots__ = ("counts", "n", "classes")

    def __init__(self, text: str = "") -> None:
        folded = Counter(text)
        self.counts: dict[int, float] = {}
        for c, k in folded.items():
            at = ord(c) if c < "\x80" else 128 + ord(c) % 128
            self.counts[at] = self.counts.get(at, 0.0) + k
        self.n = float(len(text))
        self.classes = sum(1 << i for i, f in enumerate((str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())) if any(map(f, folded)))

    def add(self, other: _Sum) -> None:
        for c, k in other.counts.items():
            self.counts[c] = self.counts.get(c, 0.0) + k
        self.n += other.n
        self.classes |= other.classes
        if self.n > 1e15:
            self.counts = {c: k / 1e6 for c, k in self.counts.items()}
            self.n /= 1e6

    def randomness(self) -> float:
        """0 to 1: bits a character against four, and the number of character classes."""
        if self.n < LEAST_LITERAL:
            return 0.0
        bits = -sum(c / self.n * math.log2(c / self.n) for c in self.counts.values())
        return min(1.0, bits / 4) * (0.4 + 0.2 * min(self.classes.bit_count(), 3))


class _Binding:
    """An assignment: its own literals, the bindings that it names, and the sum of its value."""

    __slots__ = ("name", "own", "uses", "sum", "best")

    def __init__(self, name: str, own: list[tuple[str, int, int]], uses: list[_Binding]) -> None:
        self.name, self.own, self.uses = name, own, uses
        self.sum = _Sum("".join(v for v, _, _ in own if not placeholder(v)))
        for x in uses:
            self.sum.add(x.sum)
        self.best: tuple[float, str] = (sensitivity(name) * self.sum.randomness(), name)


def _parts(m: re.Match, k: str) -> list[tuple[str, int, int]]:
    """The literals (text, start, end) of a group."""
    at = m.start(k)
    found = [(p, p.lastindex) for p in _PART.finditer(m[k]) if p.lastindex is not None]
    return [(p[i], at + p.start(i), at + p.end(i)) for p, i in found if p[i] and p[i].strip(",[({")]


def _formed(m: re.Match) -> list[_Binding]:
    """The assignments of a match of _FORMS."""
    if m["names"]:
        names = [n.strip() for n in m["names"].split(",")]
        return [_Binding(n, [x], []) for n, x in zip(names, _parts(m, "values"))]
    out = []
    for k, target in _TARGETS.items():
        if m[k]:
            name = m[target].strip("\"'`") if target in ("key", "given") else m[target]
            own = [x for x in _parts(m, k) if k not in ("list", "default") or not sensitivity(x[0])]
            out += [_Binding(name, [x], []) for x in own]  # of a list each is a value by itself
    return out


def _bindings(text: str) -> list[_Binding]:
    """The assignments of a text, in order."""
    known: dict[str, _Binding] = {}
    out: list[_Binding] = []
    for m in heapq.merge(_PAIR.finditer(text), _FORMS.finditer(text), key=lambda m: m.start()):
        if m.re is _FORMS:
            made = _formed(m)
            out += made
            known |= {x.name: x for x in made}
            continue
        own, uses = [], []
        names = [m["tag"] or m["flag"] or m["macro"] or m["go"] or m["name"]]
        if m["tag"] or m["flag"]:
            k = "inner" if m["tag"] else "given"
            own.append((m[k], m.start(k), m.end(k)))
        else:
            k = "body" if m["macro"] else "value"
            if m["type"]:
                names.append(m["type"])
            at = m.start(k)
            for p in _PART.finditer(m[k]):
                if p.lastindex is None:  # a string's prefix
                    continue
                x = p[p.lastindex]
                bare = known.get(x) if p.lastindex == 6 and _IDENTIFIER.match(x) else None
                called = p.lastindex == 6 and text[at + p.end(6) : at + p.end(6) + 1] == "(" and _IDENTIFIER.match(x)
                if bare is None and called:  # a method of a constant
                    bare = known.get(x.rpartition(".")[0])
                if bare is not None:
                    uses.append(bare)
                elif x and not called and not (p.lastindex == 6 and x in "(|>\\|-+|>->+"):
                    own.append((x, at + p.start(p.lastindex), at + p.end(p.lastindex)))
        made = _Binding(max(names, key=sensitivity), own, uses)  # ``a: b = x`` can be a path as well as a type
        known[names[0]] = made
        if len(names) > 1 and sensitivity(names[1]):
            known[names[1]] = made
        out.append(made)
    return out


def literals(text: str) -> list[Literal]:
    """All literals, each once, with the target that scores most of those that it reaches (its own, or through constants), the
    first of several. A placeholder scores nothing and counts for nothing in what it is part of."""
    made = _bindings(text)
    order = {id(x): i for i, x in enumerate(made)}
    first = [(x.best[0], -i, x.name) for i, x in enumerate(made)]
    for i in range(len(made) - 1, -1, -1):  # a binding is used by later ones alone, which are done
        for x in made[i].uses:
            k = order[id(x)]
            first[k] = max(first[k], first[i])
    found: dict[tuple[int, int], Literal] = {}
    for x, best in zip(made, first):
        for v, s, e in x.own:
            one = Literal(best[2], v, s, e, 0.0 if placeholder(v) else best[0])
            if (s, e) not in found or found[s, e].score < one.score:  # read as two forms
                found[s, e] = one
    return list(found.values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns' matches, each kind leftmost and not overlapping."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, those and the lexer's), each ordered by start, then kind."""
    base = sorted(base_spans(text))
    if not _GATE.search(text.lower()):
        return base, base
    named = {(x.start, 3, x.end) for x in literals(text) if x.score >= LEAST_SCORE}
    return base, sorted([*base, *named])


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, base, spans): arrays of (start, kind, end), the base patterns' and all."""

    def run(batches):
        for b in batches:
            for s in in_pieces(b["text"]):
                found = [all_spans(t or "") for t in b["text"][s]]
                rows = [[[{"start": x, "kind": KINDS[k], "end": e} for x, k, e in spans] for spans in pair] for pair in found]
                yield {"doc_id": b["doc_id"][s], "base": [r[0] for r in rows], "spans": [r[1] for r in rows], "base_sha256": [hashlib.sha256(spell(f[0]).encode()).hexdigest() for f in found]}

    one = "array<struct<start:long,kind:string,end:long>>"
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id long, base {one}, spans {one}, base_sha256 string")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; other columns and rows as they are."""
    names = docs.columns

    def run(batches):
        for b in batches:
            texts = []
            for t in b["text"]:
                out, at = [], 0
                for s, _, e in all_spans(t)[1] if t else []:
                    if s >= at:
                        out += [t[at:s], mark]
                    at = max(at, e)
                texts.append("".join([*out, t[at:]]) if out else t)
            yield b | {"text": texts}

    return map_batches(docs.select(*[f"`{n}`" for n in names]), run, docs.schema)
