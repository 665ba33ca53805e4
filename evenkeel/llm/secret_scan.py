"""Secrets: base patterns, and assignment-aware lexing of source and configuration text.

Names and literals on both sides of an assignment (``=``, ``:``, ``:=``, ``=>``, ``?=``, ``+=``, also
``name: Type = literal``) are lexed to pairs; a name that is set from another name (or
``${name}``) takes over its literals, also through ``+``; a literal is scored by the most sensitive name that it
reaches and by its own look.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import arrow_map, texts

KINDS = ("assign", "access", "hex", "literal")
# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is [0-9a-f]+ of 24 characters or more

SIGN = re.compile(r":(?::{0,2}=)?|=+")  # one token; two or more "=" compare
BEFORE = re.compile(r"(?:\|\||\?\?|&&|//|[?+.])\Z")  # with "=": the name may keep what it had
TYPE_ENDS = re.compile(r"""[\n="]""")  # no type goes beyond these
TYPE_PART = re.compile(r"""[\w.$&*?!|]++|::|'(?=[a-z]+\b(?!'))|[ \t]++""")
CLOSING = {"<": ">", "(": ")", "[": "]"}
# fixed values: names of types, which no assignment sets after "name:", and words that stand before ":" without being set
TYPES = frozenset(
    "string str String Str text Text bytes byte char bool boolean Boolean int integer Integer long float double number "
    "Number any Any object Object auto var val const final null undefined None nil unknown u8 NSString String_t wstring".split()
)
CONTROL = frozenset(("else", "try", "finally", "default", "do", "otherwise", "begin"))
LITERAL = re.compile(r'''"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`''')
BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>]++")
REFERENCE = re.compile(r"\$\{?([A-Za-z_][\w.]*)\}?|([A-Za-z_][\w.]*)")
BRACED = re.compile(r"\$\{([A-Za-z_][\w.]*)\}")
JOIN = re.compile(r"[ \t]*\+[ \t]*|[ \t]*\\\n[ \t]*")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
# fixed values: how sensitive the words of a name are
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "credential": 3, "credentials": 3,
    "token": 2, "apikey": 3, "bearer": 2, "private": 1, "auth": 1, "access": 1, "signing": 1, "encryption": 1,
    "key": 1, "dsn": 1, "salt": 1, "client": 1, "api": 1, "pass": 2, "oauth": 1, "session": 1,
}
PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|<.*|\$.*|%.*|\{.*|change_?me|your.*|example.*|placeholder|none|null|nil|true|false|todo|test|dummy|redacted)\Z")
THRESHOLD = 3.5


def name_weight(name: str) -> float:
    parts = [w.lower() for w in WORDS.findall(name.rsplit(".", 1)[-1])]
    joined = "".join(parts)
    whole = max((v for k, v in SENSITIVE.items() if v == 3 and joined.endswith(k)), default=0)
    return min(4.0, max(whole, sum(SENSITIVE.get(p, 0) for p in set(parts))))


def literal_weight(value: str) -> float:
    """0 to 2 by length, character classes and entropy; placeholders and words weigh nothing."""
    if len(value) < 6 or PLACEHOLDER.match(value) or value.isalpha() and value.islower() and len(value) < 16:
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum((any(c.islower() for c in counts), any(c.isupper() for c in counts), any(c.isdigit() for c in counts), any(not c.isalnum() for c in counts)))
    return min(2.0, 0.5 * (classes - 1) + (entropy >= 2.5) * 0.5 + (entropy >= 3.2) * 0.5 + (len(value) >= 16) * 0.5)


Piece = tuple[int, int]


class Name(NamedTuple):
    start: int
    end: int
    text: str


class Typed(NamedTuple):
    gap: int  # where white space before the sign starts
    sign: int
    end: int


class Source:
    """A text, with what was found about the run around the last place, so that a long run is searched once."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.bare = self.line = 0, -1
        self.brackets: dict[int, int] | None = None

    def bare_end(self, at: int) -> int:
        """Where the unquoted literal that goes through ``at`` ends; ``at`` if there is none."""
        if not self.bare[0] <= at < self.bare[1]:
            found = BARE.match(self.text, at)
            self.bare = at, found.end() if found else at
        return self.bare[1]

    def line_end(self, at: int) -> int:
        if not self.line[0] <= at <= self.line[1]:
            found = TYPE_ENDS.search(self.text, at)
            self.line, self.brackets = (at, found.start() if found else len(self.text)), None
        return self.line[1]

    def closing(self, at: int) -> int | None:
        """Where the bracket at ``at`` is closed, within the line of the last ``line_end``."""
        if self.brackets is None:
            self.brackets = {}
            opened: dict[str, list[int]] = {c: [] for c in CLOSING.values()}
            for i in range(*self.line):
                c = self.text[i]
                if c in CLOSING:
                    opened[CLOSING[c]].append(i)
                elif c in opened and opened[c]:
                    self.brackets[opened[c].pop()] = i
        return self.brackets.get(at)

    def typed(self, at: int) -> Typed | None:
        """A type from ``at`` on with ``=`` or ``:=`` behind it."""
        text, stop = self.text, self.line_end(at)
        if text[stop : stop + 1] != "=" or text[stop + 1 : stop + 2] in ("=", ">", "~"):
            return None
        place, gap = at, at
        while place < stop and not (place == stop - 1 and text[place] == ":"):
            close = self.closing(place) if text[place] in CLOSING else None
            if close is not None:
                place = gap = close + 1
                continue
            part = TYPE_PART.match(text, place, stop)
            if not part:
                return None
            place = part.end()
            if text[place - 1] not in " \t":
                gap = place
        return Typed(gap if gap > at else place, place, stop + 1) if place > at else None


def value(source: Source, at: int) -> tuple[list[Piece], list[str], int]:
    """Literals and names from ``at`` on, as far as they are joined, and where they end."""
    text = source.text
    literals: list[Piece] = []
    names: list[str] = []
    while True:
        while at < len(text) and text[at] in " \t":
            at += 1
        quoted, braced = LITERAL.match(text, at), BRACED.match(text, at)
        if braced:
            names.append(braced[1])
            at = braced.end()
        elif quoted:
            part = next(i for i in (1, 2, 3) if quoted[i] is not None)
            literals.append(quoted.span(part))
            names += [a or b for a, b in REFERENCE.findall(quoted[part])] if "$" in quoted[part] else []
            at = quoted.end()
        else:
            end = source.bare_end(at)
            if end == at:
                break
            refers = REFERENCE.fullmatch(text, at, end)
            if refers:
                names.append(refers[1] or refers[2])
            if not refers or not refers[1]:
                literals.append((at, end))
            at = end
        joined = JOIN.match(text, at)
        if not joined:
            break
        at = joined.end()
    return literals, names, at


def name_before(text: str, end: int) -> Name | None:
    """The name that ends at ``end``, but for white space, quotes and a bracket; no name goes beyond a sign."""
    while end and text[end - 1] in " \t":
        end -= 1
    for _ in range(2):
        if end and text[end - 1] in "\"']":
            end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.$-"):
        start -= 1
    while start < end and not (text[start].isascii() and text[start].isalpha() or text[start] in "_$"):
        start += 1
    return Name(start, end, text[start:end]) if start < end else None


def is_quoted(text: str, literals: list[Piece]) -> bool:
    return bool(literals) and text[literals[0][0] - 1 : literals[0][0]] in ("\"", "'", "`")


def is_type(name: str) -> bool:
    return name in TYPES or (name[:1].isupper() and not name.isupper() and not name_weight(name))


def pairs(text: str) -> list[tuple[str, list[Piece], list[str]]]:
    """(name, literals, names referred to) of every assignment in order.

    A name that may keep what it had (``+=``, ``?=``) refers to itself. In ``name: Type = literal`` the literal is
    that of ``name``; where ``Type`` may be a name that is set (``else: x = ...``), it has the literal too.
    """
    out, past, source = [], 0, Source(text)
    for sign in SIGN.finditer(text):
        start, at = sign.span()
        if start < past or sign[0].startswith("==") or text[start - 1 : start] in ("=", "!", "<", ">", ":"):
            continue
        keeps = BEFORE.search(text, max(0, start - 2), start) if sign[0] == "=" else None
        named = name_before(text, keeps.start() if keeps else start)
        while at < len(text) and text[at] in "=>~":
            at += 1
        if not named:
            continue
        targets, low = [named.text], sign.end()
        typed = source.typed(at) if sign[0] == ":" else None
        literals, names, end = value(source, typed.end if typed else at)
        if typed and literals and (typed.gap < typed.sign or is_quoted(text, literals)):
            low = typed.end
            inner = name_before(text, typed.sign)
            if inner and inner.start >= at and (named.text in CONTROL or not is_type(inner.text)):
                targets.append(inner.text)
        elif typed:
            literals, names, end = value(source, at)
        elif named.text in TYPES:  # Go: var name string = literal
            first = name_before(text, named.start)
            targets += [first.text] if first and first.end < named.start else []
        past = end if is_quoted(text, literals) else low
        if literals or names:
            out += [(t, literals, [*names, t] if keeps else names) for t in targets]
    return out


def final_values(listed: list[tuple[str, list[Piece], list[str]]]) -> dict[str, tuple[list[Piece], list[str]]]:
    """Literals and references of the last assignment of each name, and of those before it that it keeps."""
    last: dict[str, tuple[list[Piece], list[str]]] = {}
    for name, literals, names in listed:
        if name not in names or name not in last:
            last[name] = [], []
        last[name][0].extend(literals)
        last[name][1].extend(names)
    return last


def found_literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitive name.

    An assignment is a node that points to the assignments its names had then; a name that is only set further down,
    as configuration may do in any number of steps, to a node of its last values. From the most sensitive name on,
    every node is visited once, so a literal has the weight of the most sensitive name that it reaches.
    """
    listed = pairs(text)
    later = final_values(listed)
    known: dict[str, int | str] = {}  # the number of an assignment
    weights, refers = [], []
    for n, (name, _, names) in enumerate(listed):
        weights.append(name_weight(name))
        refers.append([known.get(x, x) for x in dict.fromkeys(names)])
        known[name] = n
    best: dict[Piece, float] = {}
    seen: set[int | str] = set()
    for n in sorted((n for n, w in enumerate(weights) if w >= 2), key=lambda n: -weights[n]):
        todo: list[int | str] = [n]
        while todo:
            node = todo.pop()
            if node in seen:
                continue
            seen.add(node)
            literals, more = later.get(node, ((), ())) if isinstance(node, str) else (listed[node][1], refers[node])
            todo += more
            for piece in literals:
                if piece not in best:
                    look = literal_weight(text[slice(*piece)])
                    best[piece] = weights[n] + look if look else 0.0
    return [(a, b, s) for (a, b), s in best.items() if s >= THRESHOLD]


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order: base spans, and literals that no base span covers."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if SIGN.search(text) else []
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted((a, b) for a, _, b in out)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    if SIGN.search(text):
        for start, end, _ in found_literals(text):
            before = bisect_left(starts, end)
            if not before or reach[before - 1] <= start:
                out.append((start, 3, end))
    return sorted(out)


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, found`` with ``found`` an array of (kind, start, end), code points.

    Base kinds are leftmost non-overlapping matches each, those that fail their length dropped; literals that are
    scored by the names they reach come on top. Null text is empty; texts are read whole; repeated rows give equal
    rows; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t)] for t in texts(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "found": found}

    return arrow_map(rows, run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    def text(spans_):
        return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"] != KINDS[3])
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
    )
