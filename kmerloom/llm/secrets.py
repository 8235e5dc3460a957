"""Secret scans by assignment-aware lexing.

Source and configuration syntax is lexed into pairs of a name and an expression: ``name = "x"``, ``name: type = "x"``, ``"name": "x"``, ``d["name"] = "x"``,
``NAME := x``, ``name => x``, ``put("name", "x")``, ``<name>x</name>``, ``--name x``, with the names of the braces, indented keys or
section that a pair stands in. Expressions are literals (with escapes, triple quotes, prefixes) and references, alone, joined by an operator or
passed through calls, however deep. Constants are propagated to a fixed point: a name is as sensitive as the most sensitive name
whose expression refers to it, wherever in the text either stands. A literal is scored by the names that it
reaches, and where they say little by its own make-up; what a name stands for in the end is scored as one. Fixed patterns for assignments, access keys and hexadecimal
runs make up the base; what the lexer adds is reported beside them under the kind ``lexed``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns of the scan, their least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "lexed")

#: How much a part of a name says that its value is secret; 1 is enough by itself.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "auth": 0.6, "private": 0.5, "access": 0.4, "api": 0.4,
    "key": 0.5, "signing": 0.4, "encryption": 0.4, "client": 0.2, "pass": 0.8, "pin": 0.5, "salt": 0.6, "mnemonic": 0.9,
}
#: Names that say nothing by themselves: their pair counts under the name that they stand in.
NEUTRAL = frozenset("value val data text string content default key name id".split())
#: From this sensitivity on a quoted literal needs only length.
SURE = 0.9
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|none|null|true|false|undefined|todo|changeme|change_me|redacted|your.*|example.*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*)$")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

_HEAD = re.compile(
    r"""(?P<brace>[{}])
    |^[\x20\t]*\[(?P<section>[A-Za-z_][\w.\x20:-]*+)\][\x20\t\r]*$
    |<(?P<tag>[A-Za-z_][\w.:-]*+)(?:[\x20\t][^<>\n]*+)?>(?=[^<\s])
    |(?<![\w-])--(?P<flag>[A-Za-z][\w-]*+)(?:=|[\x20\t]++)(?=["'$A-Za-z0-9+/_.])
    |\(\s*+(?:[\w.$]++\s*+,\s*+)?(?P<quote>["'])(?P<arg>[A-Za-z_$][\w$.-]*+)(?P=quote)\s*+,\s*+
    |(?<![\w$.-])(?P<name>[A-Za-z_$][\w$.-]*+)(?P<closing>["'`]?)[\x20\t]*+\]?[\x20\t]*+
        (?::[\x20\t]*+[A-Za-z_][\w.,\x20|\[\]]*+(?==(?!=)))?(?P<op>:=|=>|=(?!=)|:(?!:|//))[\x20\t]*+
    """,
    re.VERBOSE | re.ASCII | re.MULTILINE,
)
_QUOTED = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\.)*+){q}") for q in "\"'`"}
_PREFIX = re.compile(r"[rRbBuUfF]{1,2}(?=[\"'])")
_REFERENCE = re.compile(r"\$\{?([A-Za-z_]\w*+)\}?|%\(([A-Za-z_]\w*+)\)s|\{\{[\x20\t]*+([A-Za-z_][\w.]*+)[\x20\t]*+\}\}", re.ASCII)
_IN_BRACES = re.compile(r"\{[\x20\t]*([A-Za-z_][\w.]*)[^{}\n]*\}", re.ASCII)
#: A bare word has at most two = within; in a longer run each name = begins a word of its own, which the one before it refers to.
_BARE = re.compile(r"[A-Za-z0-9+/_.-]*+(?:=++[A-Za-z0-9+/_.-]++){0,2}+=*+")
_CHAINED = re.compile(r"=*+([A-Za-z_$][\w$.-]*+)=")
_CALL = re.compile(r"([A-Za-z_$][\w$.]*+)\(\s*+", re.ASCII)
_COMMA = re.compile(r"\s*+,\s*+")
_BLANK = re.compile(r"\s*+")
_JOINER = re.compile(r"[\x20\t]*+(?:\+|\.\.|\|\||&|\x20\.(?=\x20))[\x20\t]*+(?:\r?\n[\x20\t]*+)?")
_SPACE = re.compile(r"[\x20\t]*+(?:\\\r?\n[\x20\t]*+)?")
_INDENT = re.compile(r"[\x20\t]*(?:-[\x20\t]+)?")


class Pair(NamedTuple):
    """A name, how sensitive the names that it stands in are, and its expression: spans of literals, the literal's own text, whether it is quoted; and references."""

    name: str
    around: float
    literals: list[tuple[int, int, str, bool]]
    references: list[str]


def name_score(name: str) -> float:
    """Sensitivity of a name: the sum over its parts, at most 1."""
    return min(1.0, sum(SENSITIVE.get(part.lower(), 0.0) for part in _WORD.findall(name)))


class Make(NamedTuple):
    """What of a value its score rests on: its length, how often it has each character (those beyond ASCII by their last seven bits), its spaces, its first
    characters and its last ones, and whether all of it is quoted."""

    size: int
    counts: np.ndarray
    spaces: int
    begin: str
    end: str
    quoted: bool

    @classmethod
    def of(cls, value: str, quoted: bool) -> Make:
        codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
        return cls(len(value), np.bincount(codes & 127, minlength=128).astype(float), value.count(" "), value[:64], value[-64:], quoted)

    def then(self, more: Make) -> Make:
        size = min(self.size + more.size, 1 << 40)  # a name that doubles itself again and again
        counts = self.counts + more.counts
        return Make(size, counts if size < 1 << 40 else counts * 0.5, min(self.spaces + more.spaces, size), (self.begin + more.begin)[:64], (self.end + more.end)[-64:], self.quoted and more.quoted)


_NOTHING = Make(0, np.zeros(128), 0, "", "", True)
_DIGITS, _LETTERS = (np.array([f(chr(k)) for k in range(128)]) for f in (str.isdigit, str.isalpha))


def make_score(make: Make, sensitivity: float = 0.0) -> float:
    """literal_score of a value by its make-up."""
    some = make.counts > 0
    if make.size < 8 or some.sum() < 4 or _PLACEHOLDER.match(make.begin if make.size <= 64 else make.begin + make.end):
        return 0.0
    if make.quoted and sensitivity >= SURE:
        return 1.0 if make.spaces <= make.size // 4 else 0.0
    if make.spaces:
        return 0.0
    share = make.counts[some] / make.counts.sum()
    mixed = int((some & _DIGITS).any()) + int((some & _LETTERS).any()) + int((some & ~_DIGITS & ~_LETTERS).any())
    return min(1.0, float(-(share * np.log2(share)).sum()) / 4) * (0.6 + 0.2 * mixed if mixed > 1 else 0.5)


def literal_score(value: str, quoted: bool = False, sensitivity: float = 0.0) -> float:
    """0 to 1: a quoted literal under a name that is sure to be sensitive needs length alone, others are judged by
    their length, character entropy and mix; placeholders score 0, and so does prose, unless it is quoted for such a name."""
    if len(value) < 8 or _PLACEHOLDER.match(value) or len(set(value)) < 4:
        return 0.0
    if quoted and sensitivity >= SURE:
        return 1.0 if value.count(" ") <= len(value) // 4 else 0.0
    if " " in value:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = any(c.isdigit() for c in value) + any(c.isalpha() for c in value) + any(not c.isalnum() for c in value)
    return min(1.0, entropy / 4) * (0.6 + 0.2 * mixed if mixed > 1 else 0.5)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


class Lexer:
    """Pairs of a text, in one pass over it; an expression is read once for each pair that it belongs to."""

    def __init__(self, text: str):
        self.text = text
        self.inner: dict[int, int | None] = {}
        self.triples = {q: [m.start() for m in re.finditer(q * 3, text)] for q in "\"'" if q * 3 in text}

    def _string(self, at: int) -> tuple[int, int, int, str] | None:
        """(start, end, where to go on, prefix) of the literal at a place."""
        prefix = m[0] if (m := _PREFIX.match(self.text, at)) else ""
        at += len(prefix)
        q = self.text[at : at + 1]
        if q not in _QUOTED or not q:
            return None
        if self.text.startswith(q * 3, at) and q in self.triples:
            places = self.triples[q]
            k = bisect_left(places, at + 3)
            if k < len(places):
                return at + 3, places[k], places[k] + 3, prefix
        m = _QUOTED[q].match(self.text, at)
        return (*m.span(1), m.end(), prefix) if m else None

    def _unwrapped(self, at: int) -> int | None:
        """Where what is passed through the calls and brackets at a place begins; None if they look something up without saying what stands for it.

        However many there are, a place is looked at once for all expressions that come by it."""
        text, passed = self.text, []
        while at not in self.inner:
            passed.append(at)
            if text.startswith("(", at):
                at = _BLANK.match(text, at + 1).end()
            elif m := _CALL.match(text, at):
                at = m.end()
                if m[1].rpartition(".")[2].lower() in ("getenv", "get", "env") and (s := self._string(at)):  # a name, and then what stands for it
                    if not (rest := _COMMA.match(text, s[2])):
                        self.inner[passed[-1]] = None
                        at = passed.pop()
                        break
                    at = rest.end()
            else:
                self.inner[at] = at
                passed.pop()
        for place in passed:
            self.inner[place] = self.inner[at]
        return self.inner[at]

    def expression(self, start: int, known_tag: str | None = None) -> tuple[list[tuple[int, int, str, bool]], list[str]]:
        """Literals and references of the expression at a place."""
        text, references = self.text, []
        literals: list[tuple[int, int, list[str], bool]] = []

        def done() -> tuple[list[tuple[int, int, str, bool]], list[str]]:
            return [(a, b, "".join(parts), quoted) for a, b, parts, quoted in literals], references

        at = self._unwrapped(start)
        if at is None:
            return [], []
        wrapped = at > start
        gap = _BLANK if wrapped else _SPACE
        joined = further = False
        while True:
            if wrapped:
                at = gap.match(text, at).end()
            if s := self._string(at):
                a, b, after, prefix = s
                raw = text[a:b]
                holes = _IN_BRACES if "f" in prefix.lower() else _REFERENCE if text[at + len(prefix)] != "'" else None
                left = raw
                if holes and ("{" in raw or "$" in raw or "%" in raw):
                    references += [next(filter(None, m.groups())) for m in holes.finditer(raw)]
                    left = holes.sub("", raw)
                if left and joined and literals:  # parts in a row are one literal, from the first's start to the last's end
                    first = literals.pop()
                    first[2].append(left)
                    literals.append((first[0], b, first[2], True))
                elif left:
                    literals.append((a, b, [left], True))
                joined = True
                at = after
            elif m := _REFERENCE.match(text, at):
                references.append(next(filter(None, m.groups())))
                at, joined = m.end(), False
            elif (m := _BARE.match(text, at)) and m[0]:
                a, b = m.span()
                if further and "=" in m[0]:  # a pair of its own
                    return done()
                if known_tag and text.startswith("</", b):
                    literals.append((a, b, [m[0]], True))
                    return done()
                if m[0].count("=") > 1 and (chained := _CHAINED.match(text, b)):  # no literal, but pairs in a row
                    references.append(chained[1])
                    return done()
                b -= m[0].endswith(".")
                literals.append((a, b, [text[a:b]], False))
                references.append(text[a:b])
                at, joined = m.end(), False
            else:
                return done()
            further = True
            if joiner := _JOINER.match(text, at):
                at = joiner.end()
            elif not ((near := gap.match(text, at)) and text[near.end() : near.end() + 1] in ('"', "'") and s and self._string(near.end())):
                return done()
            else:
                at = near.end()

    def pairs(self) -> Iterator[Pair]:
        text = self.text
        section, opened, last_score, last = 0.0, [], 0.0, None
        nested: list[tuple[int, float]] = []  # outer keys: their indent, and the most that they and those around them say
        line, line_end, indent, keyed = 0, text.find("\n"), -1, -1
        for m in _HEAD.finditer(text):
            if brace := m["brace"]:
                if brace == "{":
                    opened.append(last_score)
                elif opened:
                    opened.pop()
                last_score = 0.0
                continue
            if m["section"]:
                section, nested = name_score(m["section"]), []
                continue
            name = m["name"] or m["arg"] or m["flag"] or m["tag"]
            own = name_score(name)
            around = max(opened[-1] if opened else 0.0, section)
            if m["name"]:
                while 0 <= line_end < m.start():
                    line, line_end, indent = line_end + 1, text.find("\n", line_end + 1), -1
                if indent < 0:
                    indent = _INDENT.match(text, line).end()
                begins = indent >= m.start() - 1 - (text[m.start() - 1 : m.start()] in "\"'")
                if begins and line != keyed:  # a key at the start of its line stands in those before it with less indent
                    keyed, depth = line, indent - line
                    while nested and nested[-1][0] >= depth:
                        nested.pop()
                    outer = nested[-1][1] if nested else 0.0
                    around = max(around, outer)
                    if m["op"] == ":" and text[m.end() : m.end() + 1] in ("", "\n", "\r", "{"):
                        nested.append((depth, max(outer, own, around if name.lower() in NEUTRAL else 0.0)))
            last_score = own
            literals, references = self.expression(m.end(), m["tag"])
            if literals or (references and (name, references) != last):  # the same again says nothing new
                last = None if literals else (name, references)
                yield Pair(name, around if name.lower() in NEUTRAL else 0.0, literals, references)


def _values(own: list[list[tuple[int, int, str, bool]]], refers: list[list[str]], by_name: dict[str, list[int]], roots: list[int]) -> dict[int, Make]:
    """What the pairs roots stand for in the end: their own literals, then for each name they refer to the longest of that name's values; nothing where that comes back
    to itself. Each name on the way is looked at once."""
    longest: dict[str, Make] = {}
    opened: set[str] = set()

    def value(k: int) -> Make:
        made = _NOTHING
        for _, _, text, quoted in own[k]:
            made = made.then(Make.of(text, quoted))
        for r in refers[k]:
            made = made.then(longest.get(r, _NOTHING))
        return made

    for root in roots:
        todo = list(refers[root])
        while todo:
            r = todo[-1]
            if r not in opened:
                opened.add(r)
                todo += {x for j in by_name[r] for x in refers[j] if x not in opened}
                continue
            todo.pop()
            if r not in longest:
                longest[r] = max((value(j) for j in by_name[r]), key=lambda x: x.size)
    return {k: value(k) for k in roots}


def lexed_spans(text: str, threshold: float = 0.5) -> list[tuple[int, int, int]]:
    """(start, kind, end) of literals that reach a sensitive name, directly or through other names, sorted.

    A pair is as sensitive as its name, as the names that it stands in if its own is neutral, and as the names whose
    expressions refer to it, directly or through others. What it stands for is scored as one; if that reaches threshold, so do all literals that
    it is made of, here and under the names that it refers to. Else each literal is scored by itself.
    """
    low = text.lower()
    if not any(w in low for w in SENSITIVE) or not any(c in text for c in "=:(<-"):
        return []
    pairs = list(Lexer(text).pairs())
    by_name: dict[str, list[int]] = {}
    for k, p in enumerate(pairs):
        by_name.setdefault(p.name, []).append(k)
        if "." in p.name:
            by_name.setdefault(p.name.rpartition(".")[2], []).append(k)
    score = [max(name_score(p.name), p.around) for p in pairs]
    refers = [[r for r in p.references if r in by_name and r != p.name] for p in pairs]
    best: dict[str, float] = {}
    for k in sorted(range(len(pairs)), key=score.__getitem__, reverse=True):  # each name is reached first from the most sensitive pair
        todo = [k]
        while todo:
            for r in refers[todo.pop()]:
                if best.get(r, 0.0) < score[k]:
                    best[r] = score[k]
                    for j in by_name[r]:
                        if score[j] < score[k]:
                            score[j] = score[k]
                            todo.append(j)
    own = [[x for x in p.literals if x[3] or x[2] not in by_name] for p in pairs]  # a bare word that names a pair is a reference
    fired = [False] * len(pairs)
    if roots := [k for k in range(len(pairs)) if score[k] and refers[k]]:
        values = _values(own, refers, by_name, roots)
        told: set[str] = set()
        for k in roots:
            if not fired[k] and score[k] * make_score(values[k], score[k]) >= threshold:
                fired[k], todo = True, [k]
                while todo:
                    for r in refers[todo.pop()]:
                        if r not in told:
                            told.add(r)
                            for j in by_name[r]:
                                if not fired[j]:
                                    fired[j] = True
                                    todo.append(j)
    found: set[tuple[int, int, int]] = set()
    for k in range(len(pairs)):
        if not score[k] or not own[k]:
            continue
        whole = fired[k] or (len(own[k]) > 1 and score[k] * literal_score("".join(x[2] for x in own[k]), all(x[3] for x in own[k]), score[k]) >= threshold)
        for a, b, value, quoted in own[k]:
            if b > a and (whole or score[k] * literal_score(value, quoted, score[k]) >= threshold):
                found.add((a, 3, b))
    return sorted(found)


def scan(text: str, threshold: float = 0.5) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a text, each sorted by start and kind; an added span overlaps no base span and no other."""
    base = sorted(base_spans(text))
    added: list[tuple[int, int, int]] = []
    k, reach = 0, 0  # the base spans that begin before the added one ends, and how far they go
    for a, kind, b in lexed_spans(text, threshold):
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= a and (not added or added[-1][2] <= a):
            added.append((a, kind, b))
    return base, added


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed.

    Spans are in code points, the end exclusive. A null text is the empty text and has no spans; a null id stays
    null; repeated rows are scanned each. Other columns are not read. Texts are scanned whole, a batch at a time,
    in one pass without a shuffle, in time that grows with their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in batch.column(1):
                base, added = scan(text.as_py() or "", threshold)
                kinds = Counter(k for _, k, _ in base)
                row = (kinds[0], kinds[1], kinds[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added)), len(added))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")
