"""Secret scans by assignment-aware lexing.

Three base patterns find assignments to a few names, access keys and long hexadecimal strings. The
lexer adds what they miss. It reads name-literal pairs from source and configuration syntax:

* ``a = "x"``, ``a: x``, ``"a": "x"``, ``a => 'x'``, ``export A=x``, ``a: type = "x"``, ``b["a"] = "x"``;
* elements ``<a>x</a>`` and attributes ``a="x"``, also ``<add key="a" value="x"/>``;
* values that begin on the next line, stand in brackets or in a call, or go on: ``a = ("x"``, ``a: ["x",
  "y"]``, ``a = f("x")``, ``a = b + "x"``, ``a = "x" "y"``; calls ``set_a("x")`` name their literals;
* triple-quoted strings, here-documents and block scalars (``a: |``), whose lines are a literal each;
* ``a += "x"``, ``a = b or "x"``, ``a = b || "x"``, ``a = getenv("b", "x")``, ``a = getenv("b") or "x"``;
* options of commands, ``--a x``; names in quotes, ``a = "${b}"``, stand for their literal.

It propagates constants: a name given to another name stands for the literal it was last given, in the
block where it was given and the blocks inside (a block ends at a line that is indented less); in
``a = b = "x"`` the literal is given to both. Values are read for pairs of their own: ``log: a=x``,
``b = "a=x"``; those in quotes or comments give no constants. Each literal is scored by how sensitive the
names are that it reaches. It counts if the name is sensitive and the literal looks like a secret: 8 or
more characters, no white space, letters and digits mixed or high entropy. A literal ends with its quote
(not one behind a backslash), a bare one at white space, a quote or one of ``,;(){}<>``; names and
literals may have any length.

Defined results: a null text counts as empty; texts are read whole, whatever their length; spans are in
code points, end exclusive, by start, then kind, then end, each once; repeated rows give repeated
results; an empty table an empty result. Other columns are kept in a struct, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, whole_row

KINDS = ("assign", "access", "hex", "lexed")
#: The base patterns. ASCII: letters in either case are A-Z and a-z only.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

#: Parts of names and how sensitive they make them.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "privatekey": 3,
    "accesskey": 3, "credential": 3, "credentials": 3, "auth": 2, "bearer": 2, "signature": 2, "private": 1, "access": 1, "key": 2, "api": 1,
}
SCORE = 3
LEXED_LEAST = 8
ENTROPY = 3.0  # bits a character

# Possessive repeats: every character is tried once, however long names and literals are.
_NAME = r"[A-Za-z_][A-Za-z0-9_.$-]*+"
#: A name and an operator; the value is read apart, so that a pair in it is found too.
_HEAD = re.compile(rf"(?<![A-Za-z0-9_.$-])[0-9.$-]*+({_NAME})(?:\\?[\"'])?+[ \t]*+\]?+\??+[ \t]*+(:=|=>|\+=|\?=|\|\|=|={{1,3}}|:)[ \t]*+")
#: What is assigned: a quoted literal, a bare one, or another name (the last group).
_VALUE = re.compile(
    r"(?:[A-Za-z@$]{1,2}(?=[\"']))?(?:\"((?:[^\"\\\n]++|\\.)++)\"|\"([^\"\n]++)\"|'((?:[^'\\\n]++|\\.)++)'|'([^'\n]++)')|\\\"([^\"\\\n]++)\\\"|`([^`\n]++)`|([^\s\"'`,;(){}<>]++)"
)
_BARE = _VALUE.groups
PREFIX = 2  # the most characters before a quote that belong to it
_TYPE = rf"[&*]*+(?:'[a-z]++[ \t]++)?+{_NAME}(?:[\[<][A-Za-z0-9_.,|?&<>\[\] \t]*[\]>])?"
_ANNOTATION = re.compile(rf"{_TYPE}(?:[ \t]*+\|[ \t]*+{_TYPE})*+[ \t]*+=(?!=)[ \t]*+")
_ELEMENT = re.compile(rf"<({_NAME})>([^<>\s]++)</\1>")
_BARE_NAME = re.compile(rf"\$?\{{?({_NAME})\}}?")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Before a literal that isn't right behind the operator: line ends, brackets, the name of a call.
_BEFORE = re.compile(r"(?:[ \t\r\n]|\\\r?\n|[(\[{])*+(?:([A-Za-z_][A-Za-z0-9_.]*+)\(\s*+)?+(?:[A-Za-z@$]{1,2}(?=[\"']))?+(?=[\"'])")
#: Between two literals of one value.
_BETWEEN = re.compile(r"(?:[ \t\r\n]|\\\r?\n|[(\[{)\],+.])*+(?:[A-Za-z_][A-Za-z0-9_.]*+[ \t]*+\+[ \t\r\n]*+)*+(?:[A-Za-z@$]{1,2}(?=[\"']))?+(?=[\"'])")
_QUOTED = re.compile(r"\"((?:[^\"\\\n]++|\\.)*+)\"|'((?:[^'\\\n]++|\\.)*+)'")
_ELSE = r"(?:\+|\|\||\?\?|or\b)[ \t\r\n]*+(?=[\"'])"
#: Between a name and a literal that is added to it or stands in for it; the same behind a call that looks a name
#: up, or the call's second argument.
_PLUS = re.compile(rf"[ \t]*+{_ELSE}")
_DEFAULT = re.compile(rf"(?:\"[^\"\n]*+\"|'[^'\n]*+')\s*+(?:,\s*+(?=[\"'])|[)\]][ \t]*+{_ELSE})")
_REFERENCE = re.compile(rf"\$\{{?({_NAME})\}}?")
#: An option of a command and its value: quoted, or bare.
_OPTION = re.compile(r"(?<![^\s\"'`(\[])--([A-Za-z][A-Za-z0-9_.-]*+)[ \t]++(?!-)(?:\"([^\"\n]++)\"|'([^'\n]++)'|([^\s\"'`,;(){}<>|&]++))")
_HEREDOC = re.compile(r"(?:\$\(cat[ \t]++)?<<[-~]?[\"']?([A-Za-z_][A-Za-z0-9_]*+)[\"']?[ \t]*+\r?\n")
_MARK_LINE = re.compile(r"^[ \t]*+([A-Za-z_][A-Za-z0-9_]*+)[ \t]*+\r?$", re.M)
_AFTER = re.compile(r"[ \t]*+[:=]")  # a literal that is a name itself
_CALL = re.compile(rf"(?<![A-Za-z0-9_.$-])({_NAME})\([ \t\r\n]*+(?=[\"'])")
_TAG = re.compile(r"<[A-Za-z_][^<>]*+>")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][A-Za-z0-9_:.-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)')")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[ \t]*+\r?\n")
_LINE = re.compile(r"([ \t]*+)([^\r\n]*+)\r?\n?")
_INDENT = re.compile(r"[ \t]*+")
_COMMENT = re.compile(r"(?:^|(?<=\s))(?:#|//|--|;)|/\*|<!--")
#: Calls whose literal is a name, and attributes that hold a name or a value.
LOOKUPS = {"getenv", "get", "env", "environ", "lookup", "getproperty", "require", "import", "include"}
NAME_ATTRIBUTES, VALUE_ATTRIBUTES = {"key", "name", "id"}, {"value", "content"}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def name_score(name: str) -> int:
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    weight = lambda p: SENSITIVE.get(p) or SENSITIVE.get(p.removesuffix("s"), 0)
    return max((sum(map(weight, parts)), *map(weight, pairs)), default=0)


def looks_secret(counts: Counter, length: int) -> bool:
    """counts: how often each character is in the literal."""
    if length < LEXED_LEAST or any(c.isspace() for c in counts):
        return False
    entropy = -math.fsum(n / length * math.log2(n / length) for n in counts.values())
    mixed = any(c.isdigit() for c in counts) and any(c.isalpha() for c in counts)
    return entropy >= ENTROPY and (mixed or length >= 20)


def secret_spans(text: str, spans: Iterable[tuple[int, int]]) -> Iterator[Span]:
    """Those that look like secrets. Values within a bare value end where it does, and are counted once."""
    counts, begin, end = Counter(), -1, -1
    for a, b in sorted(spans, key=lambda s: (s[1], -s[0])):
        if b != end:
            counts, begin, end = Counter(), b, b
        counts.update(text[a:begin])
        begin = a
        if looks_secret(counts, b - a):
            yield "lexed", a, b


class Pair(NamedTuple):
    at: int  # where the name starts
    name: str
    start: int  # of the value
    end: int
    bare: bool
    inner: bool = False  # in a quoted value or a comment
    given: bool = False  # by an operator that assigns, with the value right behind or after a name alone


class _Lines:
    """Where a text's lines begin, how far they are indented and which parts are comments. Positions are
    asked for in rising order, so that each character is looked at once."""

    def __init__(self, text: str):
        self.text, self.seen, self.next, self.comment, self.indent = text, 0, -1, False, 0

    def to(self, at: int) -> None:
        if self.next < 0 or self.next < at:
            self.seen = max(self.seen, self.text.rfind("\n", self.seen, at) + 1)
            self.comment, self.indent = False, len(_INDENT.match(self.text, self.seen)[0])
            end = self.text.find("\n", at)
            self.next = len(self.text) if end < 0 else end
        if not self.comment:
            self.comment = bool(_COMMENT.search(self.text, self.seen, at))
        self.seen = max(self.seen, at)


def _lines_of(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The spans of the lines between start and end, without the white space around them."""
    while start < end:
        stop = text.find("\n", start, end)
        stop = end if stop < 0 else stop
        line = text[start:stop]
        if bare := line.strip():
            at = start + line.index(bare[0])
            yield at, at + len(bare)
        start = stop + 1


class _Values:
    """The literals behind an operator, other than one that stands there alone."""

    def __init__(self, text: str):
        self.text, self.open = text, {'"""': True, "'''": True}  # whether any more of them may be closed
        self.marks: dict[str, list[int]] | None = None  # where lines that are a name alone begin
        self.here = 0  # where the last here-document ends

    def triple(self, at: int) -> tuple[list[tuple[int, int]], int] | None:
        """Lines and end of a triple-quoted string that begins at a position."""
        mark = self.text[at : at + 3]
        if not self.open.get(mark):
            return None
        end = self.text.find(mark, at + 3)
        if end < 0:
            self.open[mark] = False
            return None
        return list(_lines_of(self.text, at + 3, end)), end + 3

    def heredoc(self, at: int) -> tuple[list[tuple[int, int]], int] | None:
        """Lines and end of a here-document whose mark is at a position; there are none in another one."""
        m = _HEREDOC.match(self.text, at) if at >= self.here else None
        if not m:
            return None
        if self.marks is None:
            self.marks = {}
            for line in _MARK_LINE.finditer(self.text):
                self.marks.setdefault(line[1], []).append(line.start())
        ends = self.marks.get(m[1], [])
        i = bisect_left(ends, m.end())
        if i == len(ends):
            return None
        self.here = ends[i]
        return list(_lines_of(self.text, m.end(), ends[i])), ends[i]

    def block(self, at: int, indent: int) -> Iterator[tuple[int, int]]:
        """The lines of a block scalar whose mark is at a position: those indented more, and empty ones."""
        m = _BLOCK.match(self.text, at)
        at = m.end() if m else len(self.text)
        while at < len(self.text) and (line := _LINE.match(self.text, at)):
            if line[2]:
                if len(line[1]) <= indent:
                    break
                yield line.start(2), line.start(2) + len(line[2].rstrip())
            at = line.end()

    def run(self, at: int, first: bool) -> Iterator[tuple[int, int]]:
        """Quoted literals from a position on, up to what is neither one nor stands between two."""
        text = self.text
        m = (_BEFORE if first else _BETWEEN).match(text, at)
        while m:
            if first and m[1] and m[1].rpartition(".")[2].lower() in LOOKUPS and not (m := _DEFAULT.match(text, m.end())):
                return
            first, at = False, m.end()
            if t := self.triple(at):
                yield from t[0]
                at = t[1]
            elif q := _QUOTED.match(text, at):
                if _AFTER.match(text, q.end()):
                    return
                if q.lastindex:
                    yield q.span(q.lastindex)
                at = q.end()
            else:
                return
            m = _BETWEEN.match(text, at)


def _pairs(text: str) -> Iterator[Pair]:
    quoted = bare = 0  # where the last quoted value and the last bare one end
    lines, values = _Lines(text), _Values(text)
    for m in _HEAD.finditer(text):
        inside = quoted
        lines.to(m.start())
        apart = m.start() < inside or lines.comment or m[2] == "+="
        annotated = a.end() if m[2] == ":" and (a := _ANNOTATION.match(text, m.end())) else None
        for begin in (m.end(), annotated):
            if begin is None:
                continue
            rest: Iterator[tuple[int, int]] = iter(())
            if begin < bare - PREFIX:  # a bare value in another ends with it
                span, is_bare = (begin, bare), True
            elif t := values.triple(begin) or values.heredoc(begin):
                for k, line in enumerate(t[0]):
                    yield Pair(m.start(1), m[1], *line, False, apart or k > 0)
                quoted = max(quoted, t[1])
                continue
            elif m[2] == ":" and _BLOCK.match(text, begin):
                for line in values.block(begin, lines.indent):
                    yield Pair(m.start(1), m[1], *line, False, True)
                continue
            elif (v := _VALUE.match(text, begin)) and (v.lastindex != _BARE or text[begin] not in "[\\" and text[v.end() : v.end() + 1] != "("):
                span, is_bare = v.span(v.lastindex), v.lastindex == _BARE
                bare, quoted = (v.end(), quoted) if is_bare else (bare, max(quoted, v.end()))
                if not is_bare:
                    rest = values.run(v.end(), False)
                elif plus := _PLUS.match(text, v.end()):
                    rest = values.run(plus.end(), False)
            else:
                for k, literal in enumerate(values.run(begin, True)):
                    yield Pair(m.start(1), m[1], *literal, False, apart or k > 0)
                    quoted = max(quoted, literal[1])
                continue
            near = m.end() == m.end(2) or text[m.start(2) - 1] in " \t"
            yield Pair(m.start(1), m[1], *span, is_bare, apart, m[2] in ("=", ":=") and near)
            for literal in rest:
                yield Pair(m.start(1), m[1], *literal, False, True)
                quoted = max(quoted, literal[1])


def _calls(text: str) -> Iterator[Pair]:
    values = _Values(text)
    for m in _CALL.finditer(text):
        if m[1].rpartition(".")[2].lower() not in LOOKUPS:
            for literal in values.run(m.end(), False):
                yield Pair(m.start(1), m[1], *literal, False, True)


def _options(text: str) -> Iterator[Pair]:
    """Options of commands whose value is their next word."""
    for m in _OPTION.finditer(text):
        yield Pair(m.start(1), m[1], *m.span(m.lastindex), False, True)


def _tags(text: str) -> Iterator[Pair]:
    """Attributes that are named by another one."""
    for tag in _TAG.finditer(text):
        found = [(m[1].lower(), m.span(m.lastindex)) for m in _ATTRIBUTE.finditer(text, *tag.span()) if m.lastindex > 1]
        names = [span for name, span in found if name in NAME_ATTRIBUTES]
        for a, b in (span for name, span in found if name in VALUE_ATTRIBUTES):
            for x, y in names[:1]:
                yield Pair(tag.start(), text[x:y], a, b, False, True)


class _Scopes:
    """Literals of names. A block ends at a line that is indented less."""

    def __init__(self):
        self.open: list[list] = [[0, True]]  # (indentation, whether it is still open)
        self.known: dict[str, list[tuple[list, tuple[int, int]]]] = {}

    def at(self, indent: int) -> None:
        while self.open[-1][0] > indent and len(self.open) > 1:
            self.open.pop()[1] = False
        if self.open[-1][0] < indent:
            self.open.append([indent, True])

    def get(self, name: str) -> tuple[int, int] | None:
        found = self.known.get(name, [])
        while found and not found[-1][0][1]:
            found.pop()
        return found[-1][1] if found else None

    def put(self, name: str, span: tuple[int, int]) -> None:
        found = self.known.setdefault(name, [])
        if found and found[-1][0] is self.open[-1]:
            found.pop()
        found.append((self.open[-1], span))


def lexed_spans(text: str) -> list[Span]:
    """Literals whose own or propagated names are sensitive."""
    pairs: list[Pair] = []
    if "=" in text or ":" in text:
        pairs += _pairs(text)
    if '("' in text or "('" in text or "( " in text or "(\n" in text:
        pairs += _calls(text)
    if "--" in text:
        pairs += _options(text)
    if "<" in text and ">" in text:
        pairs += _tags(text)
        pairs += [Pair(m.start(1), m[1], *m.span(2), False) for m in _ELEMENT.finditer(text)]
    pairs.sort(key=lambda p: p.at)
    scopes, lines = _Scopes(), _Lines(text)
    score: dict[tuple[int, int], int] = {}
    chain: list[Pair] = []
    for i, pair in enumerate(pairs):
        span = (pair.start, pair.end)
        if i + 1 < len(pairs) and pair.bare and pairs[i + 1].at == pair.start and pairs[i + 1].given:
            score[span] = max(score.get(span, 0), name_score(pair.name))
            chain.append(pair)
            continue
        lines.to(pair.at)
        scopes.at(lines.indent)
        if (m := (_BARE_NAME if pair.bare else _REFERENCE).fullmatch(text, *span)) and (known := scopes.get(m[1])):
            span = known
        for p in (pair, *chain):
            if not p.inner:
                scopes.put(p.name, span)
            score[span] = max(score.get(span, 0), name_score(p.name))
        chain = []
    return list(secret_spans(text, [span for span, s in score.items() if s >= SCORE]))


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by start, then kind. A literal that a base span covers isn't added."""
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (s[1], rank[s[0]], s[2])
    base = sorted(base_spans(text), key=order)
    added, i, reach = [], 0, -1
    for span in sorted(lexed_spans(text), key=order):
        while i < len(base) and base[i][1] <= span[1]:
            reach = max(reach, base[i][2])
            i += 1
        if span[2] > reach:
            added.append(span)
    return base, sorted(base + added, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, every = [], []
        for t in batch.column(1):
            b, e = all_spans(t.as_py() or "")
            base.append([{"kind": k, "start": a, "end": z} for k, a, z in b])
            every.append([{"kind": k, "start": a, "end": z} for k, a, z in e])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(every, kind)], ["_row", "base", "spans"])


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each row: _row (the other columns), base and spans, arrays of (kind, start, end)."""
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    rows = docs.select(whole_row(rest), F.col(text).alias("text"))
    span = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(_scan, f"_row {rows.schema['_row'].dataType.simpleString()}, base {span}, spans {span}")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """op6: numbers and digests of the secrets in every document."""
    found = scan_secrets(documents(spark, sf_dir, "doc_id", "text"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("_row.doc_id", number("assign"), number("access"), number("hex"), F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
