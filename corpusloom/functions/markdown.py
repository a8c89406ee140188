"""Markdown structure: sections and pieces of bounded length, and a preview.

A document is looked at as a whole: one pass finds the marks (headings outside fences), sections are the
slices between them, paragraphs get a kind each, and long ones are filled up to the limit by one greedy
rule. Everything is linear in the length of the text and works on Arrow batches. Front matter and the
rest of the cleaning are columns, see text.py.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from itertools import chain, groupby, pairwise

import pyarrow as pa
from pyspark.sql import functions as F

from .text import ABBREVIATIONS, LIST_ITEM

CHUNK_LIMIT = 600
SHORT_DOCUMENT = 200
TEXTS = 128

#: A fence, or a heading of one of the three levels that split.
_MARK = re.compile(r"^(?:[^\S\n]{0,3}(?P<fence>`{3,}|~{3,})|(?P<signs>#{1,3})[^\S\n]+(?P<title>.+)$)", re.MULTILINE)
_BLANK_LINES = re.compile(r"\n\s*\n")
_ITEM = re.compile(LIST_ITEM, re.MULTILINE)
_STOP = re.compile(r"[。！？]\s*|[.!?]\s+(?=[A-Z0-9])")
_SHORT = re.compile(" (?:" + "|".join(re.escape(a) + "|" + re.escape(a.capitalize()) for a in ABBREVIATIONS) + ")")
TEXT, LIST, TABLE = "text", "list", "table"


def headings(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(begin, end, level, title) of each heading line that no fence holds. A fence is closed by the same
    sign, at least as many times."""
    fence = None
    for m in _MARK.finditer(text):
        if m["fence"] is None:
            if fence is None:
                yield m.start(), m.end(), len(m["signs"]), m["title"].strip()
        elif fence is None:
            fence = m["fence"]
        elif m["fence"].startswith(fence):
            fence = None


def sections(text: str) -> Iterator[tuple[str, str]]:
    """(heading path, body) of each section that has a body."""
    text = "\n".join(text.splitlines())
    path: list[tuple[int, str]] = []
    end_of_text = (len(text), len(text), 0, "")
    for (_, begin, level, title), (end, *_) in pairwise(chain([(0, 0, 0, "")], headings(text), [end_of_text])):
        if level:
            path = [*(x for x in path if x[0] < level), (level, title)]
        if body := text[begin:end].strip():
            yield " / ".join(t for _, t in path), body


def kind_of(text: str) -> str:
    """A table begins with a bar; in a list, items are half of the lines that aren't blank, or more."""
    if text.startswith("|"):
        return TABLE
    lines = [x for x in text.splitlines() if x.strip()]
    items = sum(_ITEM.match(x) is not None for x in lines)
    return LIST if items and 2 * items >= len(lines) else TEXT


def bound_paragraphs(text: str) -> list[str]:
    """Paragraphs, a table with the one before and the one after it, a list with the list before it."""
    groups: list[list[str]] = []
    for p in filter(None, map(str.strip, _BLANK_LINES.split(text))):
        kind = kind_of(p)
        if groups and (kind == TABLE or kind == LIST == kind_of("\n\n".join(groups[-1]))):
            groups[-1].append(p)
        else:
            groups.append([p])
    whole = ["\n\n".join(g) for g in groups]
    ends_in_table = [g.splitlines()[-1].strip().startswith("|") for g in whole]
    out: list[str] = []
    takes_next = False
    for group, table in zip(whole, ends_in_table, strict=True):
        if takes_next:
            out[-1] += "\n\n" + group
        else:
            out.append(group)
        takes_next = table and not takes_next
    return out


def filled(units: list[str], limit: int, opens: Callable[[str], object]) -> Iterator[list[str]]:
    """Consecutive units, each with one sign behind it, in groups of up to limit. A group is closed only
    before a unit that may open one, so it may be longer."""
    begin = size = 0
    for i, unit in enumerate(units):
        if i > begin and size + len(unit) > limit and opens(unit):
            yield units[begin:i]
            begin, size = i, 0
        size += len(unit) + 1
    if units:
        yield units[begin:]


def list_pieces(text: str, limit: int) -> list[str]:
    """A list, cut only before items; line ends between the lines count."""
    groups = filled(text.splitlines(), limit + 1, _ITEM.match)
    return [p for p in ("\n".join(g).strip() for g in groups) if p]


def sentences(text: str) -> list[str]:
    """Sentences; a full stop within an abbreviation ends none."""
    inside = {m.start() + k for m in _SHORT.finditer(text) for k, c in enumerate(m[0]) if c == "."}
    cuts = [m.end() for m in _STOP.finditer(text) if m.start() not in inside]
    return [s for a, b in pairwise([0, *cuts, len(text)]) if (s := text[a:b].strip())]


def sentence_pieces(text: str, limit: int) -> list[str]:
    """Sentences packed up to limit; each piece but the last keeps the space after its last sentence."""
    packed = ["".join(f"{s} " for s in g) for g in filled(sentences(text), limit, lambda _: True)]
    return [*packed[:-1], *(p.strip() for p in packed[-1:])]


def pieces(text: str, limit: int = CHUNK_LIMIT) -> Iterator[tuple[str, str]]:
    """(heading path, piece). Tables are never cut, lists only before an item, sentences never."""
    for heading, body in sections(text):
        for p in bound_paragraphs(body) if len(body) > limit else [body]:
            if len(p) <= limit or any(x.lstrip().startswith("|") for x in p.splitlines()):
                parts = [p]
            else:
                parts = (list_pieces if kind_of(p) == LIST else sentence_pieces)(p, limit)
            yield from ((heading, x) for x in parts)


def document_pieces(title: str, body: str, limit: int = CHUNK_LIMIT, short: int = SHORT_DOCUMENT) -> list[tuple[str, str]]:
    """Of a short document the whole, under its title; else its pieces."""
    return [(title, body)] if len(body) <= short else list(pieces(body, limit))


def _each(kind: str, form: pa.DataType, make: Callable[[str], object]):
    """make of each text; TEXTS of them are Python objects at a time, whatever a batch holds."""
    size = TEXTS

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([make(t or "") for t in texts[i : i + size].to_pylist()], form) for i in range(0, len(texts), size)]
        return pa.concat_arrays(parts) if parts else pa.array([], form)

    return run


def sections_udf():
    form = pa.list_(pa.struct([("heading", pa.string()), ("body", pa.string())]))
    return _each("array<struct<heading:string,body:string>>", form, lambda t: [{"heading": h, "body": b} for h, b in sections(t)])


def bound_paragraphs_udf():
    return _each("array<string>", pa.list_(pa.string()), bound_paragraphs)


def parts_udf(cut: Callable[[str, int], list[str]], limit: int):
    """One of the splitters above as a function of a column."""
    return _each("array<string>", pa.list_(pa.string()), lambda t: cut(t, limit))


_INLINE = re.compile(
    r"`(?P<code>[^`\n]+)`|!\[(?P<image>[^\]]*)\]\([^)]*\)|\[(?P<label>[^\]]+)\]\((?P<url>[^)\s]+)\)|(?P<strong>\*\*|__)(?P<bold>(?:(?!(?P=strong)).)+)(?P=strong)"
    r"|~~(?P<gone>[^~]+)~~|(?<!\w)\*(?P<leaning>[^*\n]+)\*(?!\w)"
)
_SCHEME = re.compile(r"(?:https?|obsidian|mailto):|#|[^:]*$", re.IGNORECASE)
_RULE_ROW = re.compile(r"\s*\|?[\s|:~-]*-[\s|:~-]*$")
_KINDS = (
    ("blank", re.compile(r"\s*$")), ("heading", re.compile(r"\s*(#{1,4})\s+(.*)$")), ("rule", re.compile(r"\s*([-*_]\s*){3,}$")), ("quote", re.compile(r"\s*>\s?(.*)$")),
    ("ul", re.compile(r"\s*[-*+]\s+(.*)$")), ("ol", re.compile(r"\s*\d+[.)]\s+(.*)$")), ("text", re.compile(r"\s*(.*)$")),
)


def _inline(text: str) -> str:
    """Marks inside a line; links only to the web, notes, mail and anchors."""

    def shown(m: re.Match) -> str:
        if m["code"] is not None:
            return f"<code>{escape(m['code'])}</code>"
        if m["image"] is not None:
            return f'<span class="image">{escape(m["image"])}</span>'
        if m["label"] is not None:
            label = _inline(m["label"])
            return f'<a href="{escape(m["url"])}" rel="noreferrer">{label}</a>' if _SCHEME.match(m["url"]) else f"{label} ({escape(m['url'])})"
        tag, inside = ("b", m["bold"]) if m["bold"] is not None else ("del", m["gone"]) if m["gone"] is not None else ("i", m["leaning"])
        return f"<{tag}>{_inline(inside)}</{tag}>"

    out, at = [], 0
    for m in _INLINE.finditer(text):
        out += [escape(text[at : m.start()]), shown(m)]
        at = m.end()
    return "".join([*out, escape(text[at:])])


def _tagged(lines: list[str]) -> Iterator[tuple[str, str]]:
    """(kind, line): fenced lines and table rows first, which hold whatever they hold."""
    fence, table = None, False
    for i, line in enumerate(lines):
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if fence or mark:
            if mark and (not fence or mark[1].startswith(fence)):
                fence = None if fence else mark[1]
                yield "fence", line
            else:
                yield "code", line
            continue
        below = lines[i + 1] if i + 1 < len(lines) else ""
        table = "|" in line and (table or bool(_RULE_ROW.match(below)))
        yield ("table", line) if table else next((kind, line) for kind, form in _KINDS if form.match(line))


def _cells(row: str, tag: str) -> str:
    inner = row.strip().removeprefix("|").removesuffix("|")
    return "<tr>" + "".join(f"<{tag}>{_inline(c.strip().replace(chr(92) + '|', '|'))}</{tag}>" for c in re.split(r"(?<!\\)\|", inner)) + "</tr>"


def to_html(text: str) -> str:
    """A safe preview of Markdown: headings 1 to 4, rules, quotes, lists, tables with a head, fences,
    paragraphs and inline marks. Whatever isn't made here is escaped."""
    form, out = dict(_KINDS), []
    for kind, group in groupby(_tagged(text.splitlines()), key=lambda x: x[0]):
        lines = [line for _, line in group]
        content = [form[kind].match(x)[form[kind].groups] if kind in form and form[kind].groups else x for x in lines]
        if kind == "heading":
            out += [f"<h{n}>{_inline(c.strip())}</h{n}>" for c, n in ((c, len(form[kind].match(x)[1])) for c, x in zip(content, lines, strict=True))]
        elif kind == "rule":
            out += ["<hr/>"] * len(lines)
        elif kind == "quote":
            out.append("<blockquote>" + "<br/>".join(map(_inline, content)) + "</blockquote>")
        elif kind in ("ul", "ol"):
            out.append(f"<{kind}>" + "".join(f"<li>{_inline(c)}</li>" for c in content) + f"</{kind}>")
        elif kind == "table":
            head, _, *rows = [*lines, ""][: max(2, len(lines))]
            out.append(f"<table><thead>{_cells(head, 'th')}</thead><tbody>" + "".join(_cells(r, "td") for r in rows) + "</tbody></table>")
        elif kind == "code":
            out.append("<pre><code>" + escape("\n".join(lines)) + "</code></pre>")
        elif kind == "text":
            out.append("<p>" + "<br/>".join(_inline(c.strip()) for c in content) + "</p>")
    return "\n".join(out)
