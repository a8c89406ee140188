"""Text columns: tokens, lines, links and the cleaning of extracted documents.

Everything here is a Column of built-in functions, so it stays in whole-stage code generation and needs
no Python worker. A null text gives a null (or, for arrays, null) result; an empty text is an empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space and what ends a line, beyond ASCII.
BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: Patterns of lines.
LATIN_TOKEN = r"[a-z0-9][a-z0-9._+-]{1,}"
HAN = r"[\u4e00-\u9fff]"
CJK_RUN = HAN + "+"
PLACEHOLDER = r"(?i)\[TBD|TBD\s*[—-]|\[todo\]|TODO\s*[—-]"
LIST_ITEM = r"^(\s*)([-*+]|\d+[.)])\s"
FENCE = r"^\s{0,3}(`{3,}|~{3,})"
PAGE_KEYWORD = r"(?i)^\s*(?:第\s*\d+\s*页|Page\s*\d+)\s*$"
PAGE_DECORATED = r"^\s*[-–—_·•*]+\s*\d{1,4}\s*[-–—_·•*]+\s*$"
PAGE_BARE = r"^\s*\d{1,4}\s*$"
RULE_LINE = r"^[\s\-\*_#>|~`]+$"
WIKILINK = r"!?\[\[([^\]]*)\]\]"
NOISE_TYPES = ("header", "footer", "page_number")
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "e.g.", "i.e.", "etc.", "vs.", "st.", "no.", "al.")

BOILERPLATE_REPEATS = 3
BOILERPLATE_LENGTH = 4


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once. Inside a lambda, an outer expression would be computed again
    for each element."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lines(text: Column) -> Column:
    """The lines of a text, without their ends; a final line end makes no line of its own."""
    return let(F.split(text, LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def joined(parts: Column, by: str = "\n") -> Column:
    return F.array_join(parts, by)


def tokens(text: Column) -> Column:
    """Terms of the keyword index: Latin and digit words, then the two-letter shingles of Han runs."""
    low = F.lower(text)
    pairs = F.regexp_extract_all(low, F.lit(f"(?=({HAN}{HAN})){HAN}"), F.lit(1))
    return F.concat(F.regexp_extract_all(low, F.lit(f"({LATIN_TOKEN})"), F.lit(1)), pairs)


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), f"{BLANK}+"), lambda w: w != "")


def shingles(word_list: Column, n: int = 4) -> Column:
    """n words each; fewer words make one shingle."""
    many = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return let(word_list, lambda w: F.when(F.size(w) >= n, many(w)).otherwise(F.array(F.array_join(w, " "))))


def placeholder_heavy(text: Column, ratio: float) -> Column:
    """Whether placeholder lines make up at least ratio of the lines that aren't blank."""
    if ratio <= 0:
        return F.lit(False)
    share = lambda full: F.size(F.filter(full, lambda x: x.rlike(PLACEHOLDER))) / F.greatest(F.size(full), F.lit(1))
    heavy = let(F.filter(lines(text), lambda x: stripped(x) != ""), lambda full: (F.size(full) > 0) & (share(full) >= ratio))
    return F.coalesce(heavy, F.lit(False))


# Front matter

#: A key with the value behind it and the list items below it, blank lines between them.
_INLINE = r"[\s&&[^\n]]"
_ENTRY = rf"(?mU)^%s:{_INLINE}*(.*(?:\n{_INLINE}*$|\n{_INLINE}+-{_INLINE}+.*)*+)"
_PLAIN = r"(?s)^\s*\"*'*\s*(.*?)\s*'*\"*\s*$"


def _header_end(text: Column) -> Column:
    """Where the line that closes a front matter begins (0: there is none)."""
    return F.when(F.startswith(text, F.lit("---")), F.locate("\n---", text, 4)).otherwise(F.lit(0))


def front_header(text: Column) -> Column:
    """The lines between the two rules, or an empty text."""
    header = let(_header_end(text), lambda end: F.when(end > 0, F.substr(text, F.lit(4), end - 4)).otherwise(F.lit("")))
    return joined(lines(header))


def front_body(text: Column) -> Column:
    """What follows the front matter, or the whole text."""
    return let(_header_end(text), lambda end: F.when(end > 0, F.substr(text, end + 4)).otherwise(text))


def _plain(value: Column) -> Column:
    return F.regexp_extract(value, _PLAIN, 1)


def _entry_value(entry: Column) -> Column:
    """Of what stands behind a key: its values, in brackets or a line each, joined by commas."""
    first, items = _plain(F.substring_index(entry, "\n", 1)), F.regexp_extract_all(entry, F.lit(rf"(?mU)^{_INLINE}+-{_INLINE}+(.*)$"), F.lit(1))
    listed = lambda v: F.split(F.substr(v, F.lit(2), F.length(v) - 2), ",")
    inline = let(first, lambda v: F.when((F.length(v) > 1) & v.startswith("[") & v.endswith("]"), F.transform(listed(v), _plain)).otherwise(F.array(v)))
    return F.array_join(F.filter(F.concat(inline, F.transform(items, _plain)), lambda v: v != ""), ", ")


def front_field(text: Column, key: str) -> Column:
    """The value of a key in the front matter (the last, if there are several), or an empty text."""
    found = let(front_header(text), lambda h: F.regexp_extract_all(h, F.lit(_ENTRY % key), F.lit(1)))
    return F.when(F.startswith(text, F.lit("---")), let(found, lambda x: F.when(F.size(x) > 0, _entry_value(F.get(x, F.size(x) - 1))).otherwise(F.lit("")))).otherwise(F.lit(""))


def front_fields(text: Column) -> Column:
    """All keys and values of the front matter, as an array of (key, value) in their order."""
    pair = lambda e: F.struct(F.regexp_extract(e, r"^([^:]*):", 1).alias("key"), _entry_value(F.regexp_replace(e, r"^[^:]*:", "")).alias("value"))
    entry = "(?mU)(" + (_ENTRY % r"[\w-]+").removeprefix("(?mU)").replace("*(.*", "*(?:.*") + ")"
    every = F.transform(F.regexp_extract_all(front_header(text), F.lit(entry), F.lit(1)), pair)
    return let(every, lambda x: F.filter(x, lambda p, i: ~F.exists(F.slice(x, i + 2, F.size(x)), lambda q: q["key"] == p["key"])))


# Wiki links


def _target(link: Column) -> Column:
    """Of a link's inside: the note's name, without alias, anchor and folder."""
    inside = F.replace(link, F.lit("\\|"), F.lit("|"))
    head = stripped(F.substring_index(stripped(F.substring_index(inside, "|", 1)), "#", 1))
    return stripped(F.substring_index(head, "/", -1))


def wikilink_targets(text: Column) -> Column:
    """Distinct names that a text links to, sorted; embeds and links within the text don't count."""
    links = F.filter(F.regexp_extract_all(text, F.lit(r"(!?\[\[[^\]]*\]\])"), F.lit(1)), lambda x: ~x.startswith("!"))
    heads = F.transform(links, lambda x: F.regexp_extract(x, r"^\[\[([^\]]*)\]\]$", 1))
    named = F.filter(heads, lambda x: stripped(F.substring_index(stripped(F.substring_index(F.replace(x, F.lit("\\|"), F.lit("|")), "|", 1)), "#", 1)) != "")
    return F.array_sort(F.array_distinct(F.transform(named, _target)))


def clean_wikilinks(text: Column) -> Column:
    """Links as a reader sees them: alias, else name, else anchor; embeds and block anchors vanish."""
    parts = F.split(text, r"(?=!\[\[[^\]]*\]\])|(?<!!)(?=\[\[[^\]]*\]\])|(?<=\]\])", -1)

    def shown(part: Column) -> Column:
        inside = F.replace(F.regexp_extract(part, r"^\[\[([^\]]*)\]\]$", 1), F.lit("\\|"), F.lit("|"))
        sides = F.split(inside, r"\|", -1)
        target = stripped(F.element_at(sides, 1))
        head = stripped(F.substring_index(target, "#", 1))
        anchor = F.when(F.contains(target, F.lit("#")), stripped(F.regexp_replace(target, r"^[^#]*#", ""))).otherwise(F.lit(""))
        plain = F.when(head != "", stripped(F.substring_index(head, "/", -1))).when(anchor.startswith("^"), F.lit("")).otherwise(anchor)
        return F.when(F.size(sides) > 1, stripped(F.get(sides, F.lit(1)))).otherwise(plain)

    whole = lambda p: p.rlike(r"^!?\[\[[^\]]*\]\]$")
    return F.array_join(F.transform(parts, lambda p: F.when(~whole(p), p).when(p.startswith("!"), F.lit("")).otherwise(shown(p))), "")


# Images


def strip_dead_images(text: Column) -> Column:
    """Images that point to local files become their alternative text; remote and inline ones stay."""
    local = F.regexp_replace(text, r"(?i)!\[\s*([^\]]*?)\s*\]\((?!\s*(?:https?://|data:))[^)]+\)", "$1")
    quoted = F.regexp_replace(local, r"(?i)<img\b[^>]*?alt\s*=\s*(?:\"\s*([^\">]*?)\s*\"|'\s*([^'>]*?)\s*'|([^\s>\"']+))[^>]*>", "$1$2$3")
    return F.regexp_replace(quoted, r"(?i)<img\b[^>]*>", "")


#: Inline tags, by the Markdown sign that stands for them.
INLINE_TAGS = {"**": ("b", "strong"), "*": ("i", "em"), "`": ("code", "kbd"), "": ("u", "s", "del", "ins", "sub", "sup", "mark", "small", "span")}


def inline_html_as_markdown(text: Column) -> Column:
    """For a preview: bold, italics and code as Markdown, other inline tags dropped."""
    for sign, tags in INLINE_TAGS.items():
        tag = f"</?(?:{'|'.join(tags)})" + (">" if sign else "[^>]*>")
        text = F.regexp_replace(text, f"`?{tag}`?" if sign == "`" else tag, sign)
    return text


# Lines that repeat on every page


def strip_sidecar_noise(text: Column, blocks: Column) -> Column:
    """Drops lines that equal a block (type, text, ...) which the extractor marked as page furniture."""
    noise = F.filter(F.transform(F.filter(blocks, lambda b: b["type"].isin(*NOISE_TYPES)), lambda b: stripped(F.coalesce(b["text"], F.lit("")))), lambda t: t != "")
    return let(noise, lambda n: F.when(F.coalesce(F.size(n), F.lit(0)) > 0, joined(F.filter(lines(text), lambda x: ~F.array_contains(n, stripped(x))))).otherwise(text))


def strip_page_numbers(text: Column) -> Column:
    """Drops page-number lines; bare numbers only if there are two different ones."""
    paged = lambda every: F.size(F.array_distinct(F.transform(F.filter(every, lambda x: x.rlike(PAGE_BARE)), stripped))) >= 2
    kept = lambda every, bare: F.filter(every, lambda x: ~(x.rlike(PAGE_KEYWORD) | x.rlike(PAGE_DECORATED) | (bare & x.rlike(PAGE_BARE))))
    return let(lines(text), lambda every: joined(let(paged(every), lambda bare: kept(every, bare))))


def strip_boilerplate(text: Column, repeats: int = BOILERPLATE_REPEATS) -> Column:
    """Drops plain lines that stand in the text ``repeats`` times or more. Headings, tables, quotes,
    lists, rules, short lines and what is inside fences stay.

    The lines' counts come from sorting the candidates, so a text of n lines costs n log n.
    """

    def fenced(every: Column) -> Column:
        """For each line whether it is a fence or inside one: fences up to and including it, or before it."""
        numbers = F.filter(F.transform(every, lambda x, i: F.when(x.rlike(FENCE), i)), lambda i: i.isNotNull())
        opened = lambda f: F.flatten(F.transform(f, lambda i, k: F.when(k % 2 == 0, F.sequence(i, F.coalesce(F.get(f, k + 1), F.size(every) - 1))).otherwise(F.array().cast("array<int>"))))
        flags = lambda inside: F.transform(every, lambda x, i: F.array_contains(inside, i))
        return let(numbers, lambda f: F.when(F.size(f) > 0, let(opened(f), flags)).otherwise(F.array_repeat(F.lit(False), F.size(every))))

    def key(x: Column, inside: Column) -> Column:
        plain = lambda s: (F.length(s) >= BOILERPLATE_LENGTH) & ~F.left(s, F.lit(1)).isin("#", "|", ">") & ~s.rlike(RULE_LINE) & ~x.rlike(LIST_ITEM)
        return let(stripped(x), lambda s: F.when(~inside & plain(s), s))

    step = repeats - 1
    marked = lambda every: F.zip_with(every, fenced(every), lambda x, f: F.struct(x.alias("line"), key(x, f).alias("key")))
    ordered = lambda m: F.array_sort(F.filter(F.transform(m, lambda r: r["key"]), lambda k: k.isNotNull()))
    often = lambda keys: F.array_distinct(F.filter(keys, lambda s, i: (i >= step) & (F.get(keys, i - step) == s)))
    kept = lambda m, gone: joined(F.transform(F.filter(m, lambda r: r["key"].isNull() | ~F.array_contains(gone, r["key"])), lambda r: r["line"]))
    clean = lambda m: let(let(ordered(m), often), lambda gone: F.when(F.size(gone) > 0, kept(m, gone)).otherwise(text))
    return let(let(lines(text), marked), clean)


# Splitting


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n", -1), stripped), lambda p: p != "")


def is_list(text: Column) -> Column:
    """Whether list items make up at least half of the lines that aren't blank."""
    items = lambda full: F.size(F.filter(full, lambda x: x.rlike(LIST_ITEM)))
    return let(F.filter(lines(text), lambda x: stripped(x) != ""), lambda full: (items(full) >= 1) & (items(full) * 2 >= F.size(full)))


def split_list(text: Column, limit: int) -> Column:
    """Pieces of a list, cut before an item when the piece so far and the item exceed limit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(s: Column, x: Column) -> Column:
        full = s["now"].isNotNull() & (F.length(s["now"]) + F.length(x) > limit) & x.rlike(LIST_ITEM)  # the pattern last, it costs most
        cut = F.struct(F.concat(s["done"], F.array(stripped(s["now"]))).alias("done"), x.alias("now"))
        return F.when(full, cut).otherwise(F.struct(s["done"].alias("done"), F.concat_ws("\n", s["now"], x).alias("now")))

    whole = F.aggregate(lines(text), start, step, lambda s: F.concat(s["done"], F.array(stripped(F.coalesce(s["now"], F.lit(""))))))
    return F.filter(whole, lambda p: p != "")


def sentences(text: Column) -> Column:
    """Sentences; a full stop within an abbreviation ends none."""
    guarded = text
    for short in sorted({a for x in ABBREVIATIONS for a in (x, x.capitalize())}):
        guarded = F.replace(guarded, F.lit(" " + short), F.lit(" " + short.replace(".", "\x00")))
    parts = F.split(guarded, rf"(?<=[。！？]){BLANK}*|(?<=[.!?]){BLANK}+(?=[A-Z0-9])", -1)
    return F.filter(F.transform(parts, lambda p: stripped(F.replace(p, F.lit("\x00"), F.lit(".")))), lambda p: p != "")


def pack_sentences(text: Column, limit: int) -> Column:
    """Sentences packed into pieces of up to limit characters; a longer sentence stays whole. Each piece
    but the last keeps the space after its last sentence."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, x: Column) -> Column:
        full = (s["now"] != "") & (F.length(s["now"]) + F.length(x) > limit)
        cut = F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), F.concat(x, F.lit(" ")).alias("now"))
        return F.when(full, cut).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], x, F.lit(" ")).alias("now")))

    return F.aggregate(sentences(text), start, step, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(stripped(s["now"])))).otherwise(s["done"]))


def context(parts: Column) -> Column:
    """Parts joined by slashes: blank ones and, whatever their case, repeated ones left out."""
    clean = F.filter(F.transform(parts, lambda p: stripped(F.coalesce(p, F.lit("")))), lambda p: p != "")
    first = lambda parts, low: F.filter(parts, lambda p, i: F.array_position(low, F.lower(p)) == i + 1)
    return let(clean, lambda parts: let(F.transform(parts, lambda p: F.lower(p)), lambda low: F.array_join(first(parts, low), " / ")))


def truncate_at_line(text: Column, limit: int, mark: str, slack: int = 300) -> Column:
    """A long text cut at limit, at a line end if there is one within slack before or after."""
    head = F.substring(text, 1, limit)
    before = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1
    after = F.locate("\n", text, limit + 1) - 1
    cut = F.when((before > 0) & (limit - before <= slack), F.substr(text, F.lit(1), before)).when((after >= limit) & (after - limit <= slack), F.substr(text, F.lit(1), after)).otherwise(head)
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("\n" + mark))).otherwise(text)


def table_markdown(cells: Column) -> Column:
    """An array of rows of cells as a pipe table: empty rows go; a first row that isn't empty gets a rule."""
    clean = F.transform(cells, lambda row: F.transform(row, lambda c: F.replace(F.replace(stripped(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))))
    full = lambda row: F.exists(row, lambda c: c != "")
    drawn = F.transform(F.filter(clean, full), lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.element_at(clean, 1))))
    headed = F.concat(F.slice(drawn, 1, 1), F.array(rule), F.slice(drawn, F.lit(2), F.size(drawn)))
    return F.when(F.size(clean) == 0, F.lit("")).when(full(F.element_at(clean, 1)), F.array_join(headed, "\n")).otherwise(F.array_join(drawn, "\n"))


def title_key(title: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), BLANK, ""))


def stem(path: Column) -> Column:
    """The file name without its last suffix; a name that only begins with a dot has no suffix."""
    return F.regexp_replace(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r".\.([^.]*)$", 1))
