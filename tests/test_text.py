"""Text functions against slow versions, and the native and the Python splitters against each other."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import markdown, text


def column(spark, values, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in frame.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


LINES = ["a\nb", "a\r\nb\r", "", "\n", "a\x0bb\x0cc\x1cd\x85e f", "x\n\n", "é\n　"]
PROSE = ["One two. Three four! Five? 6 is. no. e.g. This stays. Dr. Who", "你好。世界！再见？完", "no end", "", "A.  B.\nC.\n\nD", "word " * 300 + ". Next " + "z" * 900 + ". End."]
LISTS = ["- a\n- b\n  more\n1. c\n\n2) d", "- a", "text\n- a", "- " + "x" * 50 + "\n- y\n- z", ""]


def test_lines(spark):
    assert column(spark, LINES, text.lines) == [t.splitlines() for t in LINES]
    assert column(spark, LINES, text.stripped) == [t.strip() for t in LINES]


@pytest.mark.parametrize("limit", [5, 20, 600])
def test_splitters_agree(spark, limit):
    assert column(spark, PROSE, lambda c: text.pack_sentences(c, limit)) == [markdown.sentence_pieces(t, limit) for t in PROSE]
    assert column(spark, LISTS, lambda c: text.split_list(c, limit)) == [markdown.list_pieces(t, limit) for t in LISTS]
    assert column(spark, LISTS, text.is_list) == [markdown.kind_of(t) == markdown.LIST for t in LISTS]
    assert column(spark, PROSE, text.sentences) == [markdown.sentences(t) for t in PROSE]


def slow_boilerplate(t):
    inside, keys = False, []
    for line in t.splitlines():
        s = line.strip()
        fence = re.match(r"^\s{0,3}(`{3,}|~{3,})", line)
        if fence:
            inside = not inside
        skip = fence or inside or len(s) < 4 or re.match(text.RULE_LINE, s) or s[0] in "#|>" or re.match(text.LIST_ITEM, line)
        keys.append(None if skip else s)
    gone = {k for k in keys if k and keys.count(k) >= 3}
    return "\n".join(x for x, k in zip(t.splitlines(), keys, strict=True) if k not in gone) if gone else t


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["head line", " head line ", "```", "~~~", "# head", "- item x", "abc", "body", "", "----", "> quoted"]), max_size=14), min_size=1, max_size=12))
def test_boilerplate(spark, documents):
    texts = ["\n".join(d) for d in documents]
    assert column(spark, texts, text.strip_boilerplate) == [slow_boilerplate(t) for t in texts]


def test_fences():
    doc = "# a\n```\n# x\n~~~\n```\n## b\n~~~~\n# y\n~~~\n# z\n"
    assert list(markdown.sections(doc)) == [("a", "```\n# x\n~~~\n```"), ("a / b", "~~~~\n# y\n~~~\n# z")]
    assert list(markdown.sections("intro\n# only heading\n")) == [("", "intro")]
    assert list(markdown.sections("# a\n### c\nx\n## b\ny")) == [("a / c", "x"), ("a / b", "y")]


FRONT = [
    "---\nt: 'x'\n\nl:\n - a\n\n - \"b\"\nodd line\n - lost\n---\nbody", "---\nnever closed", "plain", "---\nt: a\nt: [b, 'c' , ]\nu: v\n  - w\n---", "---\r\nt: \"two: parts\"\r\n---\r\nrest",
    "---\nt:\nkéy: x\nt : no\n---", "----\nt: x\n---\n", "---t: x\n---", "---\nt: [a\n  -\n  - \n  - b\n---", "",
]


def test_front_matter(spark):
    fields = column(spark, FRONT, text.front_fields)
    assert [{r.key: r.value for r in f} for f in fields] == [{"t": "x", "l": "a, b"}, {}, {}, {"t": "b, c", "u": "v, w"}, {"t": "two: parts"}, {"t": "", "kéy": "x"}, {"t": "x"}, {"t": "x"}, {"t": "[a"}, {}]
    assert column(spark, FRONT, lambda c: text.front_field(c, "t")) == ["x", "", "", "b, c", "two: parts", "", "x", "x", "[a", ""]
    long = "---\nt:\n" + "  - item\n\n" * 50_000 + "---\nx"
    assert column(spark, [long], lambda c: text.front_field(c, "t")) == [", ".join(["item"] * 50_000)]
    assert column(spark, FRONT, text.front_body) == ["\nbody", "---\nnever closed", "plain", "", "\r\nrest", "", "\n", "", "", ""]



def test_pieces():
    table = "lead\n\n| a | b |\n|---|---|\n| " + "x" * 700 + " | y |\n\nafter"
    assert [p for _, p in markdown.pieces("# h\n" + table)] == [table]
    long = "Sentence one is here. " * 100
    got = [p for _, p in markdown.pieces("# h\n" + long)]
    assert len(got) > 3 and all(len(p) <= 601 for p in got) and " ".join(p.strip() for p in got) == long.strip()
    assert markdown.document_pieces("T", "short") == [("T", "short")]


def test_html():
    got = markdown.to_html("# T <b>\n- *x*\n- **y _z_**\n\n`c*c*` ~~d~~ ![p](x)\nnext\n\n> q\n> r\n***\n```py\n<raw>\n# x\n```\n| a | b\\|c |\n|---|---|\n| 1 | <2> |\n\n1. [l](https://e.org?a=1&b)\n2) [m](javascript:x)")
    want = [
        "<h1>T &lt;b&gt;</h1>", "<ul><li><i>x</i></li><li><b>y _z_</b></li></ul>", '<p><code>c*c*</code> <del>d</del> <span class="image">p</span><br/>next</p>', "<blockquote>q<br/>r</blockquote>", "<hr/>",
        "<pre><code>&lt;raw&gt;\n# x</code></pre>", "<table><thead><tr><th>a</th><th>b|c</th></tr></thead><tbody><tr><td>1</td><td>&lt;2&gt;</td></tr></tbody></table>",
        '<ol><li><a href="https://e.org?a=1&amp;b" rel="noreferrer">l</a></li><li>m (javascript:x)</li></ol>',
    ]
    assert got == "\n".join(want)
    assert markdown.to_html("") == "" and "<script" not in markdown.to_html("<script>x</script>\n[a](data:text/html,x)")