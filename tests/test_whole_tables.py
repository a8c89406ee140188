"""Queries over whole tables, against slow versions."""

import hashlib
from collections import defaultdict

import duckdb

import __spark_entry__ as entry

SHORT = "mr mrs ms dr prof e.g i.e etc vs st no al".split()


def slow_sentences(t):
    """Number of sentences, character by character."""
    inside = set()  # full stops of abbreviations
    for short in [x + "." for a in SHORT for x in (a, a.capitalize())]:
        at = t.find(" " + short)
        while at >= 0:
            inside |= {at + 1 + i for i, c in enumerate(short) if c == "."}
            at = t.find(" " + short, at + 1)
    number, now, i = 0, "", 0
    while i < len(t):
        now += t[i]
        after = i + 1
        while after < len(t) and t[after].isspace():
            after += 1
        ends = t[i] in "。！？" or (t[i] in ".!?" and i not in inside and i + 1 < after < len(t) and t[after] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
        if ends:
            number, now, i = number + bool(now.strip()), "", after
        else:
            i += 1
    return number + bool(now.strip())


def test_sentences_of_all_documents(spark, sf):
    assert slow_sentences("See no. 5. Dr. Who is here, e.g. Today! Yes") == 3
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert any(f" {x}. " in t for t in docs.values() for x in SHORT)
    got = {r.doc_id: r.sentences for r in entry.queries()["sentence_counts"](spark, sf).collect()}
    assert got == {d: slow_sentences(t) for d, t in docs.items()}


def test_fingerprint_of_all_documents(spark, sf):
    of = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        of[r.source].append(f"d{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}")
    want = {lib: hashlib.sha256("|".join(sorted(x)).encode()).hexdigest()[:16] for lib, x in of.items()}
    assert {r.lib: r.fingerprint for r in entry.queries()["content_fingerprint"](spark, sf).collect()} == want


def moved(spark, df):
    """Exchanges and joins in the plan of df."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in ("Exchange", "Join") if x in plan]


def test_pieces_stay_in_their_rows(spark, sf):
    """Nothing is shuffled or joined: pieces of both ways, and chunks with their links, stand in their text's row."""
    for name in ("sentence_pieces", "list_pieces", "note_chunks"):
        assert moved(spark, entry.queries()[name](spark, sf)) == [], name


def test_splitter_holds_few_texts_as_objects(spark, monkeypatch):
    from corpusloom.functions import markdown

    for size in (1, 3, 128):
        monkeypatch.setattr(markdown, "TEXTS", size)
        rows = spark.createDataFrame([(i, None if i == 3 else "One. Two. Three. " * i) for i in range(10)], "i int, t string")
        got = {r.i: r.p for r in rows.coalesce(1).select("i", markdown.parts_udf(markdown.sentence_pieces, 12)("t").alias("p")).collect()}
        assert got == {i: markdown.sentence_pieces("" if i == 3 else "One. Two. Three. " * i, 12) for i in range(10)}


def test_table_binding_of_blank_and_broken_texts(spark, tmp_path):
    """The same rows as the SQL, also for texts that are blank, hold blank lines or end in other white space."""
    texts = ["", "   ", "\n", None, "One two.\n\nThree.\n \t\n| a |\n\n- b", "| a |", "- a\n- b", "\u00a0word\u3000", "\x0bword\x0c", "a\n\x85\nb", "100%_ %0A %25 %\n\n%", "a\r\n\r\nb\r\n"]
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate((t, lang) for t in texts for lang in ("en", "", None, "%_\n\n%0A"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(entry.oracle_sql()["table_binding"]).fetchall()}
    assert {r.doc_id: (r.n, r.digest) for r in entry.queries()["table_binding"](spark, f"file://{tmp_path}").collect()} == want
