"""Language identification: fusion against a slow version, held-out accuracy, edge rows."""

import math
from collections import Counter

import numpy as np

from corpusloom.llm import langid

LANGS = langid.LANGUAGES


def test_trigrams_cover_the_whole_text():
    text = ("der die das und " * 200_000).encode()
    assert sum(len(t) for t in langid.trigrams(text)) == len(text.strip())  # a space at either end, whatever the pieces
    assert list(langid.trigrams(b"12 34 !!")) == [] and list(langid.trigrams(None)) == []


def test_trigrams_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(200):
        text = "".join(rng.choice(list("ab é1 !\n"), rng.integers(0, 40))).encode()
        monkeypatch.setattr(langid, "_PIECE", 1 << 20)
        want = [x for t in langid.trigrams(text) for x in t]
        for piece in (1, 2, 3, 7):
            monkeypatch.setattr(langid, "_PIECE", piece)
            assert [x for t in langid.trigrams(text) for x in t] == want


def test_fitted_rows_are_not_declared_once_more(spark):
    rows = [(i, f"nur ein deutscher Text über {i} Dinge", "de", "a") for i in range(20)] + [(99, "nur ein deutscher Text", "fr", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    nothing = langid.F.lit(None).cast("string")
    got = langid.identify_documents(docs).select("_row.doc_id", "confidence")
    plain = langid.identify(docs, "text", nothing, nothing, langid.F.col("source"), langid.fit(docs.select("doc_id", "text", "lang"))).select("_row.doc_id", "confidence")
    assert sorted(got.collect()) == sorted(plain.collect())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"), sample_rows=300)
    held = docs.where("doc_id % 2 = 1 AND n_chars >= 40").selectExpr("doc_id", "text", "lang AS truth")
    nothing = langid.F.lit(None).cast("string")
    got = langid.identify(held, "text", nothing, nothing, nothing, model).selectExpr("_row.truth", "lang").collect()
    assert sum(r.truth == r.lang for r in got) / len(got) > 0.97


def test_random_letters_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, sample_rows=300)
    rng = np.random.default_rng(0)
    junk = ["".join(chr(97 + i) for i in rng.integers(0, 26, 300)), "zqxj kvwq xzzk qjxv wkqz " * 20, "", None, "12 34 %%"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    nothing = langid.F.lit(None).cast("string")
    assert [r.kept for r in langid.identify(rows, "text", nothing, nothing, nothing, model).collect()] == [False] * 5


def test_fusion(spark, sf):
    """Every posterior, from the likelihoods that the text model gives."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "lang AS said", "concat(source, '.example.', if(doc_id % 3 = 0, 'de', 'org')) AS host", "if(doc_id % 3 = 0, 'de', 'org') AS suffix")
    model = langid.fit(docs.selectExpr("doc_id", "text", "said AS lang"), sample_rows=100)
    got = {r.doc_id: r for r in langid.identify(docs, "text", langid.F.col("said"), langid.F.col("suffix"), langid.F.col("host"), model).selectExpr("_row.doc_id", "lang", "confidence", "text_lang").collect()}
    names = [*LANGS, "und"]
    rows, scores = docs.collect(), {}
    for r in rows:
        total, n = np.zeros(len(LANGS)), 0
        for t in langid.trigrams(r.text.encode()):
            total, n = total + model[:, t].sum(axis=1, dtype=np.float64), n + len(t)
        scores[r.doc_id] = [*(langid.TEMPER * total), -langid.TEMPER * n * math.log(langid.BUCKETS)] if n else None
    own = {d: names[int(np.argmax(s))] if s else "und" for d, s in scores.items()}
    by = {level: {} for level in ("host", "domain", "all")}
    domain = lambda h: ".".join(h.split(".")[-2:])
    for r in rows:
        for level, k in (("host", r.host), ("domain", domain(r.host)), ("all", "")):
            by[level].setdefault(k, Counter())[own[r.doc_id]] += 1
    for r in rows:
        if not scores[r.doc_id]:
            assert got[r.doc_id].lang == "und"
            continue
        p = {x: 1 / 5 for x in names}
        for level, k in (("all", ""), ("domain", domain(r.host)), ("host", r.host)):
            c = by[level][k].copy()
            c[own[r.doc_id]] -= 1
            p = {x: (c[x] + 10 * p[x]) / (sum(c.values()) + 10) for x in names}
        logits = []
        for x, s in zip(names, scores[r.doc_id], strict=True):
            right = lambda claim, rate, x=x: math.log(0.25 if x == "und" else rate if x == claim else (1 - rate) / 3)
            v = s + math.log(p[x] * (0.02 if x == "und" else 0.98)) + right(r.said, 0.9) + (right("de", 0.7) if r.suffix == "de" else 0)
            logits.append(v)
        top = max(logits)
        assert got[r.doc_id].lang == names[logits.index(top)]
        assert abs(got[r.doc_id].confidence - 1 / sum(math.exp(v - top) for v in logits)) < 1e-5


def test_edge_rows(spark):
    rows = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "The of and that the with was for", "xx", "s")], "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n", "2 AS p", "3 AS host")
    kept = langid.keep_identified(rows)
    assert kept.columns == rows.columns
    assert langid.identify_documents(rows).count() == 3
    assert langid.keep_identified(rows.where("false")).collect() == []


def test_pages(spark, sf):
    got = langid.langid_pages(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert sum(r.lang == r.declared for r in got) / len(got) > 0.95
    # the declaration as truth, without itself as evidence
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"))
    blind = langid.identify_pages(spark.read.parquet(f"{sf}/pages.parquet"), model, by_markup=False).selectExpr("_row.declared", "lang").collect()
    assert sum(r.lang == r.declared for r in blind) / len(blind) > 0.9
