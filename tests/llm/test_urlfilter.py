"""URL filters: the Bloom filter has no false negatives, the exact join no false positives, rules, edge rows."""

import json

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import urlfilter
from corpusloom.llm.shared import local_rows


def listed(spark, keys):
    return local_rows(spark, json.dumps([{"key": k} for k in keys]), "key string")


def test_bloom(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".org/")).alias("key"))
    bits = urlfilter.build_filter(keys)
    probe = lambda df: (np.array(x, np.int64) for x in zip(*[(r.h, r.g) for r in df.select(F.xxhash64("key").alias("h"), F.xxhash64("key", F.lit(1)).alias("g")).collect()], strict=True))
    assert urlfilter.maybe_listed(bits, *probe(keys)).all()
    others = spark.range(3000).select(F.concat(F.lit("other"), F.col("id"), F.lit(".net/")).alias("key"))
    assert urlfilter.maybe_listed(bits, *probe(others)).mean() < 0.02
    assert not urlfilter.maybe_listed(urlfilter.build_filter(keys.where("false")), *probe(others)).any()


def test_verdicts(spark):
    urls = [
        (1, "http://Spam.Example.NET/x", "block"), (2, "http://a.example.net/en/x", "allow"), (3, "http://example.net", "allow"), (4, "https://sub.bad.org/deep/page?q#f", "block"),
        (5, "https://notbad.org/", "allow"), (6, "http://ok.org/private/x", "block"), (7, "http://ok.org/privateer", "allow"), (8, "http://bad.org/fr/", "allow"), (9, None, "allow"),
        (10, "no scheme", "allow"), (11, "http://ok.org:80/./private//x", "block"), (12, "http://example.com/de/", "block"), (12, "http://example.com/de/", "block"), (13, "", "allow"), (14, "http://exact.com/a?b", "block"),
        (15, "http://exact.com/a/c", "allow"), (16, "x://y://z/p", "allow"),
    ]
    pages = spark.createDataFrame([u[:2] for u in urls], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS keys")
    got = urlfilter.filter_urls(pages, listed(spark, ["bad.org/", "ok.org/private/", "exact.com/a", "bad.org/"])).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == sorted((u[0], u[2]) for u in urls)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule) == ("spam.example.net", "/x", "net/")
    assert (by[3].rule, by[3].path, by[8].rule, by[9].host, by[10].path, by[16].host) == (None, "", "org/fr/", "", "", "y:")
    assert urlfilter.filter_urls(pages.where("false"), listed(spark, ["x/"])).collect() == []


def test_filter_only_saves_work(spark, sf, monkeypatch):
    """With a filter that lets all pass the result is the same."""
    with_filter = sorted(map(str, urlfilter.op7_urls(spark, sf).collect()))
    monkeypatch.setattr(urlfilter, "build_filter", lambda keys: np.full((1, 8), -1, np.int64))
    assert sorted(map(str, urlfilter.op7_urls(spark, sf).collect())) == with_filter


def test_canonical(spark):
    cases = [
        ("u:p@bad.org.:8080", "/a/../b/./c//d", "bad.org/b/c/d"), ("a.org", "", "a.org/"), ("a.org", "/..", "a.org/"), ("a.org", "/x/..", "a.org/"), ("a.org", "/x/y/..", "a.org/x/"),
        ("a.org", "/%70rivate/%2f%zz%4", "a.org/private/%2F%zz%4"), ("a.org", "/a/.", "a.org/a/"), ("a.org", "/a//", "a.org/a/"), ("a.org", "/%2e%2E/b", "a.org/b"), ("a.org", "/.well/..x", "a.org/.well/..x"), ("", "", "/"),
    ]
    df = spark.createDataFrame(cases, "host string, path string, want string")
    assert [r.want for r in df.collect()] == [r.got for r in df.select(urlfilter.canonical(F.col("host"), F.col("path")).alias("got")).collect()]


def test_evasion_and_long_urls(spark):
    urls = ["http://me@bad.org/x", "http://ok.org/x/../private/1", "http://ok.org/%70rivate/1", "http://ok.org/" + "a/" * 30_000, "http://" + "a." * 20_000 + "bad.org/", "http://ok.org/x/..%2fprivate/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, listed(spark, ["bad.org/", "ok.org/private/"]), rules=(("block", "nowhere", "/"),)).collect()}
    assert [got[i] for i in range(6)] == ["block", "block", "block", "allow", "block", "allow"]


def test_production_list(spark):
    keys = [r.key for r in urlfilter.production_list(spark).collect()]
    assert len(keys) == len(set(keys)) == 6 * 3 * 100 + 3 + 3 * 999 * 2
    assert {"free-bets.example.com/", "ads-track7.example.org/", "ththan.example.com/es/", "ththan.example.com/en/9990.html"} <= set(keys)
    assert len(urlfilter.build_filter(urlfilter.production_list(spark))) == 256
