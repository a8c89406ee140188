"""Exact dedup: groups against brute force, the directory, colliding hashes and edge rows."""

import hashlib
import re

from pyspark.sql import functions as F

from corpusloom.llm import exactdedup

SCHEMA = "doc_id long, text string"


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    groups = {}
    for r in docs:
        groups.setdefault(normal(r.text), []).append(r.doc_id)
    want = {(d, min(ids), len(ids), d == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids}
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exactdedup.op5_exact_dedup(spark, sf).collect()]
    assert len(got) == len(docs) and set(got) == want


def test_normalising(spark):
    texts = ["a  b", "a\t\nb", " a b ", "a\x0b\x0c\rb", "a b", "", " ", "\n\n", "a\u00a0b", "a\u0085b", "x" * 100_000 + "  y", "  ", "a \t b  \r c"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exactdedup.normalised(F.col("t")).alias("n")).collect()
    assert all(r.n == normal(r.t) for r in got)


def test_directory_doubles():
    counts = [0] * 16
    counts[3], counts[9], counts[8] = 100, 4, 4
    buckets = exactdedup.double_directory(counts, 5)
    assert sorted((a, n) for a, n, _ in buckets) == [(0, 2), (2, 1), (3, 1), (4, 4), (8, 1), (9, 1), (10, 2), (12, 4)]
    assert all(16 >> depth == n for _, n, depth in buckets)
    assert exactdedup.double_directory(counts, 1000) == [(0, 16, 0)]


def test_colliding_hashes_chain(spark, monkeypatch):
    """All texts under one hash: bytes decide."""
    monkeypatch.setattr(exactdedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], SCHEMA)
    index = exactdedup.build_index(docs, capacity=1)
    rows = index.records.collect()
    assert sorted((r.keep_id, r.group_size) for r in rows) == [(1, 2), (2, 1), (4, 1)] and sorted(r.chain for r in rows) == [1, 2, 3]
    assert sorted(r.doc_id for r in exactdedup.exact_dedup(docs).collect()) == [1, 2, 4]


def test_small_capacity(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few, many = exactdedup.exact_dedup(docs, capacity=10**9), exactdedup.exact_dedup(docs, capacity=1)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_the_directory_steers(spark, sf):
    """Buckets are ranges of hashes within capacity; records stand where it says; without it, none is found."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    index = exactdedup.build_index(docs, capacity=3)
    slots = dict(map(tuple, index.directory.collect()))
    assert sorted(slots) == list(range(1 << exactdedup.SLOT_BITS))
    records = index.records.collect()
    keys = {}
    for r in records:
        assert slots[(r.h & (1 << 64) - 1) >> 64 - exactdedup.SLOT_BITS] == r.bucket
        keys.setdefault(r.bucket, set()).add(r.h)
    assert len(keys) > len(records) / 3 and max(map(len, keys.values())) <= 3
    assert exactdedup.look_up(index).count() == docs.count()
    wrong = index._replace(directory=index.directory.select("slot", ((F.col("bucket") + 1) % 7).alias("bucket")))
    assert exactdedup.look_up(wrong).count() < docs.count()
    order = [(r.bucket, r.h, r.chain) for part in index.records.rdd.glom().collect() for r in part]
    assert sum(x > y for x, y in zip(order, order[1:])) < index.records.rdd.getNumPartitions()


def test_heavy_texts(spark):
    """Half of the rows are one text: the records of heavy hashes and the others are found alike."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'same  text', concat('t', id)) AS text")
    index = exactdedup.build_index(docs)
    assert len(index.heavy) == 1
    got = exactdedup.look_up(index).select("doc_id", "keep_id", "group_size").collect()
    assert sorted(map(tuple, got)) == [(i, i if i % 2 else 0, 1 if i % 2 else 3000) for i in range(6000)]
    assert exactdedup.exact_dedup(docs).count() == 3001
    again = docs.selectExpr("if(doc_id % 2 = 0, 0, doc_id) AS doc_id", "text")
    assert exactdedup.exact_dedup(again).count() == 3001


def test_edge_rows(spark):
    docs = spark.createDataFrame([(5, None), (4, ""), (None, " "), (None, "x"), (None, "x"), (3, "y"), (3, "y"), (3, "z")], SCHEMA).selectExpr("*", "'k' AS keep_id", "1 AS h", "2 AS same")
    kept = exactdedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id is None, r.doc_id), r.text) for r in kept.collect() if r.doc_id is not None) == [((False, 3), "y"), ((False, 3), "z"), ((False, 4), "")]
    assert sorted(r.text for r in kept.collect() if r.doc_id is None) == [" ", "x"]
    assert exactdedup.exact_dedup(docs.where("false")).collect() == []
