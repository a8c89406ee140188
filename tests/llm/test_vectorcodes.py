"""Vector codes: plain Lloyd as brute force, what the rounds shuffle, large components, edge rows."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import vectorcodes, vectors


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (key, vector), sound. Codes, errors and codebooks by Python's whole numbers."""
    whole = [[math.floor(scale * x) for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, whole[i]))[:entries]
    cut = lambda v: [v[len(v) * k // parts : len(v) * (k + 1) // parts] for k in range(parts)]
    cut_rows = [cut(v) for v in whole]
    books = [[cut_rows[i][k] for i in order] for k in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((away(v[k], e), j) for j, e in enumerate(books[k])) for k in range(parts)] for v in cut_rows]

    for _ in range(rounds):
        found = assign()
        for k in range(parts):
            for j in range(len(books[k])):
                mine = [v[k] for v, f in zip(cut_rows, found) if f[k][1] == j]
                if mine:
                    books[k][j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    return ["".join(f"{j:02x}" for _, j in f) for f in found], [sum(d for d, _ in f) for f in found], books


def test_embeddings(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    codes, errors, books = plain([(r.vec_id, r.embedding) for r in table])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by = {}
    for r, e in zip(table, errors):
        by[r.label] = by.get(r.label, 0) + e
    want = {(r.vec_id, c, e, by[r.label], digest) for r, c, e in zip(table, codes, errors)}
    assert set(map(tuple, vectorcodes.op12_vector_codes(spark, sf).collect())) == want


def test_only_changes_are_summed(spark, monkeypatch):
    """The running sums are those of all parts, though each round reads only rows that changed."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(i % 4, 0.05, 8)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "id int, v array<double>")
    read, seen = [], []
    make, update = vectorcodes.changes, vectorcodes.updated
    kept = vectorcodes.materialise

    def spy(df, label, *more):
        out = kept(df, label, *more)
        if label == "vectors" and "before" in out.columns:
            read.append(out.where("before IS NULL OR before != code").count())
        return out

    monkeypatch.setattr(vectorcodes, "materialise", spy)
    monkeypatch.setattr(vectorcodes, "updated", lambda books, sums: seen.append(sums.where("position = -1").agg(F.sum("total")).first()[0]) or update(books, sums))
    found, books = vectorcodes.quantise(docs, "id", "v", parts=2, entries=4, rounds=6)
    assert read[0] == 400 and read[-1] < 100 and len(read) == 6 and make
    assert [int(x) for x in seen] == [800] * 6  # each part counts once, whatever moved
    codes, errors, want = plain(rows, 2, 4)
    assert [b.tolist() for b in books] == want
    assert sorted((r.id, r.code.hex(), r.error) for r in found.select("_row.id", "code", "error").collect()) == [(i, c, e) for i, (c, e) in enumerate(zip(codes, errors))]


def test_restored(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").limit(100)
    found, books = vectorcodes.quantise(rows, "vec_id", "embedding", rounds=2)
    x = {r.id: r.x for r in vectors.whole_vectors(rows, "embedding", 4096).select("_row.vec_id", "x").withColumnRenamed("vec_id", "id").collect()}
    for r in found.select("_row.vec_id", "code", "error").collect():
        assert ((vectorcodes.restored(r.code, books) - np.array(x[r.vec_id])) ** 2).sum() == r.error


def test_ties_and_large_components(spark):
    """Equal entries: the lower index. Components whose squares leave 64 bits are compared exactly."""
    books = [np.array([[5, 5], [5, 5], [1, 1]])]
    codes, errors = vectorcodes.nearest(np.array([[5, 5], [3, 3], [0, 0]]), books)
    assert codes.ravel().tolist() == [0, 0, 2] and errors.tolist() == [0, 8, 2]
    big = 1 << 40
    codes, errors = vectorcodes.nearest(np.array([[big, big - 1], [-big, 0]]), [np.array([[big, big], [-big, 3]])])
    assert codes.ravel().tolist() == [0, 1] and errors.tolist() == [1, 9]
    assert vectorcodes.nearest(np.array([[big, big]]), [np.array([[-big, -big]])])[1].tolist() == [2**63 - 1]
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [1e30, 1.5])]
    found, _ = vectorcodes.quantise(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", parts=1, entries=2)
    assert {r.id: r.code.hex() for r in found.select("_row.id", "code").collect()} == {0: "00", 1: "01", 2: "00"}


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0, 3.0]), (1, None), (1, [1.0, None, 2.0]), (1, [nan, 1.0, 1.0]), (1, [inf, 1.0, 1.0]), (1, [1.0]), (None, [-0.5, 0.0, 0.0]), (2, [9.0, 9.0, 9.0]), (2, [8.0, 9.0, 9.0]), (2, [8.0, 9.0, 9.0])]
    docs = spark.createDataFrame(rows, "id int, v array<float>").selectExpr("*", "'c' AS code", "1 AS x", "2 AS error", "3 AS _row")
    found, books = vectorcodes.quantise(docs, "id", "v", parts=2, entries=3, rounds=3)
    assert found.columns == ["_row", "code", "error"] and found.select("_row.*").columns == [c for c in docs.columns if c != "v"]
    sound = [r for r in rows if r[1] and len(r[1]) == 3 and all(x is not None and math.isfinite(x) for x in r[1])]
    codes, errors, want = plain(sound, 2, 3, 3)
    assert [b.tolist() for b in books] == want
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.id, r.code.hex(), r.error) for r in found.select("_row.id", "code", "error").collect()), key=key) == sorted(((r[0], c, e) for r, c, e in zip(sound, codes, errors)), key=key)
    found, books = vectorcodes.quantise(docs.where("v IS NULL"), "id", "v")
    assert found.collect() == [] and found.columns == ["_row", "code", "error"]
