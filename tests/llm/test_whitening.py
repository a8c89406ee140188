"""Whitening: eigenvectors as brute force, lossless merges, digits with large means, edge rows."""

import math

import numpy as np
import pyarrow as pa

from corpusloom.llm import whitening


def plain(vectors, k=4, scale=256):
    """By eigenvectors of the covariance: n, sums, variances, components, shares."""
    x = np.array([[math.floor(scale * float(c)) for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(axis=0)
    values, columns = np.linalg.eigh(c.T @ c / len(fit))
    order = np.argsort(-values)[:k]
    return x, len(fit), fit.sum(axis=0), values[order], columns[:, order].T, values[order] / values.sum()


def test_embeddings(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, n, sums, values, components, shares = plain([r.embedding for r in table])
    by = {}
    for r in whitening.op13_whitening(spark, sf).collect():
        by.setdefault(r.vec_id, []).append(r)
    assert len(by) == len(table)
    got = np.array([[r.whitened for r in sorted(by[t.vec_id], key=lambda r: r.component)] for t in table])
    want = (x - sums / n) @ components.T / np.sqrt(values)
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-9
    for t, row in zip(table, x):
        rows = by[t.vec_id]
        assert sorted(r.component for r in rows) == [1, 2, 3, 4] and {r.n for r in rows} == {n}
        assert {r.deviation for r in rows} == {sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))}
        assert all(math.isclose(r.explained, shares[r.component - 1], rel_tol=1e-9) and r.identity_error < 1e-9 for r in rows)


def test_merges_lose_nothing():
    """However rows are split, all singular values and vectors are those of the whole; also with means of 2^30."""
    rng = np.random.default_rng(4)
    for mean in (0, 1 << 30):
        rows = rng.integers(-1000, 1000, (700, 12)) * np.arange(1, 13) + mean
        whole = whitening.decomposed(rows)
        states = [whitening.decomposed(p) for p in np.split(rows, [1, 3, 300, 305, 690])]
        left = states[0]
        for s in states[1:]:
            left = whitening.merged(left, s)
        pairs = whitening.merged(whitening.merged(states[0], states[1]), whitening.merged(whitening.merged(states[2], states[3]), whitening.merged(states[4], states[5])))
        for found in (left, pairs):
            assert (found.n, found.sums) == (700, rows.sum(axis=0).tolist()) and len(found.singular) == 12
            assert np.allclose(found.singular, whole.singular, rtol=1e-11)
            assert np.allclose(np.abs((found.vectors * whole.vectors).sum(axis=1)), 1, atol=1e-10)


def test_levels(spark, monkeypatch):
    """Many small tasks and a fanout of two."""
    monkeypatch.setattr(whitening, "FANOUT", 2)
    rng = np.random.default_rng(8)
    rows = rng.integers(-50, 50, (300, 5)).tolist()
    vectors = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(13)
    state = whitening.fit(vectors)
    whole = whitening.decomposed(np.array(rows))
    assert state.n == 300 and state.sums == whole.sums and np.allclose(state.singular, whole.singular)
    assert whitening.fit(vectors.where("false")) is None


def test_large_and_flat(spark):
    """Deviations beyond a long, vectors of a single value, more dimensions than vectors."""
    big = [(i, [float(1 << 50) * (i % 3), float(i)]) for i in range(6)]
    found = whitening.whiten(spark.createDataFrame(big, "id int, v array<double>"), "v").collect()
    assert {r.component for r in found} == {1, 2} and max(r.deviation for r in found) == 2**63 - 1 and found[0].explained + found[1].explained <= 1 + 1e-12
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5)], "id int, v array<double>")
    rows = whitening.whiten(same, "v").collect()
    assert len(rows) == 15 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(1, 0, None, 0.0, 0.0)}
    two = spark.createDataFrame([(i, [float(i % 2), 2.0, 3.0, 1.0, 1.0]) for i in range(5)], "id int, v array<double>")
    rows = whitening.whiten(two, "v").collect()
    assert len(rows) == 20 and all((r.whitened is None) == (r.component > 1) for r in rows)
    assert {(r._row.id % 2, round(abs(r.whitened), 9)) for r in rows if r.component == 1} == {(0, 1.0), (1, 1.0)}
    state = whitening.decomposed(np.array([[1, 1, 1]]))
    basis = whitening.whitening(state).components
    assert np.allclose(basis @ basis.T, np.eye(3)) and isinstance(whitening._row(0, state), pa.Table)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(9)
    sound = [(i if i % 5 else None, rng.normal(size=4).tolist()) for i in range(40)]
    sound += sound[:7]
    rows = sound + [(1, None), (1, [1.0, None, 2.0, 1.0]), (1, [nan, 1.0, 1.0, 1.0]), (1, [-inf, 1.0, 1.0, 1.0]), (1, [1.0]), (1, [])]
    docs = spark.createDataFrame(rows, "id int, v array<double>").selectExpr("*", "'c' AS component", "1 AS x", "2 AS n", "3 AS _row")
    found = whitening.whiten(docs, "v")
    assert found.select("_row.*").columns == [c for c in docs.columns if c != "v"]
    got = found.collect()
    x, n, sums, *_ = plain([v for _, v in sound])
    assert len(got) == 4 * len(sound) and {r.n for r in got} == {n} == {40}
    want = sorted(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x)
    assert sorted(r.deviation for r in got if r.component == 1) == want
    empty = whitening.whiten(docs.where("v IS NULL"), "v")
    assert empty.collect() == [] and empty.columns == found.columns
