"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each task that reads the distinct vectors keeps their number, exact sums, and the full-rank singular
values and right vectors of its centred rows. Such states merge losslessly: the scaled right vectors of
both and one more row, the scaled difference of the means, are decomposed again; all dimensions stay.
States merge ``FANOUT`` at a time, level by level, in tasks; a state has a square of the dimension, whatever
the number of rows. The last one gives components and variances; then each row is projected where it is.

All matrices are centred before they are multiplied, so large means cost no digits. Means are exact sums
divided once. Signs are chosen so that a component's largest entry is positive, ties to the first.

Defined results: rows with a null vector, or with null or non-finite entries, are dropped, and so are rows
with another number of entries than most. Entries are floor(256 * c), at most 2^40 in size. Repeated
vectors count once in the fit; each row gets its result. A component without variance (fewer distinct
vectors than dimensions) has whitened null and is left out of identity_error. Vectors with fewer than
four entries have fewer components. Deviations beyond a long become the largest long. An empty table gives
an empty result. Other columns are kept in a struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import materialise, table
from .vectors import matrix, safe, saturated, whole_vectors

SCALE = 256
COMPONENTS = 4
FANOUT = 8
_ROWS = 2048  # decomposed at a time
_NO_VARIANCE = 1e-14  # of the whole: what is below is rounding

STATE = "node long, n long, sums array<decimal(38,0)>, singular array<double>, vectors array<double>"
_SCHEMA = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("singular", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])


class State(NamedTuple):
    """n rows: exact sums; singular values and right vectors (rows) of what is left without the mean."""

    n: int
    sums: list[int]
    singular: np.ndarray
    vectors: np.ndarray

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def decomposed(rows: np.ndarray) -> State:
    """Whole-number rows."""
    n, sums = len(rows), [int(s) for s in safe(rows, len(rows) * int(np.abs(rows).max(initial=0))).sum(axis=0)]
    centred = rows - np.array([s / n for s in sums])
    _, singular, vectors = np.linalg.svd(centred, full_matrices=False)
    return State(n, sums, singular, vectors)


def merged(a: State, b: State) -> State:
    """The state of all rows of both: nothing of either is cut off."""
    # (b.sums * a.n - a.sums * b.n) / (a.n * b.n) is the difference of the means, exact up to the division
    away = np.array([(y * a.n - x * b.n) / (a.n * b.n) for x, y in zip(a.sums, b.sums)])
    correction = away * np.sqrt(a.n / (a.n + b.n) * b.n)
    _, singular, vectors = np.linalg.svd(np.vstack([a.singular[:, None] * a.vectors, b.singular[:, None] * b.vectors, correction]), full_matrices=False)
    return State(a.n + b.n, [x + y for x, y in zip(a.sums, b.sums)], singular, vectors)


def _row(node: int, s: State) -> pa.Table:
    columns = [[node], [s.n], [[Decimal(x) for x in s.sums]], [s.singular.tolist()], [s.vectors.ravel().tolist()]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], _SCHEMA)


def _state(row: dict) -> State:
    sums = [int(x) for x in row["sums"]]
    return State(row["n"], sums, np.array(row["singular"], float), np.array(row["vectors"], float).reshape(-1, len(sums)))


def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of a task's rows."""
    from pyspark import TaskContext

    state = None
    for batch in batches:
        x = matrix(batch.column(0))
        for i in range(0, len(x), _ROWS):
            part = decomposed(x[i : i + _ROWS])
            state = merged(state, part) if state else part
    if state:
        yield from _row(TaskContext.get().partitionId(), state).to_batches()


def _merge(rows: pa.Table) -> pa.Table:
    states = sorted(rows.to_pylist(), key=lambda r: r["node"])
    whole = _state(states[0])
    for r in states[1:]:
        whole = merged(whole, _state(r))
    return _row(states[0]["node"] // FANOUT, whole)


def fit(vectors: DataFrame) -> State | None:
    """The state of all rows of vectors (x)."""
    states = materialise(vectors.select("x").mapInArrow(leaves, STATE), "svd-leaves")
    while (n := states.count()) > 1:
        # nodes are numbers of tasks, some without rows: after a level there are as many groups as the largest allows
        states = materialise(states.groupBy(F.expr(f"node div {FANOUT}")).applyInArrow(_merge, STATE), "svd-level", n)
    row = states.first()
    return _state(row.asDict()) if row else None


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    components: np.ndarray  # (components, dimension)
    variances: np.ndarray  # 0 where there is none
    explained: np.ndarray

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact (n*x - S), and whitened values, NaN for components without variance."""
        wide = 2 * self.n * int(np.abs(x).max(initial=0)) >= 1 << 62
        kind = object if wide else np.int64
        from_mean = x.astype(kind) * self.n - np.array(self.sums, kind)
        scale = np.where(self.variances > 0, np.sqrt(self.variances), np.nan)
        return from_mean, (from_mean / self.n).astype(float) @ self.components.T / scale


def whitening(state: State, components: int = COMPONENTS) -> Whitening:
    """Its components by falling variance."""
    total = float((state.singular**2).sum())
    k = min(components, len(state.sums))
    shares = (state.singular[:k] ** 2 / total) if total else np.zeros(min(k, len(state.singular)))
    vectors = state.vectors[:k]
    if len(shares) < k:  # fewer rows than components: directions without variance, any that are at right angles
        basis = np.linalg.svd(np.vstack([vectors, np.zeros((1, len(state.sums)))]))[2]
        vectors, shares = np.vstack([vectors, basis[len(vectors) : k]]), np.append(shares, np.zeros(k - len(shares)))
    shares = np.where(shares > _NO_VARIANCE, shares, 0.0)
    largest = np.abs(vectors).argmax(axis=1)
    signs = np.where(vectors[np.arange(k), largest] < 0, -1.0, 1.0)
    return Whitening(state.n, state.sums, vectors * signs[:, None], shares * total / state.n, shares)


def identity_error(vectors: DataFrame, found: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance without the identity."""
    live = np.flatnonzero(found.variances > 0)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = found.project(matrix(batch.column(0)))[1][:, live]  # centred by the exact mean
            i, j = np.triu_indices(len(live))
            values = np.concatenate([w.sum(axis=0), (w[:, i] * w[:, j]).sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["place", "value"])

    totals = vectors.select("x").mapInArrow(moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    values = np.array([r["value"] for r in sorted(totals, key=lambda r: r["place"])]) / found.n  # a few
    i, j = np.triu_indices(len(live))
    mean, products = values[: len(live)], values[len(live) :]
    return float(np.abs(products - mean[i] * mean[j] - (i == j)).max(initial=0.0)) if len(live) else 0.0


def whiten(rows: DataFrame, vector: str, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(_row, component, n, deviation, whitened, explained, identity_error) for each sound row and component."""
    vectors = materialise(whole_vectors(rows, vector, scale), "whole-vectors")
    distinct = materialise(vectors.select("x").distinct(), "distinct-vectors")
    state = fit(distinct)
    schema = StructType([vectors.schema["_row"]]).add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    if state is None:
        return vectors.select("_row", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:]])
    found = whitening(state, components)
    error, k = identity_error(distinct, found), len(found.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            from_mean, w = found.project(matrix(batch.column("x")))
            most = int(np.abs(from_mean).max(initial=0))
            deviation = saturated((safe(from_mean, from_mean.shape[1] * most**2) ** 2).sum(axis=1))
            columns = [
                batch.column("_row").take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, found.n)), pa.array(np.repeat(deviation, k)),
                pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(np.tile(found.explained, n)), pa.array(np.full(n * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return vectors.mapInArrow(run, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """op13: every vector on the first components."""
    found = whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "embedding")
    return found.select("_row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def whitening_deviations(spark, sf_dir: str) -> DataFrame:
    """What SQL can follow of op13: the fit list's length, each row's deviation, and that the shares fall and the covariance is the identity."""
    found = op13_whitening(spark, sf_dir)
    return found.groupBy("vec_id", "n", "deviation").agg(
        F.count("*").alias("components"), (F.max_by("explained", "component") == F.min("explained")).alias("falling"), (F.max("identity_error") <= 1e-4).alias("identity"),
    )


DEVIATIONS = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
d AS (SELECT DISTINCT x FROM e), m AS (SELECT count(*) AS n FROM d),
s AS (SELECT list(total ORDER BY k) AS sums FROM (SELECT k, sum(x[k])::BIGINT AS total FROM d, range(1, 65) t(k) GROUP BY k))
SELECT vec_id, n, list_sum(list_transform(range(1, 65), lambda k: (n * x[k] - sums[k]) * (n * x[k] - sums[k])))::BIGINT AS deviation, 4::BIGINT AS components, true AS falling, true AS identity FROM e, m, s
"""
