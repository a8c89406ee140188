"""Compression of vectors to codes: product quantisation by delta-maintained Lloyd.

Vectors are whole numbers, cut into ``PARTS`` consecutive parts; each part has a codebook of up to
``ENTRIES`` entries. A round assigns every part to its nearest entry and writes the vectors with their
assignments, new and previous, to the shared folder, without a shuffle. Of rows with a part that changed
the plus and minus contributions (the part's components, and one for the count) are summed where they
are read, and only these sums are shuffled: a row for each entry's component at most from each task. They
are added to the running sums, which are stored as well; from these the next entries follow. All is whole
numbers, so the order of rows and lost executors change nothing.

The driver holds the codebooks, ENTRIES vectors. Stored vectors take a few bits for each distinct
component, about half of the input, and replace those of the round before.

Defined results: rows with a null vector, or with null or non-finite components, are dropped, and so are
rows with another number of components than most. Components are floor(scale * x), at most 2^40 in size. A
number of components that parts don't divide gives parts of unlike widths, some perhaps empty, at distance
0. The first entries are those of the smallest keys, null last, equal keys by vector; with fewer rows there
are fewer entries. Repeated rows count each time. Errors beyond a long become the largest long. An empty
table gives an empty result. Other columns are kept in a struct, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import drop_materialised, scope
from .shared import materialise, table
from .vectors import matrix, safe, saturated, whole_vectors

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
_BLOCK = 2048  # rows compared with a codebook at a time
_COUNT = -1  # position of the number of an entry's parts among its sums

Codebooks = list[np.ndarray]  # for each part (entries, width)


def cuts(dimension: int, parts: int) -> list[slice]:
    edges = [dimension * k // parts for k in range(parts + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def nearest(x: np.ndarray, codebooks: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) entries as uint8, ties to the lower, and each row's squared distances summed."""
    codes, errors = [np.zeros((0, len(codebooks)), np.uint8)], [np.zeros(0, np.int64)]
    most = max([0, *(int(np.abs(a).max()) for a in (x, *codebooks) if a.size)])
    x = safe(x, x.shape[1] * (2 * most) ** 2)
    for i in range(0, len(x), _BLOCK):
        block, found, error = x[i : i + _BLOCK], [], 0
        for part, book in zip(cuts(x.shape[1], len(codebooks)), codebooks):
            away = ((block[:, None, part] - book[None].astype(x.dtype)) ** 2).sum(axis=2)
            found.append(away.argmin(axis=1).astype(np.uint8))
            error = error + away.min(axis=1)
        codes.append(np.stack(found, axis=1))
        errors.append(saturated(error))
    return np.concatenate(codes), np.concatenate(errors)


def _fixed(codes: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in codes], pa.binary())


def assign(codebooks: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _ = nearest(matrix(batch.column("x")), codebooks)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("x"), batch.column("code"), _fixed(codes)], ["_row", "x", "before", "code"])

    return run


def changes(parts: int, entries: int):
    """Of rows (x, before, code): what enters entries and what leaves them, summed over the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            x, n = matrix(batch.column("x")), batch.num_rows
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts)
            before = np.array([list(b) if b is not None else [-1] * parts for b in batch.column("before").to_pylist()], np.int64).reshape(n, parts)
            for k, part in enumerate(cuts(x.shape[1], parts)):
                moved = code[:, k] != before[:, k]
                gains = np.zeros((entries, part.stop - part.start + 1), np.int64)  # the count is last
                values = np.concatenate([x[moved, part], np.ones((int(moved.sum()), 1), np.int64)], axis=1)
                np.add.at(gains, code[moved, k], values)
                known = before[moved, k] >= 0
                np.subtract.at(gains, before[moved, k][known], values[known])
                for entry, position in np.argwhere(gains):
                    at = (k, int(entry), int(position) if position < gains.shape[1] - 1 else _COUNT)
                    totals[at] = totals.get(at, 0) + int(gains[entry, position])
        if totals:
            places = zip(*totals)
            columns = [pa.array(c, pa.int32()) for c in places] + [pa.array(map(Decimal, totals.values()), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "position", "total"])

    return run


def updated(codebooks: Codebooks, sums: DataFrame) -> Codebooks:
    """Entries as floor(sum / count); unused ones stay."""
    by_entry: dict[tuple[int, int], dict[int, int]] = {}
    for r in sums.collect():  # ENTRIES vectors and a count for each entry of each part, at most
        by_entry.setdefault((r["part"], r["entry"]), {})[r["position"]] = int(r["total"])
    books = [book.copy() for book in codebooks]
    for (part, entry), total in by_entry.items():
        if count := total.get(_COUNT, 0):
            books[part][entry] = [total.get(i, 0) // count for i in range(books[part].shape[1])]
    return books


def quantise(rows: DataFrame, key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """Rows as (_row, code, error): code is a byte for each part, error the squared distance to what the
    code stands for. And the codebooks that the codes belong to."""
    name = f"vector-codes-{uuid.uuid4().hex}"
    with scope(f"{name}-0"):
        state = materialise(whole_vectors(rows, vector, scale).withColumn("code", F.lit(None).cast("binary")), "vectors")
    first = state.orderBy(F.col(f"_row.`{key}`").asc_nulls_last(), "x").select("x").limit(entries).collect()  # ENTRIES vectors
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), -1 if first else 0)
    books = [start[:, part] for part in cuts(start.shape[1], parts)]
    spark, kind = rows.sparkSession, StructType([state.schema["_row"], state.schema["x"]])
    stored = StructType([*kind.fields]).add("before", "binary").add("code", "binary")
    coded = StructType([state.schema["_row"]]).add("code", "binary").add("error", "long")
    if not first:
        return state.select("_row", "code", F.lit(0).cast("long").alias("error")), books
    sums = None
    for i in range(1, rounds + 1):
        with scope(f"{name}-{i}"):
            state = materialise(state.select("_row", "x", "code").mapInArrow(assign(books), stored), "vectors")
            moved = state.where("before IS NULL OR before != code").select("x", "before", "code")
            delta = moved.mapInArrow(changes(parts, len(first)), "part int, entry int, position int, total decimal(38,0)")
            delta = delta if sums is None else sums.unionByName(delta)
            sums = materialise(delta.groupBy("part", "entry", "position").agg(F.sum("total").cast("decimal(38,0)").alias("total")), "sums", len(first) * (start.shape[1] + parts))
        books = updated(books, sums)
        drop_materialised(spark, f"{name}-{i - 1}")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = nearest(matrix(batch.column("x")), books)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), _fixed(codes), pa.array(errors)], ["_row", "code", "error"])

    return state.select("_row", "x").mapInArrow(last, coded), books


def restored(codes: bytes, codebooks: Codebooks) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([book[code] for book, code in zip(codebooks, codes)])


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """op12: the code and error of every vector, errors of its label, and the codebooks' digest."""
    found, books = quantise(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "vec_id", "embedding")
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
    rows = materialise(found.select("_row.vec_id", "_row.label", F.lower(F.hex("code")).alias("code"), "error"), "codes")
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    total = F.least(F.col("total"), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    joined = rows.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", total.alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    """Assignments by the entries of round i, and the entries of the next round."""
    return f"""
a{i} AS MATERIALIZED (SELECT p.vec_id, p.part, arg_min(c.entry, [list_sum(list_transform(range(1, 9), lambda k: (p.v[k] - c.v[k]) * (p.v[k] - c.v[k]))), c.entry]) AS entry,
  min(list_sum(list_transform(range(1, 9), lambda k: (p.v[k] - c.v[k]) * (p.v[k] - c.v[k])))) AS error FROM p JOIN c{i} c USING (part) GROUP BY ALL),
s{i} AS (SELECT a.part, a.entry, k, floor(sum(p.v[k]) / count(*))::BIGINT AS x FROM a{i} a JOIN p USING (vec_id, part), range(1, 9) t(k) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT part, entry, list(x ORDER BY k) AS v FROM s{i} GROUP BY ALL) n USING (part, entry))"""


ORACLE = f"""
WITH e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, n, part, x[8 * part + 1:8 * part + 8] AS v FROM e, range(0, 8) t(part)),
c0 AS (SELECT part, n - 1 AS entry, v FROM p WHERE n <= 16), {",".join(map(_round_sql, range(ROUNDS + 1)))},
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}),
r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN e USING (vec_id), b
"""
