"""A stored vector index: inverted-file cells with bounds, beside the exact scan of ``retrieval``.

Centers are fitted by k-means on a bounded sample (``SAMPLE`` vectors, drawn by hash); every vector goes to the
cell of the center at the smallest angle and keeps that angle. Rows are stored sorted by (cell, angle), so
a search that names cells and ranges of angles reads the row groups that hold them and skips the rest.

* ``probe`` reads the cells nearest to the query and ranks their rows exactly: distances are those of the
  exact scan, and what lies in other cells may be missed.
* ``search`` is exact: the k-th distance of a probe bounds what can still enter. By the triangle inequality
  of angles a row's angle to the query is at least the difference of both angles to its center, so cells
  and rings of cells beyond the bound are left out. On vectors without clusters that is next to nothing.

The driver holds the centers: MOST_CELLS vectors at most. Vectors without length have distance 1 to
everything and a cell of their own, which is always read. Null vectors are not indexed.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..models import cosine

SAMPLE = 65_536
MOST_CELLS = 4096
ROUNDS = 10
SEED = 42
NOWHERE = -1  # the cell of vectors without length
PROBED = 0.6  # share of the cells that probe() reads if not told otherwise; on clustered vectors far fewer do
_SLACK = 1e-7  # for angles' rounding


class Centers(NamedTuple):
    """cells, unit vectors, and the smallest and largest angle of a cell's rows to its center."""

    numbers: np.ndarray
    vectors: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def angles(self, query: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(self.vectors @ query, -1, 1)) if len(self.vectors) else np.zeros(0)


class VectorIndex(NamedTuple):
    """rows: cell, angle and the columns that were indexed. bounds: cell, center, least, most, rows."""

    rows: DataFrame
    bounds: DataFrame

    def centers(self) -> Centers:
        found = self.bounds.where(F.col("cell") != NOWHERE).orderBy("cell").collect()  # MOST_CELLS rows
        column = lambda name: np.array([r[name] for r in found])
        return Centers(column("cell"), np.array([r["center"] for r in found], float).reshape(len(found), -1 if found else 0), column("least"), column("most"))


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def default_cells(rows: int) -> int:
    return max(1, min(MOST_CELLS, math.isqrt(rows)))


def fit_centers(vectors: DataFrame, vector: str, cells: int | None = None) -> np.ndarray:
    """Unit centers (cells, dimension); fewer, if the sample has fewer vectors."""
    v = F.col(vector).cast("array<double>")
    sound = vectors.select(v.alias("v")).where("v IS NOT NULL").where(_length(F.col("v")) > 0)
    n = sound.count()
    if not n:
        return np.zeros((0, 0))
    buckets = 1 << 30
    drawn = sound.where(F.pmod(F.xxhash64("v"), F.lit(buckets)) < F.lit(math.ceil(buckets * min(1.0, SAMPLE / n)))).limit(2 * SAMPLE)
    units = drawn.select(array_to_vector(F.transform("v", lambda x: x / _length(F.col("v")))).alias("features")).cache()
    try:
        k = min(cells or default_cells(n), max(1, units.count()))
        found = KMeans(k=k, seed=SEED, maxIter=ROUNDS).fit(units).clusterCenters() if k > 1 else [np.mean([r["features"].toArray() for r in units.limit(1).collect()], axis=0)]
    finally:
        units.unpersist()
    centers = np.array(found)
    norms = np.linalg.norm(centers, axis=1, keepdims=True)
    return centers[norms[:, 0] > 0] / norms[norms[:, 0] > 0]


def assigned(vectors: DataFrame, vector: str, centers: np.ndarray) -> DataFrame:
    """vectors with cell and angle."""

    @F.pandas_udf("struct<cell:int,angle:double>")
    def place(values: pd.Series) -> pd.DataFrame:
        x = np.stack([np.asarray(v, float) for v in values]) if len(values) else np.zeros((0, centers.shape[1]))
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        near = np.clip(x / np.where(norms > 0, norms, 1) @ centers.T, -1, 1) if len(centers) else np.zeros((len(x), 1))
        cell = np.where(norms[:, 0] > 0, near.argmax(axis=1), NOWHERE)
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": np.where(cell == NOWHERE, np.pi / 2, np.arccos(near.max(axis=1)))})

    placed = vectors.where(F.col(vector).isNotNull()).withColumn("_at", place(F.col(vector).cast("array<double>")))
    return placed.select("_at.cell", "_at.angle", *vectors.columns)


def stored(rows: DataFrame) -> DataFrame:
    """Rows in the order in which they are to be written. A large cell is split by its angles."""
    return rows.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle")


def bounds(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """(cell, center, least, most, rows) of stored rows."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
    found = rows.groupBy("cell").agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.count("*").alias("rows"))
    return found.join(F.broadcast(known), "cell", "left").select("cell", "center", "least", "most", "rows")  # MOST_CELLS rows


def write(vectors: DataFrame, vector: str, path: str, cells: int | None = None, row_group: int | None = None) -> VectorIndex:
    """Builds the index of vectors under path. row_group: bytes of a row group, if not the default."""
    spark, centers = vectors.sparkSession, fit_centers(vectors, vector, cells)
    writer = stored(assigned(vectors, vector, centers)).write
    (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(f"{path}/rows")
    bounds(spark.read.parquet(f"{path}/rows"), centers).coalesce(1).write.parquet(f"{path}/bounds")
    return read(spark, path)


def read(spark, path: str) -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/bounds"))


def _unit(query: list[float]) -> np.ndarray | None:
    q = np.asarray(query, float)
    norm = np.linalg.norm(q) if q.size else 0.0
    return q / norm if norm > 0 else None


def _ranked(rows: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    q = F.array(*map(F.lit, map(float, query))) if len(query) else F.array().cast("array<double>")
    return rows.select(key, (1 - cosine(F.col(vector), q)).alias("distance")).orderBy("distance", key).limit(k)


def probe(index: VectorIndex, key: str, vector: str, query: list[float], k: int, probes: int | None = None) -> DataFrame:
    """(key, distance) of the k nearest rows in the nearest cells."""
    q, centers = _unit(query), index.centers()
    if q is None:
        return _ranked(index.rows, key, vector, query, k)
    n = probes or max(1, math.ceil(PROBED * len(centers.numbers)))
    wanted = centers.numbers[np.argsort(centers.angles(q), kind="stable")[:n]].tolist()
    return _ranked(index.rows.where(F.col("cell").isin(NOWHERE, *wanted)), key, vector, query, k)


def reachable(centers: Centers, query: np.ndarray, reach: float) -> list[tuple[int, float, float]]:
    """(cell, from, to): of each cell that may hold a row within an angle of the query, its rows' angles."""
    away = centers.angles(query)
    low, high = away - reach - _SLACK, away + reach + _SLACK
    return [(int(c), float(a), float(b)) for c, a, b, least, most in zip(centers.numbers, low, high, centers.least, centers.most) if a <= most and b >= least]


def search(index: VectorIndex, key: str, vector: str, query: list[float], k: int, probes: int | None = None) -> DataFrame:
    """(key, distance) of the k nearest rows of all: the rows of the exact scan."""
    q = _unit(query)
    if q is None:
        return _ranked(index.rows, key, vector, query, k)
    first = probe(index, key, vector, query, k, probes).agg(F.count("*").alias("n"), F.max("distance").alias("d")).first()
    if first["n"] < k:
        return _ranked(index.rows, key, vector, query, k)
    reach = math.acos(max(-1.0, min(1.0, 1 - first["d"])))
    near = reachable(index.centers(), q, reach)
    rings = index.rows.sparkSession.createDataFrame([*near, (NOWHERE, 0.0, 4.0)], "_cell int, _from double, _to double")
    listed = index.rows.where(F.col("cell").isin(NOWHERE, *(c for c, _, _ in near)))
    inside = (F.col("cell") == F.col("_cell")) & F.col("angle").between(F.col("_from"), F.col("_to"))
    return _ranked(listed.join(F.broadcast(rings), inside), key, vector, query, k)  # MOST_CELLS + 1 rows
