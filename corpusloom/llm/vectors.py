"""What the operators on embeddings have in common: sound rows and whole-number components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import nullable, whole_row

#: Components beyond this count as this much, so that sums and squares stay within reach.
LIMIT = 1 << 40


def whole_vectors(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """(_row, x): the other columns of rows, and floor(scale * component) of each component. Rows whose
    vector is null or holds null or non-finite components are dropped, and so are those with another
    number of components than most have (of equally frequent numbers, the larger counts)."""
    rest = rows.drop(vector)
    kind = nullable(rest.select(whole_row(rest)).schema["_row"].dataType)
    c = F.col(f"`{vector}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT))))
    sound = rows.where(c.isNotNull() & F.forall(c, finite))
    size = sound.groupBy(F.size(c).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).select("size").first()
    sound = sound.where(F.size(c) == (size["size"] if size else 0))
    return sound.select(whole_row(rest).cast(kind).alias("_row"), F.transform(c, whole).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // len(column) if len(column) else 0)


def safe(x: np.ndarray, largest: int) -> np.ndarray:
    """x as Python's whole numbers where results of the size given would leave 64 bits."""
    return x if largest < 1 << 62 else x.astype(object)


def saturated(values: np.ndarray) -> np.ndarray:
    """Python's whole numbers as int64; what is larger becomes the largest."""
    return values if values.dtype != object else np.array([min(int(v), (1 << 63) - 1) for v in values], np.int64)
