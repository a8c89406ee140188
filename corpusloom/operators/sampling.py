"""Representative rows by farthest-point sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..storage import materialise

K = 20


def _gap(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def farthest_points(vectors: DataFrame, group: str, key: str, vector: str, k: int = K) -> DataFrame:
    """(group, step, key): k rows of each group, starting at the smallest key; each next one is farthest
    (Euclidean) from those chosen; the smallest key wins a tie. Groups of up to k rows return whole,
    without rows at a distance of zero from those chosen.

    All groups advance together, one aggregate with map-side combination a step, so there may be any
    number of them and none is gathered anywhere. What is chosen (k rows a group) is a table that each
    step joins; the driver sees none of it.
    """
    base = vectors.select(F.col(group).alias("g"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    base = materialise(base.where("v IS NOT NULL"), "points")
    point = F.struct("id", "v")
    chosen = materialise(base.groupBy("g").agg(F.min(point).alias("p")).select("g", F.lit(0).alias("step"), "p.id", "p.v"), "chosen")
    for step in range(1, k):
        places = chosen.groupBy(F.col("g").alias("of")).agg(F.collect_list(point).alias("places"))  # fewer than k each
        near = lambda v, ps: F.array_min(F.transform(ps, lambda p: _gap(v, p["v"])))
        far = base.join(places, F.col("g").eqNullSafe(F.col("of"))).where(~F.exists("places", lambda p: p["id"] == F.col("id")))
        far = far.select("g", "id", "v", let(F.col("places"), lambda ps: near(F.col("v"), ps)).alias("gap")).where("gap > 0")
        best = far.groupBy("g").agg(F.min(F.struct((-F.col("gap")).alias("near"), "id", "v")).alias("p"))
        more = materialise(best.select("g", F.lit(step).alias("step"), "p.id", "p.v"), "chosen")
        if more.isEmpty():
            break
        chosen = chosen.unionByName(more)
    return chosen.select(F.col("g").alias(group), "step", F.col("id").alias(key))
