"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the component; nodes without an edge are absent.

    Each round links every larger neighbour of a node to the smallest node around it, then every
    smaller neighbour; both minima are aggregates with map-side combination and the joins are plain
    equi-joins, so a hub is split. The number of rounds grows with the logarithm of the number of
    nodes, not with the diameter. Rounds are written to files in proportion to the edges, which never
    become more. Edges with a null end and loops are ignored.
    """
    x, y = F.col("x"), F.col("y")
    sound = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    pairs = edges.where(sound).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    links, before = materialise(pairs.distinct(), "links"), None
    for _ in range(max_rounds):
        now = links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("x", "y")), F.lit(0))).first()
        if before == now:
            return links.select(x.alias("node"), y.alias("root")).unionByName(links.select(y.alias("node"), y.alias("root")).distinct())
        before = now
        both = links.unionByName(links.select(y.alias("x"), x.alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(x.alias("u"), F.least("x", "m").alias("m"))
        large = both.where(y > x).join(least, x == F.col("u")).select(y.alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m")).select(x.alias("u"), "m")
        small = large.join(least, x == F.col("u")).where(y != F.col("m")).select(y.alias("x"), F.col("m").alias("y"))
        links = materialise(small.unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y"))).distinct(), "links", now[0])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
