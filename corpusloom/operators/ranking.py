"""Ranks over a whole table without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the row number in the given total order: rows are dealt by range, numbered inside their range,
    and offset by the sizes of the ranges before."""
    dealt = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))  # a row for each partition
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    numbered = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.join(offsets, "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")


def group_rank(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Adds the row number within each group, also without a single task for a large group: ranks over the
    whole table by group and order, less those of the groups before."""
    ranked = global_rank(df, [F.col(group), *order], name)
    first = ranked.groupBy(F.col(group).alias("_group")).agg(F.min(name).alias("_first"))  # a row for each group
    return ranked.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_group", "_first")
