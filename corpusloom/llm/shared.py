"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from ..storage import materialise, shared_dir

__all__ = ["SPACE", "documents", "local_rows", "materialise", "nullable", "shared_dir", "table", "whole_row"]

#: Fixed value: the white space of every contract, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def whole_row(df: DataFrame, alias: str = "_row") -> Column:
    """All columns of df as one struct, so that their names cannot clash with an operator's own."""
    columns = [F.col(f"`{c}`") for c in df.columns] or [F.lit(None).cast("int").alias("_nothing")]
    return F.struct(*columns).alias(alias)


def nullable(kind: DataType) -> DataType:
    """The type with nulls allowed everywhere, which is how Arrow functions return it."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, nullable(f.dataType)) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(nullable(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


def local_rows(spark: SparkSession, json_array: str, schema: str) -> DataFrame:
    """A small driver-side table (JSON text of an array of objects) without leaving the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json_array), f"array<struct<{schema}>>")))
