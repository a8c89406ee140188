"""Export packages: rows as JSON lines with a manifest, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import cosine

SAME_VECTOR = 1 - 1e-6


def export(chunks: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Writes payload (id, text, embedding, meta) and manifest (rel, sha256, size) under path and returns
    the manifest. Rows are sorted by id within files, so equal tables give equal payloads."""
    chunks.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("compression", "gzip").json(f"{path}/payload")
    manifest(files).write.mode("overwrite").json(f"{path}/manifest")
    return files.sparkSession.read.schema("rel string, sha256 string, size long").json(f"{path}/manifest")


def manifest(files: DataFrame) -> DataFrame:
    return files.select("rel", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(rel, problem): missing, unexpected or mismatch, from two manifests; no row means sound."""
    a = actual.select("rel", F.col("sha256").alias("got"), F.col("size").alias("got_size"))
    both = expected.join(a, "rel", "full")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when((F.col("sha256") != F.col("got")) | (F.col("size") != F.col("got_size")), "mismatch")
    return both.select("rel", problem.alias("problem")).where("problem IS NOT NULL")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, text string, embedding array<double>, meta map<string,string>").json(f"{path}/payload")


def same_vectors(a: DataFrame, b: DataFrame, samples: int = 3, seed: int = 0) -> DataFrame:
    """(id, same) of a few rows, chosen by hash: whether their vectors agree."""
    some = a.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(samples).select("id", F.col("embedding").alias("x"))
    return some.join(b.select("id", F.col("embedding").alias("y")), "id", "left").select("id", F.coalesce(cosine(F.col("x"), F.col("y")) >= SAME_VECTOR, F.lit(False)).alias("same"))


def safe_member(name: Column) -> Column:
    """Whether a packed file's name stays inside the folder it is unpacked to."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    return (name != "") & ~name.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.array_contains(parts, "..")
