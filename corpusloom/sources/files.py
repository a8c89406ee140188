"""Folders of files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped, suffix

TEXT_SUFFIXES = ("md", "txt")


def exists(spark: SparkSession, root: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def listing(spark: SparkSession, root: str, lib: str) -> DataFrame:
    """(lib, rel, path, size, mtime_ns), without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _paths(files, root, lib).select("lib", "rel", "path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def _paths(files: DataFrame, root: str, lib: str) -> DataFrame:
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    bare = F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?", "")
    return files.withColumns({"lib": F.lit(lib), "rel": F.regexp_replace(bare, F.lit("^" + _quoted(base)), F.lit(""))})


def _quoted(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def fingerprint(content: Column) -> Column:
    return F.coalesce(F.md5(content), F.lit("unreadable"))


def decoded(content: Column) -> Column:
    """UTF-8 with invalid bytes replaced; blank texts are null."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(stripped(text) != "", text)


def read(spark: SparkSession, root: str, lib: str, only: list[str] | None = None) -> DataFrame:
    """(lib, rel, size, mtime_ns, hash, text, content): text of text files, content of others. only: the
    paths of the files to read; else all below root are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root if only is None else only)
    plain = suffix(F.col("rel")).isin(*TEXT_SUFFIXES)
    return _paths(files, root, lib).select(
        "lib", "rel", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), fingerprint(F.col("content")).alias("hash"),
        F.when(plain, decoded(F.col("content"))).alias("text"), F.when(~plain, F.col("content")).alias("content"),
    )


def log_lines(spark: SparkSession, path: str, mention: str, last: int = 3) -> DataFrame:
    """(pos, line): the last lines of a log that mention something. A log is read in splits, line by line:
    partitions follow its order, so a line's place is its partition and its number there."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("pos"))
    found = lines.where(F.contains("value", F.lit(mention))).orderBy(F.desc("pos")).limit(last)
    return found.orderBy("pos").select("pos", F.col("value").alias("line"))
