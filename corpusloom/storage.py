"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_scope: ContextVar[str] = ContextVar("scope", default="tables")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Unset, a local session (tests) gets a temporary folder of its own; a cluster must name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


ROWS_A_FILE = 50_000


def materialise(df: DataFrame, label: str, most: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, and an executor
    that is lost takes nothing with it. It stays until drop_materialised(). most: how many slim rows df
    has at most, if that is known; they go to files of ROWS_A_FILE, not to one for each task."""
    if most is not None:
        df = df.coalesce(max(1, -(-most // ROWS_A_FILE)))
    path = own_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_path(spark: SparkSession, label: str) -> str:
    """A new folder for something that this application stores, in the present scope."""
    return f"{_own_dir(spark)}/{_scope.get()}/{label}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpusloom-{spark.sparkContext.applicationId}"


@contextmanager
def scope(name: str) -> Iterator[None]:
    """What is materialised inside can be dropped by this name."""
    before = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(before)


def drop_materialised(spark: SparkSession, name: str | None = None) -> None:
    """Deletes what this application has written with materialise(), all of it or one scope's. Call it
    when results are stored."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{_own_dir(spark)}/{name}" if name else _own_dir(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
