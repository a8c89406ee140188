"""Streams: new files as they come, rates and gaps of events.

The file source sees new paths only; edits and deletions need the batch diff of operators.ingest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import shared_dir


def new_files(spark: SparkSession, path: str, a_trigger: int = 1000) -> DataFrame:
    """A stream of (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", a_trigger).load(path)


def drain(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Everything there is now, batch by batch. write must be idempotent: a batch may come twice."""
    place = checkpoint or f"{shared_dir(stream.sparkSession)}/stream-{name}"
    stream.writeStream.foreachBatch(write).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()


def rate(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Adds recent: events with this key in the last seconds, itself included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    span = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(span))


def gaps(events: DataFrame, key: str, ts: str, order: str, stalled: int = 25) -> DataFrame:
    """Adds gap (seconds since the key's event before) and stalled."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    before = F.lag(seconds).over(Window.partitionBy(key).orderBy(ts, order))
    return events.withColumn("gap", F.round(seconds - before, 6)).withColumn("stalled", F.coalesce(F.col("gap") > stalled, F.lit(False)))


def windowed_counts(events: DataFrame, ts: str, key: str, length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and key; late ones are waited for. Works on streams and tables."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", length).alias("window"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.session_window("_ts", gap).alias("session"), key).agg(F.count("*").alias("n")).select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), key, "n")


#: A recognition service's error codes that no retry mends: of the key, of the file.
KEY_ERRORS = ("A0202", "A0211")
FILE_ERRORS = ("-60002", "-60004", "-60005", "-60006")


def error_class(code: Column) -> Column:
    """token (the key is wrong: stop the batch), fatal (the file is: don't retry) or transient."""
    c = F.upper(code)
    return F.when(c.isin(*KEY_ERRORS), "token").when(c.isin(*FILE_ERRORS), "fatal").otherwise("transient")


def retry_delay(attempt: Column, jitter: Column, retry_after: Column, most: float = 60.0) -> Column:
    """Seconds before the next try: what the server asks for, up to most; else 1, 2, 4, ... up to most, and
    up to as much again (jitter is in 0..1)."""
    base = F.least(F.lit(most), F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))
    return F.when(retry_after > 0, F.least(retry_after, F.lit(most))).otherwise(base * (1 + jitter))


def slot_wait(log: DataFrame, ts: str, now: Column, limit: int, seconds: int = 60) -> DataFrame:
    """One row: wait, the seconds until fewer than limit submissions lie in the last seconds."""
    age = F.unix_micros(now) - F.unix_micros(F.col(ts).cast("timestamp"))
    live = log.select(age.alias("age")).where(F.col("age") < seconds * 1_000_000)
    first = live.agg(F.count("*").alias("n"), F.max("age").alias("oldest"))
    return first.select(F.when(F.lit(limit <= 0) | (F.col("n") < limit), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), seconds - F.col("oldest") / 1e6)).alias("wait"))
