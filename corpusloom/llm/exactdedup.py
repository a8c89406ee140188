"""Exact deduplication through an extendible-hash index on shared files (DataFrame operations only).

Entries (doc_id, 64-bit hash, SHA-256) of all documents go to a shared file. The directory addresses
the hash by its first bits: it starts with one bucket and doubles while a bucket holds more than
``capacity`` distinct keys, splitting overfull buckets, up to 2^16 slots (beyond that depth buckets
grow). It is written beside the index and says where everything goes:

* texts move to the task that owns their bucket, a range of hashes; there texts with the same hash are
  chained and told apart by their bytes. Hashes that have 1/HEAVY of all rows or more (so HEAVY of them
  at most) are combined in the tasks that read them first, so that a text that fills a third of the
  rows moves as a row for each of those tasks;
* records, without texts, go to the index files sorted by key range, a number for each in its chain;
* an entry finds its record through its slot and bucket, then in the bucket by hash and SHA-256. Records
  of heavy hashes are broadcast, so no key is hot in the look-up.

Defined results: a null text counts as empty; texts are equal when identical after replacing each run
of white space by one space; texts of any length are compared whole. A null doc_id is larger than any
other; of rows equal in both doc_id and text one stays. An empty table gives an empty result. Only
doc_id and text are read by name, other columns are kept in a struct, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, local_rows, materialise, whole_row

SLOT_BITS = 16
CAPACITY = 64  # distinct keys in a bucket
HEAVY = 1024  # hashes with 1/HEAVY of all rows or more are heavy


def normalised(text: Column) -> Column:
    """Each run of white space as one space. Single spaces, the common case, are not rewritten."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - SLOT_BITS).cast("int")


def double_directory(counts: Sequence[int], capacity: int) -> list[tuple[int, int, int]]:
    """counts: keys for each of the 2^k finest slots. Buckets as (first slot, slots, local depth)."""
    bits = (len(counts) - 1).bit_length()
    todo, done = [(0, len(counts), 0)], []
    while todo:
        first, width, depth = todo.pop()
        if depth < bits and sum(counts[first : first + width]) > capacity:
            half = width // 2
            todo += [(first + half, half, depth + 1), (first, half, depth + 1)]
        else:
            done.append((first, width, depth))
    return done


def directory(entries: DataFrame, capacity: int) -> DataFrame:
    """(slot, bucket): 2^16 rows at any size of the input. The driver gets one count for each slot."""
    keys = entries.select("h").distinct().groupBy(slot(F.col("h")).alias("slot")).count()
    counts = [0] * (1 << SLOT_BITS)
    for r in keys.collect():  # at most 2^SLOT_BITS rows
        counts[r["slot"]] = r["count"]
    buckets = [{"first": a, "width": n, "bucket": i} for i, (a, n, _) in enumerate(sorted(double_directory(counts, capacity)))]
    ranges = local_rows(entries.sparkSession, json.dumps(buckets), "first int, width int, bucket int")
    return materialise(ranges.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("width") - 1)).alias("slot"), "bucket"), "dedup-directory")


def in_bucket(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (h and whatever else) with the bucket that the directory names."""
    return rows.withColumn("slot", slot(F.col("h"))).join(F.broadcast(found), "slot").drop("slot")  # 2^16 rows of two integers


def heavy_hashes(entries: DataFrame) -> list[int]:
    """The hashes of 1/HEAVY of all rows or more: HEAVY at most."""
    total = entries.agg(F.sum("copies").alias("n")).first()["n"] or 0
    counts = entries.groupBy("h").agg(F.sum("copies").alias("n"))
    return [r["h"] for r in counts.where(F.col("n") * HEAVY >= F.lit(total)).select("h").collect()]


class Index(NamedTuple):
    """On shared files. entries: doc_id, h, sha, copies (rows with this doc_id and text). directory: slot,
    bucket. records: bucket, h, chain, sha, keep_id, group_size. heavy: hashes."""

    entries: DataFrame
    directory: DataFrame
    records: DataFrame
    heavy: list[int]


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> Index:
    """docs: doc_id, text."""
    norm = normalised(F.col("text"))
    entries = docs.select("doc_id", norm.alias("norm")).select("doc_id", F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    entries = materialise(entries.groupBy("doc_id", "h", "sha").agg(F.count("*").alias("copies")), "dedup-entries")
    where, heavy = directory(entries, capacity), heavy_hashes(entries)
    texts = in_bucket(docs.select("doc_id", norm.alias("norm")).withColumn("h", F.xxhash64("norm")), where)
    told_apart = lambda rows: rows.groupBy("bucket", "h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    many = F.col("h").isin(heavy) if heavy else F.lit(False)
    owned = told_apart(texts.where(many)).unionByName(told_apart(texts.where(~many).repartition("bucket")))
    records = owned.select("bucket", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    records = records.repartitionByRange("bucket", "h").withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha")))
    return Index(entries, where, materialise(records.sortWithinPartitions("bucket", "h", "chain"), "dedup-index"), heavy)


def look_up(index: Index) -> DataFrame:
    """Each entry with its record: doc_id, h, sha, copies, keep_id, group_size."""
    rows = in_bucket(index.entries, index.directory)
    found = index.records.select(*[F.col(c).alias(f"of_{c}") for c in ("bucket", "h", "sha")], "keep_id", "group_size")
    same = (F.col("bucket") == F.col("of_bucket")) & (F.col("h") == F.col("of_h")) & (F.col("sha") == F.col("of_sha"))
    if not index.heavy:
        return rows.join(found, same)
    light, many = rows.where(~F.col("h").isin(index.heavy)), rows.where(F.col("h").isin(index.heavy))
    # records of HEAVY hashes; a hash has more than one record only where 64 bits collide
    return light.join(found.where(~F.col("of_h").isin(index.heavy)), same).unionByName(many.join(F.broadcast(found.where(F.col("of_h").isin(index.heavy))), same))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay: of equal texts the one with the smallest doc_id."""
    index = build_index(docs.select("doc_id", "text"), capacity)
    # a row is looked up by its doc_id too: of the many rows of a heavy text all but one find nothing
    key = lambda of: F.col("id").eqNullSafe(F.col(f"{of}_id")) & (F.col("h") == F.col(f"{of}_h")) & (F.col("sha") == F.col(f"{of}_sha"))
    kept = index.records.select(F.col("keep_id").alias("id"), "h", "sha").join(
        index.entries.select(F.col("doc_id").alias("one_id"), F.col("h").alias("one_h"), F.col("sha").alias("one_sha"), "copies"), key("one")
    )
    kept = kept.select("one_id", "one_h", "one_sha", "copies")
    norm = normalised(F.col("text"))
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("id"), norm.alias("norm")).select("_row", "id", F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    found = rows.join(kept, key("one"))
    once = found.where("copies = 1").select("_row")
    # rows repeated with their doc_id: one of them, chosen by its other columns
    again = found.where("copies > 1").groupBy("id", "h", "sha").agg(F.min("_row").alias("_row")).select("_row")
    return once.unionByName(again).select("_row.*")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """op5: a row for each document with its group."""
    found = look_up(build_index(documents(spark, sf_dir, "doc_id", "text")))
    found = found.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
        row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS n FROM d)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM g
"""
