"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints (64 bits, radius 3) meet halfway: of two that differ in 3 bits, one walks one bit and the
other two. The two-bit walks are needed only inside a half of the word: three differing bits have two
in the low or two in the high half. Fingerprints of odd parity walk pairs in the low half, even ones
pairs in the high half (two at distance 3 have opposite parity), so each emits itself, its 64 one-bit
variants and 496 two-bit variants. The shuffle is on the variant; a fingerprint's variants for the
same partition travel together, as numbers of bit masks, two bytes each.

All fingerprints are distinct here (copies are grouped first), so at most 65 + 496 can share a
variant: no group is hot. Those at most one bit from the variant are within 3 bits of all others in
the group; each member is verified against the closest one (a star), never all pairs against each
other. Stars then go through distributed connected components.

Defined results: a null text is the empty text, with fingerprint zero, linked like any other; texts have
any length, they are read some thousand shingles at a time; an empty table gives an empty result. Rows with
a null doc_id take part; component_id is the smallest doc_id that is not null. Repeated rows keep their
number. Where one document of each group stays, it is the row with the smallest (doc_id, hash of the
text), null last; of rows equal in both one stays. Extra columns are never read by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from ..operators.components import connected_components
from .shared import documents, materialise, whole_row

WORDS = 3
SEED = 42
RADIUS = 3
DESTINATIONS = 128  # partitions of the variants at least; more follow spark.sql.shuffle.partitions
_CHUNK = 255 * 64  # shingles at a time, so that a very long text needs no more memory


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit integer."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the contract's white space
    if not words:
        return 0
    if len(words) < WORDS:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)), len(words) - WORDS + 1
    set_bits = np.zeros(64, np.int64)
    while part := b"".join(map(xxh64_digest, islice(shingles, _CHUNK), repeat(SEED))):
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64)
        for k in range(0, len(bits), 255 * 16):  # sums of 255 rows fit a byte
            block = bits[k : k + 255 * 16]
            full = len(block) // 255 * 255
            set_bits += block[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            set_bits += block[full:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        found = pa.array((fingerprint(t.as_py()) for t in texts), pa.int64(), size=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), found], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks() -> np.ndarray:
    """(2, 561): what a fingerprint of even and of odd parity is flipped by; at most two bits."""
    near = [0, *(1 << i for i in range(64))]
    pairs = lambda lo: [1 << i | 1 << j for i in range(lo, lo + 32) for j in range(i + 1, lo + 32)]
    return np.array([near + pairs(32), near + pairs(0)], np.uint64)


def deal(fps: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """The balls of fps (uint64), packed by destination: (bucket, fp, flips), flips being the numbers of
    the masks whose variants go to that bucket. Each variant is sent as two bytes."""
    parity = np.bitwise_count(fps) & 1
    variants = fps[:, None] ^ masks()[parity]
    with np.errstate(over="ignore"):
        dest = ((variants * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(len(keys))).astype(np.uint32)
    order = np.argsort(dest, axis=1, kind="stable")
    where = np.take_along_axis(dest, order, axis=1).astype(np.int64) + np.arange(len(fps))[:, None] * len(keys)
    where = where.ravel()
    starts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    flips = pa.ListArray.from_arrays(pa.array(np.append(starts, len(where)), pa.int32()), pa.array(order.ravel().astype(np.int16)))
    columns = pa.array(keys[where[starts] % len(keys)], pa.int32()), pa.array(fps[where[starts] // len(keys)].view(np.int64)), flips
    return pa.RecordBatch.from_arrays([*columns], ["bucket", "fp", "flips"])


def bucket_keys(spark, n: int) -> np.ndarray:
    """An integer for each of n partitions that hash partitioning sends there."""
    found: dict[int, int] = {}
    size = 16 * n + 64
    while len(found) < n:
        ids = spark.range(size).select(F.col("id").cast("int").alias("key"))
        places = ids.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("place")).agg(F.min("key").alias("key"))
        found, size = {r["place"]: r["key"] for r in places.collect()}, 2 * size  # n rows
    return np.array([found[i] for i in range(n)], np.int32)


def links(fps: DataFrame) -> DataFrame:
    """(fp, center): pairs at 1 to 3 bits that connect what is connected. fps: distinct fp."""
    parts = max(DESTINATIONS, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = bucket_keys(fps.sparkSession, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(values), 2048):
                yield deal(values[i : i + 2048], keys)

    dealt = fps.select("fp").mapInArrow(run, "bucket int, fp long, flips array<smallint>").repartition(parts, "bucket")
    even, odd = (F.lit([_signed(int(m)) for m in row]).cast("array<bigint>") for row in masks())
    ball = dealt.select("bucket", "fp", F.explode("flips").alias("flip")).withColumn("flip", F.col("flip").cast("int") + 1)
    mask = F.when(F.bit_count("fp") % 2 == 1, F.element_at(odd, F.col("flip"))).otherwise(F.element_at(even, F.col("flip")))
    met = ball.select("bucket", "fp", F.bit_count(mask).alias("steps"), F.col("fp").bitwiseXOR(mask).alias("variant"))
    group = Window.partitionBy("variant", "bucket").orderBy("steps", "fp").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("center", F.first("fp").over(group)).where("fp != center")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("center"))) <= RADIUS).select("fp", "center").distinct()


def near_components(marked: DataFrame) -> DataFrame:
    """(fp, component_id, keep_hash) for each distinct fp of marked (doc_id, text_hash, fp)."""
    first = lambda a, b: F.struct(F.col(a).isNull().alias("none"), F.col(a).alias("id"), F.col(b).alias("hash"))
    fps = materialise(marked.groupBy("fp").agg(F.min(first("doc_id", "text_hash")).alias("least")), "simhash-fps", marked.count())
    roots = materialise(connected_components(links(fps.select("fp")), "fp", "center"), "simhash-roots", fps.count())
    linked = roots.withColumnRenamed("node", "fp")
    least = fps.join(linked, "fp").groupBy("root").agg(F.min("least").alias("of_root"))
    joined = fps.join(linked.join(least, "root").select("fp", "of_root"), "fp", "left").withColumn("least", F.coalesce("of_root", "least"))
    return joined.select("fp", F.col("least.id").alias("component_id"), F.col("least.hash").alias("keep_hash"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each component."""
    marked = materialise(fingerprints(docs), "simhash-marked")
    keep = near_components(marked).select(F.col("component_id").alias("id"), F.col("keep_hash").alias("hash"))
    copies = marked.groupBy(F.col("doc_id").alias("id2"), F.col("text_hash").alias("hash2")).count()
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2"))
    keep = keep.distinct().join(copies, same).select("id", "hash", "count")
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_hash"))
    found = rows.join(keep, F.col("doc").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    once = found.where("count = 1").select("_row")
    again = found.where("count > 1").groupBy("id", "hash").agg(F.min("_row").alias("_row")).select("_row")
    return once.unionByName(again).select("_row.*")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """op2: fingerprint and component of every document."""
    marked = materialise(fingerprints(documents(spark, sf_dir, "doc_id", "text")), "simhash-marked")
    found = marked.select("doc_id", "fp").join(near_components(marked).select("fp", "component_id"), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
