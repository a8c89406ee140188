"""Sharding by Karmarkar-Karp differencing.

Documents with equal texts form a group that must not be split. A partial partition is eight sums with
their members; differencing repeatedly takes the two with the largest spread (largest minus smallest
sum) and adds them oppositely ordered, which cancels most of both spreads.

The groups are reduced to (digest, bytes) before any of this. They are dealt to bins by digest, at
most about ``BIN`` groups each, and each bin is differenced in a task of its own; what is left of a bin
is a partial partition like any other: while there are more than ``MAX_BINS`` bins, the eight sums of about
``FOLD`` bins each are differenced in tasks and make one bin; then the driver differences the bins' sums
(never the groups). So neither a task nor the driver holds more than a stated number of them. A document finds its shard by
its group's digest; slots are numbered with two-level counts, so that a shard needs no single task.

Bins that are level each for itself cannot offset a group that is larger than a bin can level. So groups
go in tiers by octaves of sizes (powers of two), the heaviest first: as many octaves as one bin holds; then
one by one those that have at most ``HEAVY`` groups a bin; then the rest, whose groups are no larger than an
eighth of the mean bin. Each tier has bins of its own, of ``BIN`` groups like all others. A tier's bins are differenced
together with their share of the eight sums that the tiers before have left, which leaves room for them in
proportion, and the driver differences these sums and those of the tier's bins, without the shares.

Law: ``bytes``. Defined results: a null text has no bytes, so size 1; texts have any length (only digests
and sizes leave the tasks that read them); groups that tie in size go by digest; the null text and the empty text
are one group; rows with equal or null doc_id are documents of their own; an empty table gives an empty
result. Extra columns are never read by name.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, local_rows, materialise

SHARDS = 8
BIN = 20_000
MAX_BINS = 1 << 14
FOLD = 1 << 11
HEAVY = 16
SLOT_BUCKETS = 4096


def difference(parts: list[tuple[list[int], list]]) -> tuple[list[int], list]:
    """parts: (sums, members), as many of each as there are shards; a member is a leaf or a pair of
    members, or None. Returns the one that is left, its sums in descending order."""
    order = lambda part: sorted(zip(*part, strict=True), key=lambda x: -x[0])
    heap = []
    for i, part in enumerate(parts):
        slots = order(part)
        heap.append((slots[-1][0] - slots[0][0], i, slots))
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        slots = [(x + y, (m, n) if m is not None and n is not None else m if n is None else n) for (x, m), (y, n) in zip(a, reversed(b), strict=True)]
        slots.sort(key=lambda x: -x[0])
        heapq.heapreplace(heap, (slots[-1][0] - slots[0][0], tick, slots))
        tick += 1
    slots = heap[0][2]
    return [s for s, _ in slots], [m for _, m in slots]


class Leaf(NamedTuple):
    """A member that is a tuple itself."""

    value: tuple


def leaves(member) -> Iterator:
    todo = [member]
    while todo:
        m = todo.pop()
        if isinstance(m, Leaf):
            yield m.value
        elif isinstance(m, tuple):
            todo += m
        elif m is not None:
            yield m


def combine(parts: list[tuple[list[int], list]], beside: list[int] | None = None) -> list[list]:
    """The leaves of each place (0: the largest sum). beside: sums that are there already, one for each
    place; places are then numbered by what they and the parts sum up to."""
    if not parts:
        return []
    if beside and any(beside):
        parts = [*parts, (beside, [None] * len(beside))]
    return [list(leaves(member)) for member in difference(parts)[1]]


def partition(sizes: list[int], shards: int = SHARDS, beside: list[int] | None = None) -> list[int]:
    """The place of each of the sizes."""
    place = [0] * len(sizes)
    for k, found in enumerate(combine([([s] + [0] * (shards - 1), [i] + [None] * (shards - 1)) for i, s in enumerate(sizes)], beside)):
        for i in found:
            place[i] = k
    return place


def _sums(placed: DataFrame, shards: int) -> dict[int, list[int]]:
    """The sums of each bin by place."""
    sums: dict[int, list[int]] = {}
    for r in placed.groupBy("bin", "place").agg(F.sum("bytes").alias("bytes")).collect():  # a row for each bin and place
        sums.setdefault(r["bin"], [0] * shards)[r["place"]] = r["bytes"]
    return sums


def tiers(octaves: dict[int, int]) -> list[tuple[int, int]]:
    """Ranges of octaves (from, below), the heaviest first. octaves: the number of groups in each."""
    bins = max(1, -(-sum(octaves.values()) // BIN))
    if bins == 1:
        return [(0, 65)]
    first = heavy = 65
    taken, few = 0, True
    for octave in sorted(octaves, reverse=True):
        if octaves[octave] > HEAVY * bins:
            break
        heavy, taken = octave, taken + octaves[octave]
        few = few and taken <= BIN
        first = octave if few else first
    edges = [65, first, *sorted((o for o in octaves if heavy <= o < first), reverse=True), 0]
    return [(low, high) for high, low in zip(edges, edges[1:]) if low < high]


def shard_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """groups: digest (string, hexadecimal), bytes. Returns digest, shard."""
    spark = groups.sparkSession
    octave = F.length(F.bin("bytes"))
    octaves = groups.groupBy(octave.alias("octave")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()  # at most 64 rows

    def placed_in(dealt: DataFrame, beside: list[int], of: int) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("digest", kind="stable")
            sizes = pdf["bytes"].tolist()
            share = [x * sum(sizes) // of for x in beside]
            return pdf.assign(place=partition(sizes, shards, share))

        return materialise(dealt.groupBy("bin").applyInPandas(run, "digest string, bytes long, bin int, place int"), "shard-places")

    def folded(placed: DataFrame, into: int, beside: list[int], of: int) -> DataFrame:
        """placed with the bins' sums combined into fewer bins."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = []
            for number, rows in pdf.sort_values(["bin", "place"], kind="stable").groupby("bin"):
                held = [0] * shards
                for k, n in zip(rows["place"].tolist(), rows["bytes"].tolist(), strict=True):
                    held[k] = n
                parts.append((held, [(number, k) for k in range(shards)]))
            share = [x * int(pdf["bytes"].sum()) // of for x in beside]
            found = [(number, place, k) for k, members in enumerate(combine([(h, [Leaf(x) for x in ids]) for h, ids in parts], share)) for number, place in members]
            return pd.DataFrame(found, columns=["of_bin", "of_place", "new_place"]).assign(new_bin=pdf["fold"].iloc[0])

        sums = placed.groupBy("bin", "place").agg(F.sum("bytes").alias("bytes")).withColumn("fold", F.pmod(F.xxhash64("bin"), F.lit(into)).cast("int"))
        moved = sums.groupBy("fold").applyInPandas(run, "of_bin int, of_place int, new_place int, new_bin int")
        found = placed.join(moved, (F.col("bin") == F.col("of_bin")) & (F.col("place") == F.col("of_place")))
        return materialise(found.select("digest", "bytes", F.col("new_bin").alias("bin"), F.col("new_place").alias("place")), "shard-places")

    settled, totals = groups.limit(0).select("digest", F.lit(0).alias("shard")), [0] * shards
    for low, high in tiers({r["octave"]: r["n"] for r in octaves}):
        inside = [r for r in octaves if low <= r["octave"] < high]
        bins, size = max(1, -(-sum(r["n"] for r in inside) // BIN)), max(1, sum(r["bytes"] for r in inside))
        dealt = groups.where((octave >= low) & (octave < high)).withColumn("bin", F.pmod(F.xxhash64("digest"), F.lit(bins)).cast("int"))
        placed = placed_in(dealt, totals, size)
        while bins > MAX_BINS:
            bins = -(-bins // FOLD)
            placed = folded(placed, bins, totals, size)
        sums = _sums(placed, shards)
        if any(totals):
            sums[-1] = totals
        chosen, totals = [], [0] * shards
        parts = [(held, [f"{b}/{k}" for k in range(shards)]) for b, held in sorted(sums.items())]
        for shard, member in enumerate(difference(parts)[1] if parts else []):
            for of_bin, place in (map(int, x.split("/")) for x in leaves(member)):
                chosen.append({"bin": of_bin, "place": place, "shard": shard})
                totals[shard] += sums[of_bin][place]
        # MAX_BINS * shards rows of three integers
        table = F.broadcast(local_rows(spark, json.dumps(chosen), "bin int, place int, shard int"))
        before = settled.withColumnRenamed("shard", "place").withColumn("bin", F.lit(-1))
        settled = before.unionByName(placed.select("digest", "bin", "place")).join(table, ["bin", "place"]).select("digest", "shard")
    return settled


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, size, text_crc32, shard, slot."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.sha2(raw, 256).alias("digest"))
    slim = materialise(slim, "shard-docs")
    groups = materialise(slim.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = shard_groups(groups, shards).withColumnRenamed("digest", "of")
    found = slim.join(placed, F.col("digest") == F.col("of")).drop("of")
    found = materialise(found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SLOT_BUCKETS)).cast("int")), "shard-found")
    counts = found.groupBy("shard", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest"))
    numbered = found.withColumn("n", inside).join(offsets, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"))


def op9_shards(spark, sf_dir: str) -> DataFrame:
    """op9: the shard and slot of every document, by the law of near-equal bytes."""
    found = shard_documents(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
