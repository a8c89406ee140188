"""Sharding: the law, slots and groups on whole tables; differencing on numbers."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from corpusloom.llm import sharding

SCHEMA = "doc_id long, text string"


def spread(sizes, places, k=8):
    sums = [0] * k
    for s, p in zip(sizes, places, strict=True):
        sums[p] += s
    return max(sums) - min(sums)


def test_differencing():
    assert spread([8, 7, 6, 5, 4], sharding.partition([8, 7, 6, 5, 4], 2), 2) <= 2
    rng = random.Random(0)
    sizes = [int(rng.lognormvariate(8, 1)) for _ in range(2000)]
    assert spread(sizes, sharding.partition(sizes)) <= 8
    assert sharding.partition([]) == [] and len(set(sharding.partition([5] * 8))) == 8


def check(rows, docs):
    assert len(rows) == len(docs)
    shard_of, slots, bytes_of = {}, defaultdict(list), defaultdict(int)
    text_of = defaultdict(list)
    for d, t in docs:
        text_of[d].append(t or "")
    for r in rows:
        slots[r.shard].append(r.slot)
        bytes_of[r.shard] += r.size
    for s, found in slots.items():
        assert 0 <= s < 8 and sorted(found) == list(range(len(found)))
    return bytes_of, shard_of


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = sharding.op9_shards(spark, sf).collect()
    bytes_of, _ = check(rows, docs)
    text = dict(docs)
    of_text = defaultdict(set)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        of_text[text[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 0.001 * sum(bytes_of.values())


def test_many_bins(spark, sf, monkeypatch):
    monkeypatch.setattr(sharding, "BIN", 7)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bytes_of, _ = check(sharding.op9_shards(spark, sf).collect(), docs)
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 0.02 * sum(bytes_of.values())


@pytest.mark.parametrize("part, fullest", [(0.1, 1), (0.05, 1), (1 / 3, 8 / 3)])
def test_heavy_group_in_many_bins(spark, monkeypatch, part, fullest):
    monkeypatch.setattr(sharding, "BIN", 2000)
    rng = random.Random(1)
    sizes = [int(rng.lognormvariate(8, 1)) + 1 for _ in range(10_000)]
    sizes.append(int(sum(sizes) * part / (1 - part)))
    of = {hashlib.sha256(str(i).encode()).hexdigest(): s for i, s in enumerate(sizes)}
    rows = sharding.shard_groups(spark.createDataFrame(list(of.items()), "digest string, bytes long")).collect()
    assert sorted(r.digest for r in rows) == sorted(of)
    sums = defaultdict(int)
    for r in rows:
        sums[r.shard] += of[r.digest]
    levels = sorted(sums.values())
    assert levels[-1] <= fullest * 1.001 * sum(sizes) / 8
    assert levels[-2] - levels[0] <= 0.001 * sum(sizes) / 8


@pytest.mark.parametrize("part", [0.1, 0.05, 0.001])
def test_more_bins_than_the_driver_takes(spark, monkeypatch, part):
    """Bins are folded twice before the driver sees them."""
    for name, value in (("BIN", 50), ("MAX_BINS", 4), ("FOLD", 8)):
        monkeypatch.setattr(sharding, name, value)
    rng = random.Random(6)
    sizes = [int(rng.lognormvariate(8, 1)) + 1 for _ in range(10_000)]
    sizes.append(int(sum(sizes) * part / (1 - part)))
    of = {hashlib.sha256(str(i).encode()).hexdigest(): s for i, s in enumerate(sizes)}
    rows = sharding.shard_groups(spark.createDataFrame(list(of.items()), "digest string, bytes long")).collect()
    assert sorted(r.digest for r in rows) == sorted(of)
    sums = defaultdict(int)
    for r in rows:
        sums[r.shard] += of[r.digest]
    assert max(sums.values()) - min(sums.values()) <= 0.001 * sum(sizes) / 8


def test_no_task_holds_more_than_a_bin(spark, monkeypatch):
    """A heavy tail, in all octaves: whatever tier, the groups of a task are about BIN, and the shards are level."""
    monkeypatch.setattr(sharding, "BIN", 500)
    rng = random.Random(9)
    sizes = [int(100 * rng.paretovariate(1.3)) for _ in range(60_000)]
    of = {hashlib.sha256(str(i).encode()).hexdigest(): s for i, s in enumerate(sizes)}
    held, keep = [], sharding.materialise

    def spy(df, label, *more):
        out = keep(df, label, *more)
        if label == "shard-places":
            held.append(out.groupBy("bin").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(sharding, "materialise", spy)
    rows = sharding.shard_groups(spark.createDataFrame(list(of.items()), "digest string, bytes long")).collect()
    assert len(rows) == len(of) == len({r.digest for r in rows})
    assert len(held) >= 3 and max(held) <= 1.3 * 500, held
    sums = defaultdict(int)
    for r in rows:
        sums[r.shard] += of[r.digest]
    assert max(sums.values()) - min(sums.values()) <= 0.001 * sum(sizes) / 8


def test_tiers(monkeypatch):
    monkeypatch.setattr(sharding, "BIN", 100)
    assert sharding.tiers({5: 90}) == [(0, 65)] and sharding.tiers({}) == [(0, 65)]
    assert sharding.tiers({20: 1, 19: 50, 18: 60, 17: 70, 5: 900}) == [(19, 65), (18, 19), (17, 18), (0, 17)]
    assert sharding.tiers({20: 5000, 5: 10}) == [(0, 65)]


def test_edge_rows(spark):
    docs = [(1, None), (1, ""), (None, "x"), (None, "x"), (2, "y" * 50_000)]
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS shard", "2 AS digest", "3 AS size")
    rows = sharding.shard_documents(frame).collect()
    check(rows, docs)
    assert len({r.shard for r in rows if r.size == 1}) == 1 and len({r.shard for r in rows if r.size == 2}) == 1
    assert sharding.shard_documents(frame.where("false")).collect() == []
