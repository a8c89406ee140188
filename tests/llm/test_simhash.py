"""SimHash: fingerprints and components against brute force."""

import random

import xxhash
from pyspark.sql import types as T

from corpusloom.llm import simhash

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """fps: {doc_id: fingerprint} -> {doc_id: smallest doc_id reachable}."""
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_fingerprint():
    rng = random.Random(0)
    for text in ["", None, "One", "one TWO", "a b c", "É é x y\tz\n", " ".join(rng.choice("abcdef") for _ in range(40_000))]:
        assert simhash.fingerprint(None if text is None else text.encode()) & (2**64 - 1) == slow_fingerprint(text)


def test_links_up_to_three_bits(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        seed = rng.getrandbits(64)
        fps.add(seed)
        for d in (1, 2, 3, 3, 4, 5):
            fps.add(seed ^ sum(1 << i for i in rng.sample(range(64), d)))
    fps |= {0, 1, 7, 15, 2**63, 2**64 - 1}
    marked = spark.createDataFrame([(i, i, simhash._signed(f)) for i, f in enumerate(sorted(fps))], "doc_id long, text_hash long, fp long")
    got = {r.doc_id: r.component_id for r in marked.join(simhash.near_components(marked), "fp").collect()}
    assert got == slow_components(dict(enumerate(sorted(fps))))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, sf).collect()}
    roots = slow_components(fps)
    assert got == {d: (f"{f:016x}", roots[d]) for d, f in fps.items()}


def test_edge_rows(spark):
    rows = [(3, None), (2, ""), (None, " \t "), (5, "a b c d"), (4, "A  B c D"), (4, "A  B c D"), (9, "other words stand here now")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS fp", "'x' AS component_id", "2 AS variant")
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, ""), (4, "A  B c D"), (9, "other words stand here now")]
    assert simhash.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    assert isinstance(kept.schema["doc_id"].dataType, T.LongType)
