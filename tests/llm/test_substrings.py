"""Substring dedup: brute force, planted passages, estimates that never fall below counts, edge rows."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import substrings


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for w in words:
        out = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                out[i : i + window] = [True] * window
        yield len(w), sum(out), b" ".join(x for x, o in zip(w, out) if not o).decode()


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(d.doc_id, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, (n, m, k) in zip(docs, brute([d.text for d in docs], 35))}
    got = [tuple(r) for r in substrings.op11_substrings(spark, sf).collect()]
    assert len(got) == len(docs) and set(got) == want and sum(r[2] for r in got)


def test_planted_and_clean(spark):
    """A passage of 35 words is caught in texts that differ around it, one of 34 is not; few cells change nothing."""
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    long, short = fresh(35), fresh(34)
    texts = [f"{fresh(50)} {long} {fresh(i)}" for i in range(9)] + [f"{fresh(i)}\n{short}\t{fresh(40)}" for i in range(9)] + [fresh(400) for _ in range(20)]
    texts += ["a b " * 40, "z " * 36, "z " * 35, f"{long}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    want = {(i, *x) for i, x in enumerate(brute(texts, 35))}
    assert {w[2] for w in want if w[0] < 9} == {35} and not any(w[2] for w in want if 9 <= w[0] < 38)
    for room, size in ((4, 1 << 20), (4, 200), (0, 3000)):
        got = substrings.remove_repeats(docs, chunk_bytes=size, room=room).select("_row.doc_id", "n_words", "n_removed", "kept").collect()
        assert set(map(tuple, got)) == want and len(got) == len(texts)


def test_window_hashes():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    words[100:140] = words[200:240]
    found = substrings.window_hashes(words, 35)
    assert found.shape == (266, 2)
    want = [[sum(int(words[i + k, b]) * pow(int(substrings._BASES[b]), k, 1 << 64) for k in range(35)) % (1 << 64) for b in (0, 1)] for i in (0, 77, 265)]
    assert found[[0, 77, 265]].tolist() == want
    assert (found[100:106] == found[200:206]).all() and len(np.unique(found[:, 0])) == 260
    assert substrings.window_hashes(words[:34], 35).shape == (0, 2)


def test_estimates_never_fall_below_counts():
    """With too few cells windows are estimated repeated in vain, never the other way."""
    layout = substrings.Layout(10, 3, 3)
    rng = np.random.default_rng(2)
    chunks = [[" ".join(f"{x}" for x in rng.integers(0, 12, 60)).encode() for _ in range(4)] for _ in range(3)]
    asked = pa.concat_tables([substrings.sketch_messages(layout)(pa.table({"chunk": [i] * 4, "text": t})) for i, t in enumerate(chunks)])
    owners = set(asked.column("owner").to_pylist())
    of = lambda o: asked.filter(pa.compute.equal(asked.column("owner"), o))
    answers = pa.concat_tables([substrings.merge_sketches(layout)(of(o)) for o in owners])
    counts = Counter(tuple(w[i : i + 3]) for ts in chunks for w in (t.split() for t in ts) for i in range(len(w) - 2))
    wrong = 0
    for i, texts in enumerate(chunks):
        mine = answers.filter(pa.compute.equal(answers.column("chunk"), i))
        hot = substrings.Chunk(texts, layout).estimated(substrings._answers(mine, 0, layout))
        true = [counts[tuple(w[j : j + 3])] > 1 for w in (t.split() for t in texts) for j in range(len(w) - 2)]
        assert all(h >= t for h, t in zip(hot, true, strict=True))
        wrong += sum(h > t for h, t in zip(hot, true))
    assert wrong


def test_only_estimated_windows_are_grouped(spark, monkeypatch):
    """Of windows without repeats next to none gets to the second pass."""
    layout = substrings.Layout(18, 4, 35)
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**9, 2000))).encode() for _ in range(10)]
    rows = pa.table({"chunk": [0] * 10, "text": texts})
    asked = substrings.sketch_messages(layout)(rows)
    answers = pa.concat_tables([substrings.merge_sketches(layout)(asked.filter(pa.compute.equal(asked.column("owner"), o))) for o in set(asked.column("owner").to_pylist())])
    sent = substrings.candidate_messages(layout)(rows, answers)
    assert sum(sent.column("n").to_pylist()) < 0.03 * 10 * 1966


def test_packed_cells():
    for values in ([], [0], [5, 5, 9], [2**63, 2**64 - 1], list(range(0, 10**6, 7))):
        v = np.array(values, np.uint64)
        assert substrings.unpack_sorted(substrings.pack_sorted(v), len(v)).tolist() == values


def test_edge_rows(spark):
    long = " ".join(map(str, range(300_000)))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "x y"), (None, "x y"), (4, long), (5, "v" * 3_000_000), (6, long[:1000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS n_words", "8 AS chunk", "'k' AS _row", "array(1) AS kept")
    got = substrings.remove_repeats(docs)
    assert got.columns == ["_row", "n_words", "n_removed", "kept"] and got.select("_row.*").columns == [c for c in docs.columns if c != "text"]
    found = got.select("_row.doc_id", "n_words", "n_removed", "kept").collect()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert [tuple(by[i])[1:] for i in (1, 2, 3)] == [(0, 0, "")] * 3
    assert by[4].n_words == 300_000 and 200 < by[4].n_removed < 300 and by[6].n_removed in (len(long[:1000].split()), len(long[:1000].split()) - 1)
    assert by[5][1:3] == (1, 0) and by[5].kept == "v" * 3_000_000
    assert [tuple(r)[1:] for r in found if r.doc_id is None] == [(2, 0, "x y")] * 2
    assert substrings.remove_repeats(docs.where("false")).collect() == []
    same = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit(" ".join(map(str, range(40)))).alias("text"))
    assert {tuple(r)[1:] for r in substrings.remove_repeats(same, chunk_bytes=10_000).collect()} == {(40, 40, "")}
