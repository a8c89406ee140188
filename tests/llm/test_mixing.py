"""Mixing: targets and words taken against brute force, schedules, and edge rows."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from corpusloom.llm import mixing


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        rest = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / rest for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def check(rows, texts):
    words = lambda t: sum(1 for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w)
    sizes, taken, of = defaultdict(int), defaultdict(int), {}
    for doc_id, text, source in texts:
        sizes[source] += words(text)
        of[doc_id] = source
    targets = slow_targets(sizes)
    for r in rows:
        assert r.target == round(targets[of[r.doc_id]], 6) or abs(r.target - targets[of[r.doc_id]]) < 1e-5
        assert r.source_size == sizes[of[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        taken[of[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 0.5 + 1e-6


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.op1_mix(spark, sf).collect()
    check(rows, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert [tuple(r) for r in rows] == [tuple(r) for r in mixing.op1_mix(spark, sf).collect()]
    first = [r.first_position for r in rows if r.first_position is not None]
    assert first == sorted(first) and all(0 <= p <= 1 for p in first)


def test_sources_of_very_different_sizes(spark):
    texts, i = [], 0
    for source, n, size in [("a", 3, 2), ("b", 40, 9), ("é", 1, 700), (None, 5, 1), ("z", 30, 40), ("empty", 2, 0)]:
        for _ in range(n):
            texts.append((i, "\x0b".join(["w"] * size) if size else None, source))
            i += 1
    df = spark.createDataFrame(texts, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'q' AS bucket", "2 AS target")
    plan = mixing.plan_mix(df, mixing.word_count(F.col("text"))).select("_row.doc_id", "size", "source_size", "target", "taken", "positions").collect()
    check(plan, texts)
    assert all(len(r.positions) == -(-r.taken // r.size) for r in plan if r.size)
    assert mixing.mix_documents(df).columns == df.columns


def test_schedule_inverse(spark):
    for shape in mixing.SHAPES:
        assert abs(mixing.integral(shape) - 1) < 1e-12
        got = spark.range(101).select((F.col("id") / 100).alias("u")).select("u", mixing.invert(shape, F.col("u")).alias("t")).collect()
        for r in got:
            area = 0.0
            for (t0, w0), (t1, w1) in zip(shape, shape[1:], strict=False):
                x = max(0.0, min(r.t, t1) - t0)
                area += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            assert math.isclose(area, r.u, abs_tol=1e-9)


def test_edge_rows(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_documents(spark.createDataFrame([], schema)).collect() == []
    same = spark.createDataFrame([(None, "a b", "s"), (None, "a b", "s"), (1, "", "s")], schema)
    assert sorted(r.taken for r in mixing.plan_mix(same, mixing.word_count(F.col("text"))).collect()) == [0, 2, 2]
    nothing = spark.createDataFrame([(1, None, "s"), (2, "", None)], schema)
    assert [r.target for r in mixing.plan_mix(nothing, mixing.word_count(F.col("text"))).collect()] == [0.0, 0.0]
