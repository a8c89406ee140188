"""Block maxima: the rows of the whole index, bounds that hold, blocks that are skipped."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import blockmax, bm25
from tests.test_vectorindex import rows_read


def documents(spark, n=4000, seed=1):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(3000)]
    rows = []
    for i in range(n):
        words = rng.choices(common, k=rng.randrange(3, 60)) + rng.choices(rare, k=rng.randrange(1, 6))
        if rng.random() < 0.02:
            words += ["zeta"] * rng.randrange(1, 6)
        rows.append((i, rng.choice(["a", "b", None]), " ".join(words)))
    return spark.createDataFrame(rows + [(n, "a", None), (n + 1, "b", "")], "id long, lib string, text string").repartition(6)


def best(df, k):
    by = {}
    for r in df.collect():
        by.setdefault(r.lib, []).append((-round(r.bm25, 6), r.cid))
    return {lib: sorted(v)[:k] for lib, v in by.items()}


def test_same_rows_and_skipped_blocks(spark, tmp_path):
    docs = documents(spark)
    index = blockmax.write(blockmax.build(docs, "id", "text", "lib", size=32), f"file://{tmp_path}/index", row_group=1 << 14)
    whole = bm25.build(docs.withColumn("lib", F.coalesce("lib", F.lit("none"))), "id", "text", "lib")
    for query, k in (("zeta c1", 10), ("c3", 5), ("r7 r8 c2 zeta c2", 7), ("nowhere", 3)):
        found = blockmax.top(index, query, k)
        want = best(bm25.score(whole, query), k)
        assert {lib or "none": v for lib, v in best(found.rows, k).items()} == want, query
        assert found.read <= found.blocks
    zeta = blockmax.top(index, "zeta c1", 10)
    assert zeta.read < 0.5 * zeta.blocks, (zeta.read, zeta.blocks)
    asked = blockmax.weights(index, "zeta c1")
    one = blockmax.scored(index, asked, index.blocks.where("lib = 'a' AND term = 'zeta'").select("lib", "block").limit(1))
    assert rows_read(one) < 0.7 * index.blocks.count()


def test_bounds_hold(spark):
    docs = documents(spark, 600, 2)
    index = blockmax.build(docs, "id", "text", "lib", size=16)
    index = blockmax.BlockIndex(*(spark.createDataFrame(d.collect(), d.schema) for d in index))
    asked = blockmax.weights(index, "zeta c1 r5")
    bounds = {(r.lib, r.block): r.bound for r in blockmax.bounded(index, asked).collect()}
    scores = {(r.lib, r.cid): r.bm25 for r in blockmax.scored(index, asked, index.blocks.select("lib", "block").distinct()).collect()}
    place = {(r.lib, r.cid): r.block for r in index.blocks.select("lib", "block", F.inline("entries")).collect()}
    assert len(scores) > 300 and all(s <= bounds[lib, place[lib, cid]] + 1e-9 for (lib, cid), s in scores.items())
    assert all(r.n == len(r.entries) <= 16 for r in index.blocks.collect())


def test_ties_and_empty(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(300)], "id long, text string")
    index = blockmax.build(docs, "id", "text", size=8)
    index = blockmax.BlockIndex(*(spark.createDataFrame(d.collect(), d.schema) for d in index))
    assert [cid for _, cid in best(blockmax.top(index, "same", 5).rows, 5)[""]] == [0, 1, 2, 3, 4]
    assert blockmax.top(index, "", 5).rows.collect() == [] and blockmax.top(index, "...", 5).read == 0


def test_lengths_are_stored_once(spark):
    """Totals and numbers come from stored lengths; the terms of a text aren't found again for them."""
    index = blockmax.build(documents(spark, 200), "id", "text", "lib", size=32)
    assert "regexp_extract_all" not in index.totals._jdf.queryExecution().optimizedPlan().toString()
    want = documents(spark, 200).selectExpr("lib", "size(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9][a-z0-9._+-]{1,})')) AS dl").groupBy("lib").agg(F.count("*"), F.sum("dl"))
    assert sorted(map(str, index.totals.collect())) == sorted(str(r) for r in want.toDF("lib", "n", "words").collect())


def records_moved(df):
    """Rows that the exchanges of an executed query wrote."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "QueryStage" in node.getClass().getSimpleName():
            node = node.plan()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.metrics().contains("shuffleRecordsWritten"):
            total += node.metrics().apply("shuffleRecordsWritten").value()
    return total


def test_texts_move_and_not_their_postings(spark):
    docs = documents(spark, 1000)
    index = blockmax.build(docs, "id", "text", "lib", size=32)
    postings = index.blocks.agg(F.sum("n")).first()[0]
    assert postings > 20_000 and records_moved(index.blocks) < postings / 4


def test_blocks_of_repeated_rows_and_null_keys(spark, monkeypatch):
    """All blocks, of several ranges and spans, against brute force: equal keys of one length are one document, met at the number
    of each row with its key; chunks without a key have a number only."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(60)]), rng.choice(["a", "b", None]), " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(5)))) for _ in range(300)]
    docs = spark.createDataFrame(rows, "id long, lib string, text string").repartition(3)
    want = {}
    for lib in ("a", "b", None):
        mine = sorted(((len(t.split()), -1 if i is None else i, t) for i, x, t in rows if x == lib), key=lambda r: r[:2])
        tf = {}
        for dl, i, t in mine:
            for w in t.split():
                tf[i, dl, w] = tf.get((i, dl, w), 0) + 1
        for rank, (_, i, _) in enumerate(mine):
            for (j, dl, w), n in tf.items():
                if i == j >= 0:
                    want.setdefault((lib, w, rank // 4), []).append((i, n, dl))
    for words, span in ((blockmax.WORDS, blockmax.SPAN), (50, 2)):
        monkeypatch.setattr(blockmax, "WORDS", words)
        monkeypatch.setattr(blockmax, "SPAN", span)
        made = blockmax.build(docs, "id", "text", "lib", size=4).blocks.collect()
        assert {(r.lib, r.term, r.block): [tuple(e) for e in r.entries] for r in made} == {k: sorted(v) for k, v in want.items()} and len(made) == len(want)
        assert all((r.n, r.most_tf, r.least_dl) == (len(r.entries), max(e.tf for e in r.entries), min(e.dl for e in r.entries)) for r in made)
