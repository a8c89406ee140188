"""Scores of many questions by blocks against scores of all documents."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import bm25, evaluation, retrieval, scoring


def corpus(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(30)], k=rng.randrange(1, 25))) for _ in range(90)]
    rows = [(rng.choice("abc"), i, rng.choice(texts)) for i in range(200)] + [("a", 200, ""), ("b", 201, None), ("c", 202, "else")]  # with ties
    questions = [(i, " ".join(rng.choices([f"w{i}" for i in range(33)], k=4))) for i in range(20)] + [(20, ""), (21, "nowhere")]
    return spark.createDataFrame(rows, "lib string, id long, text string"), spark.createDataFrame(questions, "qid int, question string")


def whole(index, questions, by):
    asked = questions.select("qid", F.explode(F.split("question", " ")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    scored = bm25.score_many(index, asked).withColumn("bm25", F.round("bm25", 9))
    return {(r.qid, r.lib, r.cid): r.rb for r in scored.withColumn("rb", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("bm25"), "cid"))).collect()}


@pytest.mark.parametrize("stored", [False, True])
def test_ranks_are_exact(spark, monkeypatch, stored):
    docs, questions = corpus(spark)
    index = bm25.build(docs, "id", "text", "lib")
    want, level = whole(index, questions, ["qid", "lib"]), whole(index, questions, ["qid"])
    if stored:
        index = bm25.Index(*(spark.createDataFrame(d.collect(), d.schema) for d in (index.postings, index.lengths)))
    monkeypatch.setattr(scoring, "BLOCK", 7)
    watched = {(q, lib, cid) for q, lib, cid in want if (q + cid) % 5 == 0}
    more = [(0, "a", 999), (20, "a", 3), (0, "none", 1)]  # without a term of the question
    rows = spark.createDataFrame([*watched, *more], "qid int, lib string, cid long")
    for k in (1, 3):
        found = {(r.qid, r.lib, r.cid): r.rb for r in scoring.Scores(index, questions).ranked(rows, k).collect()}
        assert found == {x: n for x, n in want.items() if n <= k or x in watched}
    ranked = {(r.qid, r.cid): r.pos for r in evaluation.keyword_ranks(index, questions, 3).collect()}
    assert ranked == {(q, cid): n for (q, _, cid), n in level.items() if n <= 3}


def test_texts_are_cut_once_and_blocks_send_their_best(spark):
    docs, questions = corpus(spark)
    cuts = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        cuts.add(1)
        return text.split()

    docs = spark.createDataFrame(docs.collect(), docs.schema)
    index = bm25.build(docs, "id", "text", terms=cut)
    assert evaluation.keyword_ranks(index, questions, 3).count() == 60
    assert cuts.value == 203
    assert scoring.Scores(bm25.build(docs, "id", "text"), questions).best(3).count() == 60  # one block, three of it for each question


def test_fusion_of_unlike_weights(spark):
    docs, questions = corpus(spark)
    rng = random.Random(9)
    asked = spark.createDataFrame([(r.qid, r.question, [rng.random() for _ in range(3)]) for r in questions.collect()], "qid int, question string, q array<double>")
    vectors = spark.createDataFrame([(r.lib, r.id, [rng.random() for _ in range(3)]) for r in docs.collect() if r.id % 3], "lib string, cid long, vec array<double>")
    index, k = bm25.build(docs, "id", "text", "lib"), 2
    rb = whole(index, questions, ["qid", "lib"])
    near = retrieval.nearest_of_many(vectors, "cid", "vec", asked.select("qid", "q"), retrieval.dense_limit(k))
    rd = {(r.qid, r.lib, r.cid): r.rd for r in near.withColumn("rd", F.row_number().over(Window.partitionBy("qid", "lib").orderBy(F.round("distance", 9), "cid"))).collect()}
    for wd, wk in ((1.0, 0.4), (0.3, 1.0)):
        by = {}
        for x in {*rb, *rd}:
            by.setdefault(x[:2], []).append((-round((wd / (2 + rd[x]) if x in rd else 0) + (wk / (2 + rb[x]) if x in rb else 0), 9), x[2]))
        best = {}
        for (q, lib), rows in by.items():
            first = sorted(rows)[:k]
            best.setdefault(q, []).extend((-round(s / first[0][0], 9), lib, n, cid) for n, (s, cid) in enumerate(first))
        want = {(q, cid, n) for q, rows in best.items() for n, (_, _, _, cid) in enumerate(sorted(rows)[:k], 1)}
        assert {tuple(r) for r in evaluation.hybrid_ranks(index, vectors, asked, k, wd, wk).collect()} == want


def test_passages_between_any_blanks(spark):
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(0, "x " + "  \n".join(words)), (1, "\t".join(words[:5]) + " " + " ".join(words)), (2, None), (3, ""), (4, " ".join(words[:8])), (5, "aw0 " + " ".join(words[1:]) + "b")], "cid int, text string")
    passages = {1: "  \n".join(words[1:9]), 2: " ".join(words), 3: "0 " + " ".join(words[1:11]) + " w1", 4: "w3 w4", 5: " ".join(words[1:8])}
    items = spark.createDataFrame(list(passages.items()), "qid int, passage string")
    want = {(k, r.cid) for k, p in passages.items() for r in docs.collect() if p in (r.text or "")}
    assert {tuple(r) for r in evaluation.containing(items, docs, "qid").collect()} == want and len(want) > 5
