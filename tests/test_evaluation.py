"""Hybrid search of many questions against searches of one question each."""

import random

from pyspark.sql import functions as F

from corpusloom.models import HashedTokens, embed
from corpusloom.operators import bm25, evaluation, retrieval
from corpusloom.plans import hybrid


def test_many_questions_equal_single_searches(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(rng.choice("ab"), f"f{i:03d}", " ".join(rng.choices(words, k=rng.randrange(5, 30)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "lib string, rel string, text string")
    questions = [(i, " ".join(rng.sample(words, 3))) for i in range(9)]
    model = HashedTokens()
    chunks = docs.select("lib", "rel", F.lit(0).alias("chunk"), F.lit("").alias("hp"), F.lit("").alias("title"), F.col("text").alias("body"), "text")
    vectors = docs.select("lib", "rel", F.lit(0).alias("chunk"), embed(F.col("text"), model).alias("vec"))
    corpus = hybrid.Corpus(spark.createDataFrame(chunks.collect(), chunks.schema), spark.createDataFrame(vectors.collect(), vectors.schema))
    asked = spark.createDataFrame([(i, q, model.encode([q])[0].astype(float).tolist()) for i, q in questions], "qid int, question string, q array<double>")
    placed = corpus.vectors.select("lib", F.col("rel").alias("cid"), "vec")
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    index = bm25.build(docs, "rel", "text", "lib")
    found = {}
    for r in evaluation.hybrid_ranks(index, placed, asked, 5).orderBy("qid", "pos").collect():
        found.setdefault(r.qid, []).append(r.cid)
    assert set(found) == {i for i, _ in questions} and all(len(v) == 5 for v in found.values())
    for i, q in questions[:3]:
        hits = hybrid.search(corpus, q, hybrid.Options(top_k=5, with_body=False)).orderBy("delivered").collect()
        assert [h.rel for h in hits] == found[i]
    gold = spark.createDataFrame([(i, found[i][2]) for i, _ in questions] + [(0, "nowhere")], "qid int, cid string")
    ranked = evaluation.hybrid_ranks(index, placed, asked, 5)
    assert tuple(evaluation.hits(ranked, gold).first()) == (9, 0, 9, 9)
