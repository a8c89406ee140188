"""How well a search finds what it should: gold documents, ranks and hits among the first k."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import materialise
from . import bm25, retrieval, scoring

KEY_WORDS = 5  # whole words of a passage that a document must share before it is searched for the passage


def containing(passages: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, cid) of the documents whose text contains a passage. passages: key, passage; docs: cid, text.

    Candidates share some consecutive whole words of the passage, an equality; a passage
    may begin and end within a word, so its first and last words don't count. Passages with fewer words
    than that are searched for in every text.
    """
    inner = F.filter(F.split("passage", r"\s+"), lambda w: w != "")
    marked = passages.select(key, "passage", F.slice(inner, 2, F.greatest(F.lit(0), F.size(inner) - 2)).alias("w"))
    long, short = marked.where(F.size("w") >= KEY_WORDS), marked.where(F.size("w") < KEY_WORDS)
    known = materialise(long.select(key, "passage", F.array_join(F.slice("w", 1, KEY_WORDS), " ").alias("h")), "passages")
    begun: dict[str, list[list[str]]] = {}
    for r in known.select("h").distinct().collect():  # the questions of an evaluation
        begun.setdefault(r["h"].split(" ")[0], []).append(r["h"].split(" "))

    @F.arrow_udf("array<string>")
    def shared(texts: pa.Array) -> pa.Array:
        cut = re.compile(r"[ \t\n\x0b\f\r]+").split

        def of(text: str) -> list[str]:
            w = cut(text)
            return list({" ".join(h) for i, x in enumerate(w) if x in begun for h in begun[x] if w[i : i + len(h)] == h})

        return pa.array([of(t.as_py() or "") for t in texts], pa.list_(pa.string()))

    cut = docs.select("cid", "text", shared("text").alias("hs")).where(F.size("hs") > 0).select("cid", "text", F.explode("hs").alias("h"))
    found = cut.join(F.broadcast(known), "h").where(F.contains("text", F.col("passage")))
    few = [(r[key], r["passage"]) for r in short.select(key, "passage").collect()]  # questions again
    out = found.select(key, "cid").distinct()
    for k, passage in few:
        out = out.unionByName(docs.where(F.contains("text", F.lit(passage))).select(F.lit(k).alias(key), "cid"))
    return out


def _deep(k: int, w_dense: float, w_keyword: float) -> int:
    """What stands behind this rank in both routes is not among the first k: a route has k rows that are above it, or
    no row so far behind."""
    least = min(w_dense, w_keyword)
    return math.ceil((retrieval.RRF_K + k) * (w_dense + w_keyword) / least) if least > 0 else (1 << 31) - 1


def hybrid_ranks(index: bm25.Index, vectors: DataFrame, questions: DataFrame, k: int, w_dense: float = 1.0, w_keyword: float = 1.0) -> DataFrame:
    """(qid, cid, pos): the first k of each question by hybrid search, in one plan for all of them. vectors: lib, cid,
    vec; questions: qid, question, q (its vector); cid is a number or a text. Routes are fused for each question
    and library; libraries are level by their best, as in a search. Keyword ranks are made, exactly, for the rows that can be
    among the first k."""
    by, deep = ["qid", "lib"], _deep(k, w_dense, w_keyword)
    near = retrieval.nearest_of_many(vectors, "cid", "vec", questions.select("qid", "q"), retrieval.dense_limit(k))
    dense = materialise(near.select(*by, "cid", F.row_number().over(Window.partitionBy(*by).orderBy(F.round("distance", 9), "cid")).alias("rd")), "dense-ranks")
    keyword = scoring.Scores(index, questions.select("qid", "question")).ranked(dense.where(F.col("rd") <= deep).drop("rd"), deep)
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(retrieval.RRF_K) + F.col(r)), F.lit(0.0))
    fused = dense.join(keyword, [*by, "cid"], "full").select(*by, "cid", F.round(part(w_dense, "rd") + part(w_keyword, "rb"), 9).alias("rrf"))
    of_library = Window.partitionBy(*by)
    first = fused.withColumn("_n", F.row_number().over(of_library.orderBy(F.desc("rrf"), "cid"))).where(F.col("_n") <= k)
    level = first.withColumn("merged", F.round(F.col("rrf") / F.max("rrf").over(of_library), 9))  # k rows of each
    pos = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("merged"), "lib", "_n"))
    return level.withColumn("pos", pos).where(F.col("pos") <= k).select("qid", "cid", "pos")


def keyword_ranks(index: bm25.Index, questions: DataFrame, k: int, terms: bm25.Terms = tokens) -> DataFrame:
    """(qid, cid, pos): the first k of each question. questions: qid, question."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bm25"), "cid"))
    return scoring.Scores(index, questions, terms).best(k).withColumn("pos", rank).where(F.col("pos") <= k).select("qid", "cid", "pos")


def hits(ranked: DataFrame, gold: DataFrame, at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: questions that have gold, and of how many a gold document is among the first 1, 3, 5.
    ranked: qid, cid, pos; gold: qid, cid."""
    first = gold.join(ranked, ["qid", "cid"], "left").groupBy("qid").agg(F.min("pos").alias("pos"))
    return first.agg(F.count("*").alias("questions"), *[F.count_if(F.col("pos") <= k).alias(f"hit_{k}") for k in at])
