"""Dense search, rank fusion and the order across libraries.

Ties are broken by key everywhere, so every order is total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import in_folder
from ..models import cosine
from .ranking import global_rank, group_rank

RRF_K = 2
DENSE_FACTOR, DENSE_LEAST = 8, 200
RERANK_POOL = 50
BLOCK = 1024  # vectors packed in a row
WINDOW_FACTOR = 4


def dense_limit(top_k: int) -> int:
    return max(top_k * DENSE_FACTOR, DENSE_LEAST)


def _vector(query: DataFrame) -> Column:
    """The query's vector (column q of its one row) as a literal."""
    r = query.select("q").first()
    return F.array(*[F.lit(float(x)) for x in r["q"]]) if r and r["q"] is not None else F.array().cast("array<double>")


def nearest(vectors: DataFrame, key: str, vector: str, query: DataFrame, k: int) -> DataFrame:
    """(key, distance) of the k rows nearest to the query's one vector (column q): an exact scan whose
    tasks send k rows each."""
    return vectors.select(key, (1 - cosine(F.col(vector), _vector(query))).alias("distance")).orderBy("distance", key).limit(k)


def nearest_per_library(vectors: DataFrame, library: str, key: str, vector: str, query: DataFrame, k: int) -> DataFrame:
    """(library, key, score) of the k best pages of each library, then the k best of all."""
    found = vectors.select(library, key, F.round(cosine(F.col(vector), _vector(query)), 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy(library).orderBy(F.desc("score"), key))
    return found.withColumn("n", rank).where(F.col("n") <= k).drop("n").orderBy(F.desc("score"), library, key).limit(k)


def restrict(candidates: DataFrame, path: str, folder: str) -> DataFrame:
    """Dense candidates inside a folder. To be applied after the limit of nearest(): Spark does not push
    a filter through a limit, and the order matters for the result."""
    return candidates.where(in_folder(F.col(path), folder))


def fuse(dense: DataFrame, keyword: DataFrame, key: str, w_dense: float = 1.0, w_keyword: float = 1.0, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (key, rrf). dense: key, distance, bounded by a limit; keyword: key, bm25 of
    every row that has a term of the query, ranked without a single task."""
    d = dense.select(key, F.row_number().over(Window.orderBy("distance", key)).alias("rd"))
    b = global_rank(keyword.select(key, "bm25"), [F.desc("bm25"), F.col(key)], "rb").select(key, "rb")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return d.join(b, key, "full").select(key, (part(w_dense, "rd") + part(w_keyword, "rb")).alias("rrf"))


def fuse_libraries(dense: DataFrame, keyword: DataFrame, w_dense: float = 1.0, w_keyword: float = 1.0, k: int = RRF_K) -> DataFrame:
    """The same for all libraries in one plan: (lib, cid, rrf). dense: lib, cid, distance, a limited number
    for each library; keyword: lib, cid, bm25."""
    d = dense.select("lib", "cid", F.row_number().over(Window.partitionBy("lib").orderBy("distance", "cid")).alias("rd"))
    b = group_rank(keyword.select("lib", "cid", "bm25"), "lib", [F.desc("bm25"), F.col("cid")], "rb").select("lib", "cid", "rb")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return d.join(b, ["lib", "cid"], "full").select("lib", "cid", (part(w_dense, "rd") + part(w_keyword, "rb")).alias("rrf"))


def nearest_of_each(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(lib, key, distance) of the k nearest rows of each library; tasks keep k of each before the shuffle."""
    q = F.array(*map(F.lit, query)) if query else F.array().cast("array<double>")
    found = vectors.select("lib", key, (1 - cosine(F.col(vector), q)).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("lib").orderBy("distance", key))
    return found.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def _packed(rows: DataFrame, by: list[str], key: str, vector: str, name: str) -> tuple[DataFrame, int]:
    """(by, name, ids, vs): about BLOCK vectors a row; the number of blocks."""
    blocks = max(1, -(-rows.count() // BLOCK))
    dealt = rows.where(F.col(vector).isNotNull()).withColumn(name, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    pairs = F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")))
    return dealt.groupBy(*by, name).agg(pairs.alias("ps")).select(*by, name, F.transform("ps", lambda p: p["id"]).alias("ids"), F.transform("ps", lambda p: p["v"]).alias("vs")), blocks


def nearest_of_many(vectors: DataFrame, key: str, vector: str, questions: DataFrame, k: int) -> DataFrame:
    """(qid, lib, key, distance): of each library the k rows nearest to each question. vectors: lib, key, vector; key
    is a number or a text. questions: qid, q. Blocks of vectors meet blocks of questions by an equality, and of
    each pair of blocks the k nearest of each question leave the matrix product."""
    kinds = {c: d.schema[c].dataType.simpleString() for c, d in (("lib", vectors), (key, vectors), ("qid", questions))}
    packed, _ = _packed(vectors, ["lib"], key, vector, "_block")
    asked, blocks = _packed(questions, [], "qid", "q", "_asked")
    met = packed.withColumn("_asked", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked.select("_asked", F.col("ids").alias("qids"), F.col("vs").alias("qs")), "_asked")

    def unit(rows) -> np.ndarray:
        x = np.array([np.asarray(r, float) for r in rows])
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norms > 0, norms, 1)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = np.array(r.ids)
                order = np.argsort(ids, kind="stable")  # equal distances go by key
                away = 1 - unit(r.qs) @ unit(r.vs)[order].T
                near = np.argsort(np.round(away, 9), axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(away)), near.shape[1])
                yield pd.DataFrame({"qid": np.array(r.qids)[rows], "lib": r.lib, key: ids[order][near.ravel()], "distance": away[rows, near.ravel()]})

    found = met.select("lib", "ids", "vs", "qids", "qs").mapInPandas(best, f"qid {kinds['qid']}, lib {kinds['lib']}, {key} {kinds[key]}, distance double")
    rank = F.row_number().over(Window.partitionBy("qid", "lib").orderBy(F.round("distance", 9), key))
    return found.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def fused_confidence(rrf: Column, w_dense: float = 1.0, w_keyword: float = 1.0, k: int = RRF_K) -> Column:
    """1 if both routes rank it first."""
    best = (w_dense + w_keyword) / (k + 1)
    return F.least(F.lit(1.0), rrf / best) if best > 0 else F.lit(0.0)


def rerank_confidence(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def merge_normalised(results: DataFrame, library: str, score: str) -> DataFrame:
    """Adds merged: the score as a share of its library's best. No library needs a single task: the best
    is an aggregate that is joined back."""
    best = results.groupBy(library).agg(F.max(score).alias("_best"))
    joined = results.join(best.withColumnRenamed(library, "_library"), F.col(library).eqNullSafe(F.col("_library")))
    return joined.withColumn("merged", F.when(F.col("_best") > 0, F.col(score) / F.col("_best")).otherwise(F.lit(0.0))).drop("_best", "_library")


def rerank_pool(results: DataFrame, library: str, key: str, score: str, n: int = RERANK_POOL) -> DataFrame:
    """Adds rank (within the library) and in_pool, whether the reranker sees it."""
    rank = F.row_number().over(Window.partitionBy(library).orderBy(F.desc(score), key))
    return results.withColumn("rank", rank).withColumn("in_pool", F.col("rank") <= n)
