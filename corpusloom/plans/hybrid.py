"""Hybrid search: keyword and dense candidates, fused, optionally reranked, delivered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import in_folder
from ..functions.text import tokens
from ..models import Embedder, HashedTokens, Reranker, rerank
from ..operators import bm25, delivery, retrieval
from ..storage import materialise

HYDE_LEAST = 0.5


@dataclass
class Options:
    top_k: int = 5
    folder: str = ""
    libraries: tuple[str, ...] = ()
    w_dense: float = 1.0
    w_keyword: float = 1.0
    with_body: bool = True
    small_to_big: bool = True
    strict: bool = True  # the dense route takes its candidates before the folder is looked at
    warn: float = delivery.WARN
    drop: float = delivery.DROP


@dataclass
class Corpus:
    """chunks: lib, rel, chunk, hp, title, body, text; vectors: lib, rel, chunk, vec; index: the stored
    keyword index over the chunks, cid being (lib, rel, chunk). Without it texts are read for each query.
    terms: what makes the index's terms and the query's."""

    chunks: DataFrame
    vectors: DataFrame
    index: bm25.Index | None = None
    terms: bm25.Terms = tokens

    def keyed(self) -> DataFrame:
        return self.chunks.withColumn("cid", F.struct("lib", "rel", "chunk"))


def keyword_index(chunks: DataFrame, terms: bm25.Terms = tokens) -> bm25.Index:
    """The keyword index of chunks (lib, rel, chunk, text)."""
    return bm25.build(chunks.withColumn("cid", F.struct("lib", "rel", "chunk")), "cid", "text", "lib", terms)


def candidates(corpus: Corpus, query: str, options: Options, embedder: Embedder | None = None, vector: list[float] | None = None) -> DataFrame:
    """(cid, lib, rrf): each library's own fusion, for all libraries in one plan. vector: the query's, if
    it is known already."""
    if vector is None:
        vector = (embedder or HashedTokens()).encode([query])[0].astype(float).tolist()
    index = corpus.index or keyword_index(corpus.chunks, corpus.terms)
    near, postings, lengths = corpus.vectors.withColumn("cid", F.struct("lib", "rel", "chunk")), index.postings, index.lengths
    if options.libraries:
        near, postings, lengths = (d.where(F.col("lib").isin(*options.libraries)) for d in (near, postings, lengths))
    if not options.strict:
        near = retrieval.restrict(near, "rel", options.folder)
    inside = in_folder(F.col("cid.rel"), options.folder)
    dense = retrieval.nearest_of_each(near, "cid", "vec", vector, retrieval.dense_limit(options.top_k)).where(inside)
    keyword = bm25.score(bm25.Index(postings, lengths, index.totals), query, terms=corpus.terms).where(inside)
    return retrieval.fuse_libraries(dense, keyword, options.w_dense, options.w_keyword).select("cid", "lib", "rrf")


def search(corpus: Corpus, query: str, options: Options | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None, vector: list[float] | None = None) -> DataFrame:
    """Hits: lib, rel, chunk, hp, score, delivered, backfilled, text, total (pieces of the file), tier."""
    o = options or Options()
    pool = materialise(retrieval.rerank_pool(candidates(corpus, query, o, embedder, vector), "lib", "cid", "rrf"), "pool")
    chunks = corpus.keyed().select("cid", "hp", "title", "body", F.col("text").alias("_text"))
    if reranker:
        texts = pool.where("in_pool").join(chunks.select("cid", "_text"), "cid")
        scored = materialise(texts.select("cid", rerank(F.col("_text"), query, reranker).alias("rerank")), "reranked")
        ranked = pool.join(scored, "cid", "left")
        order = [F.desc("in_pool"), F.desc("rerank"), F.col("lib"), F.col("rank"), F.col("cid")]
        ranked = ranked.withColumn("score", retrieval.rerank_confidence(F.col("rerank")))
    else:
        ranked = retrieval.merge_normalised(pool, "lib", "rrf").withColumn("score", retrieval.fused_confidence(F.col("rrf"), o.w_dense, o.w_keyword))
        order = [F.desc("merged"), F.col("lib"), F.col("rank"), F.col("cid")]
    window = o.top_k * retrieval.WINDOW_FACTOR if o.with_body else o.top_k
    top = ranked.orderBy(*order).limit(window)
    top = top.withColumn("pos", F.row_number().over(Window.orderBy(*order)))  # `window` rows
    rows = top.join(chunks, "cid").select("cid.lib", "cid.rel", "cid.chunk", "hp", "title", "body", "score", "pos")
    rows = materialise(rows, "window")
    # only the pieces of the files in the window are counted
    totals = delivery.piece_position(corpus.chunks.select("lib", "rel").join(F.broadcast(rows.select("lib", "rel").distinct()), ["lib", "rel"], "left_semi"))
    if o.with_body:
        wanted = rows.select("lib", "rel", "hp").distinct()
        sections = delivery.whole_sections(corpus.chunks.join(F.broadcast(wanted), ["lib", "rel", "hp"], "left_semi")) if o.small_to_big else delivery.whole_sections(corpus.chunks.limit(0))
        hits = delivery.deliver(rows, sections, o.top_k, drop=o.drop)
    else:
        hits = rows.where(F.col("score").isNull() | (F.col("score") >= o.drop)).select("lib", "rel", "chunk", "hp", "score", "pos", F.col("pos").alias("delivered"), F.lit(False).alias("backfilled"), F.lit(None).cast("string").alias("text"))
    return hits.join(totals, ["lib", "rel"]).withColumn("tier", delivery.tier(F.col("score"), o.warn)).orderBy("delivered")


def search_hyde(corpus: Corpus, query: str, write: Callable[[str], str], options: Options | None = None, **models) -> DataFrame:
    """If the best hit is below HYDE_LEAST, searches again with a hypothetical answer and keeps what has
    the better best hit. ``write`` may fail or return nothing."""
    first = materialise(search(corpus, query, options, **models), "hits")
    best = lambda d: (d.agg(F.max("score")).first() or [None])[0]
    top = best(first)
    if top is not None and top >= HYDE_LEAST:
        return first
    try:
        guess = write(query)
    except Exception:  # noqa: BLE001  a model's failure leaves the first result
        guess = ""
    if not guess:
        return first
    second = materialise(search(corpus, guess, options, **models), "hits")
    better = best(second)
    return second if better is not None and (top is None or better > top) else first
