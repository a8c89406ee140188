"""Queries over the test tables, one or more for each family of operators, with their DuckDB SQL.

``source`` plays the library or folder, ``vec_id`` pairs documents with vectors, conversations are files
of several pieces. Operators whose input is not in the tables get literal rows, in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markdown, paths, text
from .models import truncate_vector
from .operators import blockmax, bm25, delivery, diagnostics, evaluation, graph, ingest, neardup, ranking, retrieval, sampling, vectorindex
from .plans import hybrid
from .sources import extraction, package
from .storage import materialise, own_path
from .streaming import ingest as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

QUERY = "the ation erer and thing"


def query(sql: str | None = None, arrays: tuple[str, ...] = ()):
    """Registers a query. arrays: columns that both engines give as texts, since they print arrays in
    different ways."""

    def register(f):
        def run(spark, sf):
            df = f(spark, sf)
            return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ¦ ", "null") for c in arrays}) if arrays else df

        QUERIES[f.__name__] = run if arrays else f
        if sql:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f"array_to_string({c}, ' ¦ ') AS {c}" for c in arrays)}) FROM ({sql})" if arrays else sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def values(spark: SparkSession, sql: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {sql} AS t({columns})")


# Keyword search

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9._+-]{1,}')"
_BM25 = f"""
d AS (SELECT doc_id, source, {_TOKENS} AS terms FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY 1, 2),
l AS (SELECT doc_id, source, len(terms) AS dl FROM d),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest(regexp_extract_all(lower('{QUERY}'), '[a-z0-9][a-z0-9._+-]{{1,}}')) AS term) GROUP BY 1),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT p.doc_id, any_value(l.source) AS source,
  sum(ln(1 + (s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * (p.tf * 2.5::DOUBLE) / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / s.avgdl)) * q.qtf) AS bm25
  FROM p JOIN q USING (term) JOIN f USING (term) JOIN l USING (doc_id), s GROUP BY 1)"""


def _scores(spark, sf):
    return bm25.score_documents(table(spark, sf, "documents"), "doc_id", "text", QUERY, "source")


@query(f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM b ORDER BY round(bm25, 6) DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf):
    scores = _scores(spark, sf)
    return scores.select(F.col("cid").alias("doc_id"), F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(10)


@query(f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM b WHERE source = 'src3' OR starts_with(source, 'src3/') ORDER BY round(bm25, 6) DESC, doc_id LIMIT 10")
def bm25_folder_topk(spark, sf):
    inside = _scores(spark, sf).where(paths.in_folder(F.col("source"), "src3/"))
    return inside.select(F.col("cid").alias("doc_id"), F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(10)


@query(f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM b")
def bm25_index(spark, sf):
    """The same through the index tables."""
    index = bm25.build(table(spark, sf, "documents"), "doc_id", "text")
    return bm25.score(index, QUERY).select(F.col("cid").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


_BM25_BY_LIBRARY = f"""
d AS (SELECT doc_id, source AS lib, {_TOKENS} AS terms FROM documents),
p AS (SELECT doc_id, lib, len(terms) AS dl, term, count(*) AS tf FROM (SELECT doc_id, lib, terms, unnest(terms) AS term FROM d) GROUP BY 1, 2, 3, 4),
s AS (SELECT lib, count(*) AS n, avg(len(terms)) AS avgdl FROM d GROUP BY 1),
q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest(regexp_extract_all(lower('{QUERY}'), '[a-z0-9][a-z0-9._+-]{{1,}}')) AS term) GROUP BY 1),
f AS (SELECT lib, term, count(*) AS df FROM p GROUP BY 1, 2),
b AS (SELECT p.doc_id, p.lib, sum(ln(1 + (s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * (p.tf * 2.5::DOUBLE) / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / s.avgdl)) * q.qtf) AS bm25
  FROM p JOIN q USING (term) JOIN f ON f.lib = p.lib AND f.term = p.term JOIN s ON s.lib = p.lib GROUP BY 1, 2)"""


@query(f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM b ORDER BY round(bm25, 6) DESC, doc_id LIMIT 10")
def bm25_blocks(spark, sf):
    """The same through a stored index with block maxima."""
    path = own_path(spark, "block-index")
    index = blockmax.write(blockmax.build(table(spark, sf, "documents"), "doc_id", "text"), path)
    found = blockmax.top(index, QUERY, 10).rows
    return found.select(F.col("cid").alias("doc_id"), F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(10)


def _corpus(spark, sf) -> hybrid.Corpus:
    """Documents as files of one piece, in libraries by source, with the vectors of the same number."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("lib"), F.lpad("doc_id", 9, "0").alias("rel"), F.lit(0).alias("chunk"), F.lit("").alias("hp"), F.lit("").alias("title"), F.col("text").alias("body"), "text", "doc_id")
    vectors = docs.join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("lib", "rel", "chunk", F.col("embedding").alias("vec"))
    return hybrid.Corpus(docs.drop("doc_id"), vectors)


@query(f"""
WITH {_BM25_BY_LIBRARY},
e AS (SELECT vec_id AS doc_id, source AS lib, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))) AS distance FROM embeddings JOIN documents ON doc_id = vec_id),
r1 AS (SELECT *, row_number() OVER (PARTITION BY lib ORDER BY round(distance, 12), doc_id) AS rd FROM e QUALIFY rd <= 200),
r2 AS (SELECT *, row_number() OVER (PARTITION BY lib ORDER BY round(bm25, 12) DESC, doc_id) AS rb FROM b WHERE bm25 > 0),
u AS (SELECT coalesce(r1.lib, r2.lib) AS lib, coalesce(r1.doc_id, r2.doc_id) AS doc_id, coalesce(1.0::DOUBLE / (2 + rd), 0) + coalesce(1.0::DOUBLE / (2 + rb), 0) AS rrf FROM r1 FULL JOIN r2 ON r1.lib = r2.lib AND r1.doc_id = r2.doc_id)
SELECT lib, doc_id, round(rrf, 6) AS rrf, row_number() OVER (PARTITION BY lib ORDER BY round(rrf, 9) DESC, doc_id) <= 50 AS in_pool FROM u""")
def hybrid_search(spark, sf):
    """Candidates of all libraries in one plan, with the pool that a reranker would see."""
    corpus, q = _corpus(spark, sf), _probe(spark, sf)[1].first()["q"]
    found = hybrid.candidates(corpus, QUERY, hybrid.Options(), vector=[float(x) for x in q])
    pool = retrieval.rerank_pool(found.withColumn("rrf", F.round("rrf", 9)), "lib", "cid", "rrf")
    return pool.select("lib", F.col("cid.rel").cast("long").alias("doc_id"), F.round("rrf", 6).alias("rrf"), "in_pool")


@query(f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS terms FROM documents),
p AS (SELECT doc_id, len(terms) AS dl, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) GROUP BY 1, 2, 3),
s AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:12], ' ')), '[a-z0-9][a-z0-9._+-]{{1,}}')) AS term FROM benchmark) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT item_id, p.doc_id, sum(ln(1 + (s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * (p.tf * 2.5::DOUBLE) / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / s.avgdl)) * q.qtf) AS bm25
  FROM p JOIN q USING (term) JOIN f USING (term), s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, doc_id) AS pos FROM b QUALIFY pos <= 5),
g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
x AS (SELECT g.item_id, min(pos) AS pos FROM g LEFT JOIN r ON r.item_id = g.item_id AND r.doc_id = g.doc_id GROUP BY 1)
SELECT count(*) AS questions, count(*) FILTER (pos <= 1) AS hit_1, count(*) FILTER (pos <= 3) AS hit_3, count(*) FILTER (pos <= 5) AS hit_5 FROM x""")
def retrieval_evaluation(spark, sf):
    """The beginnings of the benchmark's passages as questions, the documents that hold them as gold."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("question"))
    return evaluation.hits(_ranked(spark, sf, items), _gold(spark, sf).withColumnRenamed("item_id", "qid"))


@query(f"""
WITH d AS (SELECT doc_id, source AS lib, {_TOKENS} AS terms FROM documents),
p AS (SELECT doc_id, lib, len(terms) AS dl, term, count(*) AS tf FROM (SELECT doc_id, lib, terms, unnest(terms) AS term FROM d) GROUP BY ALL),
s AS (SELECT lib, count(*) AS n, avg(len(terms)) AS avgdl FROM d GROUP BY lib),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:12], ' ')), '[a-z0-9][a-z0-9._+-]{{1,}}')) AS term FROM benchmark) GROUP BY 1, 2),
f AS (SELECT lib, term, count(*) AS df FROM p GROUP BY ALL),
b AS (SELECT item_id, p.lib, p.doc_id, round(sum(ln(1 + (s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * (p.tf * 2.5::DOUBLE) / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / s.avgdl)) * q.qtf), 9) AS bm25
  FROM p JOIN q USING (term) JOIN f ON f.term = p.term AND f.lib = p.lib JOIN s ON s.lib = p.lib GROUP BY ALL HAVING bm25 > 0),
kw AS (SELECT *, row_number() OVER (PARTITION BY item_id, lib ORDER BY bm25 DESC, doc_id) AS rb FROM b),
v AS (SELECT vec_id AS doc_id, source AS lib, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings JOIN documents ON doc_id = vec_id),
x AS (SELECT item_id, CAST(embedding AS DOUBLE[]) AS q FROM benchmark JOIN embeddings ON vec_id = item_id % (SELECT count(*) FROM embeddings)),
dn AS (SELECT item_id, lib, doc_id, row_number() OVER (PARTITION BY item_id, lib ORDER BY round(1 - list_cosine_similarity(vec, q), 9), doc_id) AS rd FROM x, v QUALIFY rd <= 200),
u AS (SELECT coalesce(dn.item_id, kw.item_id) AS item_id, coalesce(dn.lib, kw.lib) AS lib, coalesce(dn.doc_id, kw.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / (2 + rd), 0) + coalesce(1.0::DOUBLE / (2 + rb), 0), 9) AS rrf
  FROM dn FULL JOIN kw ON dn.item_id = kw.item_id AND dn.lib = kw.lib AND dn.doc_id = kw.doc_id),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id, lib ORDER BY rrf DESC, doc_id) AS n FROM u QUALIFY n <= 5),
m AS (SELECT *, round(rrf / max(rrf) OVER (PARTITION BY item_id, lib), 9) AS merged FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY merged DESC, lib, n) AS pos FROM m QUALIFY pos <= 5),
g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
y AS (SELECT g.item_id, min(pos) AS pos FROM g LEFT JOIN r ON r.item_id = g.item_id AND r.doc_id = g.doc_id GROUP BY 1)
SELECT count(*) AS questions, count(*) FILTER (pos <= 1) AS hit_1, count(*) FILTER (pos <= 3) AS hit_3, count(*) FILTER (pos <= 5) AS hit_5 FROM y""")
def hybrid_evaluation(spark, sf):
    """The same by hybrid search over libraries, all questions in one plan; vectors stand in for those of questions."""
    docs, vectors = table(spark, sf, "documents").withColumnRenamed("source", "lib"), table(spark, sf, "embeddings")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("question"))
    n = vectors.count()
    items = items.join(vectors.select("vec_id", F.col("embedding").alias("q")), F.col("qid") % F.lit(n) == F.col("vec_id")).drop("vec_id")
    placed = docs.join(vectors, F.col("doc_id") == F.col("vec_id")).select("lib", F.col("doc_id").alias("cid"), F.col("embedding").alias("vec"))
    ranked = evaluation.hybrid_ranks(bm25.build(docs, "doc_id", "text", "lib"), placed, items, 5)
    return evaluation.hits(ranked, _gold(spark, sf).withColumnRenamed("item_id", "qid"))


def _ranked(spark, sf, items):
    index = bm25.build(table(spark, sf, "documents"), "doc_id", "text")
    return evaluation.keyword_ranks(index, items, 5)


@query(f"WITH d AS (SELECT {_TOKENS} AS terms FROM documents) SELECT term, count(*) AS tf FROM (SELECT unnest(terms) AS term FROM d) GROUP BY 1")
def term_counts(spark, sf):
    return table(spark, sf, "documents").select(F.explode(text.tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))


# Dense search and fusion

_DENSE = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
x AS (SELECT v AS q FROM e WHERE vec_id = (SELECT min(vec_id) FROM e)),
k AS (SELECT vec_id AS doc_id, label, list_cosine_similarity(v, q) AS sim FROM e, x),
n AS (SELECT doc_id, round(1 - sim, 9) AS distance FROM k ORDER BY round(1 - sim, 9), doc_id LIMIT 200)"""


def _probe(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return vectors, vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))


def _dense(spark, sf):
    vectors, q = _probe(spark, sf)
    near = retrieval.nearest(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", q, retrieval.dense_limit(5))
    return near.withColumn("distance", F.round("distance", 9))


@query(f"WITH {_DENSE} SELECT doc_id, round(distance, 6) AS distance FROM n ORDER BY distance, doc_id LIMIT 20")
def dense_knn(spark, sf):
    return _dense(spark, sf).orderBy("distance", "doc_id").limit(20).select("doc_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_DENSE} SELECT doc_id, round(distance, 6) AS distance FROM n ORDER BY distance, doc_id LIMIT 20")
def dense_knn_indexed(spark, sf):
    """The same through a stored index, exactly: what its bounds exclude isn't read."""
    vectors, q = _probe(spark, sf)
    index = vectorindex.write(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "embedding", own_path(spark, "vector-index"))
    # a few more than asked for, since rows are ordered by rounded distances
    near = vectorindex.search(index, "doc_id", "embedding", [float(x) for x in q.first()["q"]], 40)
    return near.withColumn("distance", F.round("distance", 9)).orderBy("distance", "doc_id").limit(20).select("doc_id", F.round("distance", 6).alias("distance"))


def _fusion_sql(wd: float, wb: float) -> str:
    return f"""{_BM25}, {_DENSE},
r1 AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS rd FROM n),
r2 AS (SELECT doc_id, row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) AS rb FROM b WHERE bm25 > 0),
u AS (SELECT coalesce(r1.doc_id, r2.doc_id) AS doc_id, coalesce({wd}::DOUBLE / (2 + rd), 0) + coalesce({wb}::DOUBLE / (2 + rb), 0) AS rrf FROM r1 FULL JOIN r2 USING (doc_id))"""


def _fused(spark, sf, wd: float, wb: float):
    scores = _scores(spark, sf)
    keyword = scores.select(F.col("cid").alias("doc_id"), F.round("bm25", 9).alias("bm25"))
    return retrieval.fuse(_dense(spark, sf), keyword, "doc_id", wd, wb)


@query(f"WITH {_fusion_sql(1, 1)} SELECT doc_id, round(rrf, 6) AS rrf, round(least(1, rrf / (2.0::DOUBLE / 3)), 6) AS confidence FROM u")
def rrf_hybrid(spark, sf):
    return _fused(spark, sf, 1.0, 1.0).select("doc_id", F.round("rrf", 6).alias("rrf"), F.round(retrieval.fused_confidence(F.col("rrf")), 6).alias("confidence"))


@query(f"WITH {_fusion_sql(5, 1)} SELECT doc_id, round(rrf, 6) AS rrf FROM u ORDER BY round(rrf, 6) DESC, doc_id LIMIT 20")
def rrf_weighted(spark, sf):
    return _fused(spark, sf, 5.0, 1.0).select("doc_id", F.round("rrf", 6).alias("rrf")).orderBy(F.desc("rrf"), "doc_id").limit(20)


@query("SELECT doc_id, source AS lib, round(n_chars / max(n_chars) OVER (PARTITION BY source), 6) AS merged FROM documents")
def merge_normalised(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("lib"), "n_chars")
    return retrieval.merge_normalised(docs, "lib", "n_chars").select("doc_id", "lib", F.round("merged", 6).alias("merged"))


@query("SELECT doc_id, source AS lib, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 50 AS in_pool FROM documents")
def rerank_pool(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("lib"), "n_chars")
    return retrieval.rerank_pool(docs, "lib", "doc_id", "n_chars").select("doc_id", "lib", "rank", "in_pool")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def global_rank(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return ranking.global_rank(docs, [F.desc("n_chars"), F.col("doc_id")], "rank").select("doc_id", "rank")


@query(f"WITH {_DENSE}, g AS (SELECT label, doc_id, round(sim, 4) AS score FROM k QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(sim, 4) DESC, doc_id) <= 5) SELECT label, doc_id AS vec_id, score FROM g ORDER BY score DESC, label, doc_id LIMIT 5")
def page_search(spark, sf):
    vectors, q = _probe(spark, sf)
    return retrieval.nearest_per_library(vectors, "label", "vec_id", "embedding", q, 5)


@query("SELECT vec_id, list_transform(e[1:16], lambda x: CAST(round(x / sqrt(list_sum(list_transform(e[1:16], lambda y: y * y))) * 1000000) AS BIGINT)) AS vec FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)", arrays=('vec',))
def vector_truncation(spark, sf):
    cut = truncate_vector(F.col("embedding"), 16)
    return table(spark, sf, "embeddings").select("vec_id", F.transform(cut, lambda x: F.round(x * 1000000).cast("long")).alias("vec"))


@query("""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE text <> ''),
s AS (SELECT conv_id, role, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS parent FROM c GROUP BY 1, 2)
SELECT conv_id, role, length(parent) AS n_chars, md5(parent) AS digest FROM s WHERE n > 1 AND length(parent) > 300""")
def small_to_big(spark, sf):
    chunks = table(spark, sf, "conversations").select(F.lit("lib").alias("lib"), F.col("conv_id").alias("rel"), F.col("role").alias("hp"), F.col("turn").alias("chunk"), F.col("text").alias("body")).where("body <> ''")
    return delivery.whole_sections(chunks).select(F.col("rel").alias("conv_id"), F.col("hp").alias("role"), F.length("parent").cast("long").alias("n_chars"), F.md5("parent").alias("digest"))


_CANDIDATES = """
c AS (SELECT conv_id AS rel, role AS hp, turn AS chunk, text AS body, (conv_id * 37 + turn * 11) % 100 / 100.0::DOUBLE AS score,
        row_number() OVER (ORDER BY (conv_id * 37 + turn * 11) % 100 DESC, conv_id, turn) AS pos FROM conversations)"""


@query(f"""
WITH {_CANDIDATES},
s AS (SELECT rel, hp FROM c WHERE body <> '' GROUP BY 1, 2 HAVING count(*) > 1 AND length(string_agg(body, chr(10) || chr(10))) > 300),
w AS (SELECT * FROM c WHERE pos <= 400),
j AS (SELECT w.*, s.rel IS NOT NULL AS backfilled FROM w LEFT JOIN s ON w.rel = s.rel AND w.hp = s.hp WHERE score >= 0.05),
f AS (SELECT *, row_number() OVER (PARTITION BY rel, hp ORDER BY pos) AS fold FROM j QUALIFY NOT backfilled OR fold = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY pos) AS n FROM f QUALIFY n <= 3),
o AS (SELECT * FROM g ORDER BY pos LIMIT 40)
SELECT rel, hp, chunk, round(score, 6) AS score, backfilled, row_number() OVER (ORDER BY pos) AS delivered,
  CASE WHEN score >= 0.75 THEN 'strong' WHEN score >= 0.3 THEN 'medium' ELSE 'weak' END AS tier FROM o""")
def deliver_fold_cap(spark, sf):
    rows = table(spark, sf, "conversations").select(F.lit("lib").alias("lib"), F.col("conv_id").alias("rel"), F.col("role").alias("hp"), F.col("turn").alias("chunk"), F.col("text").alias("body"), (F.expr("(conv_id * 37 + turn * 11) % 100") / 100).alias("score"))
    ranked = ranking.global_rank(rows, [F.desc("score"), F.col("rel"), F.col("chunk")], "pos")
    sections = delivery.whole_sections(rows.where("body <> ''"))
    hits = delivery.deliver(ranked.where("pos <= 400"), sections, 40, drop=0.05)
    return hits.select("rel", "hp", "chunk", F.round("score", 6).alias("score"), "backfilled", F.col("delivered").cast("long").alias("delivered"), delivery.tier(F.col("score")).alias("tier"))


@query("""
SELECT doc_id, md5(CASE WHEN length(text) <= 2000 THEN text ELSE
  CASE WHEN bef > 0 AND 2000 - bef <= 300 THEN left(text, bef) WHEN aft >= 2000 AND aft - 2000 <= 300 THEN left(text, aft) ELSE left(text, 2000) END || chr(10) || '[cut]' END) AS digest
FROM (SELECT doc_id, text, CASE WHEN contains(left(text, 2000), chr(10)) THEN 2000 - length(regexp_extract(left(text, 2000), '[^\\n]*$')) - 1 ELSE -1 END AS bef,
  CASE WHEN strpos(substr(text, 2001), chr(10)) > 0 THEN 2000 + strpos(substr(text, 2001), chr(10)) - 1 ELSE -1 END AS aft FROM documents)""")
def truncate_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.truncate_at_line(F.col("text"), 2000, "[cut]")).alias("digest"))


@query("""
SELECT b.item_id, min(d.doc_id) AS first_doc, count(d.doc_id) AS golds FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1""")
def retrieval_gold(spark, sf):
    """Gold documents of each passage: those that contain it."""
    gold = _gold(spark, sf).groupBy("item_id").agg(F.min("cid").alias("first_doc"), F.count_distinct("cid").alias("golds"))
    return table(spark, sf, "benchmark").select("item_id").join(gold, "item_id", "left").select("item_id", "first_doc", F.coalesce("golds", F.lit(0)).cast("long").alias("golds"))


def _gold(spark, sf):
    """(item_id, cid)."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    return evaluation.containing(items, table(spark, sf, "documents").select(F.col("doc_id").alias("cid"), "text"), "item_id")


# Near-duplicates

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')"
_SKETCH = f"""
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) ELSE [array_to_string(w, ' ')] END AS sh FROM d WHERE len(w) >= 2),
k AS (SELECT doc_id, list_sort(list_distinct(list_transform(sh, lambda s: left(sha1(s), 16))))[1:64] AS sk FROM g),
c AS (SELECT sk, min(doc_id) AS rep, count(*) AS copies FROM k GROUP BY 1),
z AS (SELECT rep, band, sk[band * 4 + 1:band * 4 + 4] AS seg FROM c, (SELECT unnest(range(16)) AS band)),
y AS (SELECT DISTINCT l.rep AS a, r.rep AS b FROM z l JOIN z r ON l.band = r.band AND l.seg = r.seg AND l.rep < r.rep WHERE len(l.seg) > 0),
j AS (SELECT a, b, l.sk AS x, r.sk AS v, list_sort(list_distinct(list_concat(l.sk, r.sk))) AS u FROM y JOIN c l ON a = l.rep JOIN c r ON b = r.rep),
p AS (SELECT a, b, CASE WHEN len(x) >= 64 AND len(v) >= 64 THEN len(list_filter(list_intersect(x, v), lambda h: h <= u[64])) / 64.0::DOUBLE ELSE len(list_intersect(x, v)) / len(u)::DOUBLE END AS sim FROM j),
pairs AS (SELECT a, b, round(sim, 4) AS sim FROM p WHERE sim >= 0.8)"""
_GROUPS = """,
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
t(node, root) AS (SELECT rep, rep FROM c UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node),
roots AS (SELECT node, min(root) AS root FROM t GROUP BY 1),
many AS (SELECT root FROM roots JOIN c ON c.rep = node GROUP BY 1 HAVING sum(copies) > 1)"""


@query(f"WITH {_SKETCH} SELECT a, b, sim FROM pairs")
def near_dup_pairs(spark, sf):
    reps = neardup.classes(neardup.sketches(table(spark, sf, "documents"), "doc_id", "text"))
    return neardup.pairs(reps)


_SCOPED = (
    _SKETCH.replace("d AS (SELECT doc_id,", "d AS (SELECT doc_id, source,").replace("g AS (SELECT doc_id,", "g AS (SELECT doc_id, source,").replace("k AS (SELECT doc_id,", "k AS (SELECT doc_id, source,")
    .replace("c AS (SELECT sk, min(doc_id) AS rep, count(*) AS copies FROM k GROUP BY 1)", "c AS (SELECT source, sk, min(doc_id) AS rep, count(*) AS copies FROM k GROUP BY 1, 2)")
    .replace("z AS (SELECT rep,", "z AS (SELECT source, rep,").replace("ON l.band = r.band", "ON l.source = r.source AND l.band = r.band")
)


@query(f"WITH {_SCOPED} SELECT c.source AS lib, a, b, sim FROM pairs JOIN c ON c.rep = a")
def near_dup_by_library(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("lib"), "doc_id", "text")
    return neardup.library_pairs(docs, "lib", "doc_id", "text")


@query(f"WITH RECURSIVE {_SKETCH}{_GROUPS} SELECT k.doc_id, r.root AS cluster FROM k JOIN c USING (sk) JOIN roots r ON r.node = c.rep JOIN many USING (root)")
def near_dup_clusters(spark, sf):
    return neardup.clusters(table(spark, sf, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "cluster")


@query(f"WITH RECURSIVE {_SKETCH}{_GROUPS} SELECT (SELECT count(*) FROM k) AS scanned, (SELECT count(*) FROM d) - (SELECT count(*) FROM k) AS skipped, (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM many) AS groups")
def near_dup_stats(spark, sf):
    return neardup.statistics(table(spark, sf, "documents"), "doc_id", "text")


@query(f"""
WITH {_SKETCH.split("c AS (SELECT sk")[0].rstrip().rstrip(",")},
s AS (SELECT a.doc_id, a.sk AS x, b.sk AS v, list_sort(list_distinct(list_concat(a.sk, b.sk))) AS u FROM k a JOIN k b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN len(x) >= 64 AND len(v) >= 64 THEN len(list_filter(list_intersect(x, v), lambda h: h <= u[64])) / 64.0::DOUBLE ELSE len(list_intersect(x, v)) / len(u)::DOUBLE END, 6) AS sim FROM s""")
def sketch_similarity(spark, sf):
    """Of each document and the next one."""
    made = materialise(neardup.sketches(table(spark, sf, "documents"), "doc_id", "text"), "sketches")
    after = made.select((F.col("key") - 1).alias("key"), F.col("sk").alias("next"))
    return made.join(after, "key").select(F.col("key").alias("doc_id"), F.round(neardup.jaccard(F.col("sk"), F.col("next")), 6).alias("sim"))


# Graph

_EDGES = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
m AS (SELECT l.vec_id AS a, r.vec_id AS b, list_cosine_similarity(l.v, r.v) AS sim FROM e l JOIN e r ON l.vec_id <> r.vec_id),
n AS (SELECT a, b, sim FROM m WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) <= 4),
g AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(sim) AS sim FROM n GROUP BY 1, 2)"""


@query(f"WITH {_EDGES} SELECT a, b, round(sim, 3) AS sim FROM g")
def semantic_edges(spark, sf):
    return graph.semantic_edges(table(spark, sf, "embeddings"), "vec_id", "embedding", threshold=0.3, cap=None)


@query(ORACLES["semantic_edges"])
def semantic_edges_bounded(spark, sf):
    return graph.semantic_edges_by_bounds(table(spark, sf, "embeddings"), "vec_id", "embedding", threshold=0.3, cap=None)


@query(f"WITH {_EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM g UNION ALL SELECT b FROM g) GROUP BY 1) SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 5")
def hub_nodes(spark, sf):
    return graph.hubs(semantic_edges(spark, sf))


# Sampling


def _farthest_sql(k: int) -> str:
    """Each step as a CTE: of each label the vector farthest from those chosen before."""
    steps = ["e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)", "c0 AS (SELECT label, 0 AS step, vec_id, v FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)"]
    for i in range(1, k):
        chosen = " UNION ALL ".join(f"SELECT * FROM c{j}" for j in range(i))
        steps.append(f"p{i} AS ({chosen})")
        steps.append(f"d{i} AS (SELECT e.label, e.vec_id, any_value(e.v) AS v, min(list_sum(list_transform(list_zip(e.v, p.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS gap FROM e JOIN p{i} p ON p.label = e.label GROUP BY 1, 2)")
        steps.append(f"c{i} AS (SELECT label, {i} AS step, vec_id, v FROM d{i} WHERE gap > 0 AND vec_id NOT IN (SELECT vec_id FROM p{i}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(gap, 9) DESC, vec_id) = 1)")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT label, step, vec_id FROM c{j}" for j in range(k))


@query(_farthest_sql(5))
def fps_sample(spark, sf):
    return sampling.farthest_points(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 5)


# Cleaning and structure

@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos, len(string_split(text, chr(10))) AS total FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9)) AS s FROM l WHERE NOT (pos = total AND line = '')),
n AS (SELECT *, length(s) >= 4 AND NOT regexp_matches(s, '^[\s\-\*_#>|~`]+$') AND NOT regexp_matches(s, '^[#|>]') AND NOT regexp_matches(line, '^(\s*)([-*+]|\d+[.)])\s') AS plain FROM k),
c AS (SELECT *, plain AND count(*) OVER (PARTITION BY doc_id, s, plain) >= 3 AS gone FROM n),
o AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept, bool_or(gone) AS cut FROM c GROUP BY 1)
SELECT d.doc_id, md5(CASE WHEN coalesce(cut, false) THEN coalesce(kept, '') ELSE d.text END) AS digest FROM documents d LEFT JOIN o USING (doc_id)""")
def strip_boilerplate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.strip_boilerplate(F.col("text"))).alias("digest"))


@query("SELECT source || '/' || doc_id || '.md' AS rel, count(*) AS n FROM documents WHERE false GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM documents WHERE length(text) <= 200 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def short_documents(spark, sf):
    files = table(spark, sf, "documents").select(F.col("source").alias("lib"), F.concat_ws("", "source", F.lit("/"), "doc_id", F.lit(".md")).alias("rel"), "text").where(F.length("text") <= 200)
    chunks, _ = ingest.chunk_files(files)
    return chunks.groupBy(F.lit("all").alias("rel")).agg(F.count("*").alias("n"))


# Selection

# Ingest

_OLD = "SELECT source AS lib, 'd' || doc_id AS rel, n_chars AS size, 1 AS mtime_ns, md5(text) AS hash FROM documents WHERE doc_id % 10 <> 0"
_NEW = "SELECT source AS lib, 'd' || doc_id AS rel, n_chars AS size, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS mtime_ns, md5(CASE WHEN doc_id % 14 = 0 THEN 'x' || text ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0"
_DIFF = f"""
o AS ({_OLD}), w AS ({_NEW}),
f AS (SELECT coalesce(o.lib, w.lib) AS lib, coalesce(o.rel, w.rel) AS rel,
  CASE WHEN o.rel IS NULL THEN 'added' WHEN w.rel IS NULL THEN 'removed' WHEN o.mtime_ns = w.mtime_ns OR o.hash = w.hash THEN 'same' ELSE 'changed' END AS status
  FROM o FULL JOIN w ON o.lib = w.lib AND o.rel = w.rel)"""


def _snapshots(spark, sf):
    """The table as two versions of a folder: some rows added, some removed, some edited, some touched."""
    d = table(spark, sf, "documents")
    rel = F.concat(F.lit("d"), F.col("doc_id"))
    old = d.where("doc_id % 10 <> 0").select(F.col("source").alias("lib"), rel.alias("rel"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime_ns"), F.md5("text").alias("hash"), F.lit(False).alias("xfail"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("xsrc"), F.lit(1).alias("chunks"))
    edited = F.when(F.expr("doc_id % 14 = 0"), F.concat(F.lit("x"), F.col("text"))).otherwise(F.col("text"))
    new = d.where("doc_id % 11 <> 0").select(F.col("source").alias("lib"), rel.alias("rel"), F.col("n_chars").alias("size"), F.expr("if(doc_id % 7 = 0, 2, 1)").alias("mtime_ns"), F.md5(edited).alias("hash"))
    return old, new


@query(f"WITH {_DIFF} SELECT lib, rel, status FROM f")
def ingest_diff(spark, sf):
    old, new = _snapshots(spark, sf)
    return ingest.diff(new, old)


@query(f"WITH {_DIFF} SELECT lib, count_if(status = 'added') AS added, count_if(status = 'removed') AS removed, count_if(status = 'changed') AS changed, count_if(status = 'same') AS same FROM f GROUP BY 1")
def ingest_counts(spark, sf):
    old, new = _snapshots(spark, sf)
    return ingest.diff_counts(ingest.diff(new, old), old).select("lib", "added", "removed", "changed", "same")


@query("SELECT source AS lib, left(sha256(string_agg(x, '|' ORDER BY x)), 16) AS fingerprint FROM (SELECT source, 'd' || doc_id || ':' || md5(text) AS x FROM documents) GROUP BY 1")
def content_fingerprint(spark, sf):
    return ingest.fingerprint(table(spark, sf, "documents").select(F.col("source").alias("lib"), F.concat(F.lit("d"), F.col("doc_id")).alias("rel"), F.md5("text").alias("hash")))


@query("SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN (SELECT conv_id, conv_id % 3 AS n FROM conversations WHERE conv_id % 5 <> 0 GROUP BY 1) m USING (conv_id) WHERE m.n IS NULL OR c.turn >= m.n")
def stale_chunks(spark, sf):
    chunks = table(spark, sf, "conversations").select(F.lit("l").alias("lib"), F.col("conv_id").alias("rel"), F.col("turn").alias("chunk"))
    meta = chunks.where("rel % 5 <> 0").select("lib", "rel", F.expr("rel % 3").alias("chunks")).distinct()
    return ingest.stale_chunks(chunks, meta).select(F.col("rel").alias("conv_id"), F.col("chunk").alias("turn"))


@query("SELECT md5(text) AS hash FROM documents EXCEPT (SELECT md5(text) FROM documents WHERE source <> 'src1' UNION SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def orphans(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("hash"), F.col("source").alias("lib"), "doc_id")
    return ingest.orphans(d.select("hash").distinct(), d.select("lib", "hash"), d.where("doc_id % 2 = 0").select("hash"), d.where("lib <> 'src1'").select("lib"))


@query("SELECT source AS lib, count(*) AS expected, count(*) FILTER (doc_id % 10 <> 0) AS actual, count(*) = count(*) FILTER (doc_id % 10 <> 0) AS consistent FROM documents GROUP BY 1")
def consistency(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("lib"), "doc_id", F.lit(1).alias("chunks"))
    return ingest.consistent(d, d.where("doc_id % 10 <> 0"))


# Diagnostics

_META = """
m AS (SELECT source AS lib, d.doc_id, n_chars // 600 + 1 AS chunks, coalesce(l.toxic, 0) = 1 OR d.doc_id % 9 = 0 AS xfail,
  CASE WHEN d.doc_id % 9 = 0 THEN (['unreadable', 'extract-failed', 'empty', 'tbd', 'scanned', NULL])[d.doc_id % 6 + 1] WHEN l.toxic = 1 THEN 'tbd' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _meta(spark, sf):
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "toxic")
    reasons = F.array(*[F.lit(x) for x in ("unreadable", "extract-failed", "empty", "tbd", "scanned", None)])
    ninth = F.expr("doc_id % 9 = 0")
    return d.join(labels, "doc_id", "left").select(
        F.col("source").alias("lib"), "doc_id", F.expr("cast(n_chars div 600 + 1 as int)").alias("chunks"), (F.coalesce("toxic", F.lit(0)) == 1).__or__(ninth).alias("xfail"), F.lit(False).alias("tbd"),
        F.when(ninth, F.get(reasons, F.expr("cast(doc_id % 6 as int)"))).when(F.col("toxic") == 1, F.lit("tbd")).alias("reason"),
    )


_REASONS = "['unreadable', 'extract-failed', 'empty', 'tbd', 'scanned']"


@query(f"WITH {_META} SELECT lib, coalesce(reason, 'unknown') AS reason, count(*) AS n, coalesce(list_position({_REASONS}, reason), 6)::INT AS place FROM m WHERE xfail GROUP BY 1, 2, 4")
def failures_by_reason(spark, sf):
    return diagnostics.failures_by_reason(_meta(spark, sf))


@query(f"WITH {_META} SELECT lib, count(*) AS files, sum(chunks)::BIGINT AS chunks FROM m GROUP BY ROLLUP (lib)")
def library_rollup(spark, sf):
    return diagnostics.library_rollup(_meta(spark, sf))


@query(f"""
WITH {_META}, c AS (SELECT lib, count(*) AS files, sum(chunks)::BIGINT AS chunks, count_if(xfail) AS failed, max(doc_id) % 7 < 2 AS stale FROM m GROUP BY 1),
r AS (SELECT lib, coalesce(reason, 'unknown') AS reason, count(*) AS n FROM m WHERE xfail GROUP BY 1, 2),
i AS (SELECT lib, string_agg(reason || ' ' || n, ', ' ORDER BY coalesce(list_position({_REASONS}, reason), 6)) AS issues FROM r GROUP BY 1),
s AS (SELECT lib, files, chunks, failed, CASE WHEN stale THEN 'stale' ELSE 'ok' END AS state FROM c UNION ALL SELECT 'empty', 0, 0, 0, 'none')
SELECT s.*, CASE WHEN (SELECT bool_or(state = 'stale') FROM s) THEN 'stale' WHEN (SELECT bool_and(state = 'none') FROM s) THEN 'none' ELSE 'ok' END AS overall, coalesce(issues, '') AS issues FROM s LEFT JOIN i USING (lib)""")
def dashboard(spark, sf):
    """Some libraries are stale, one has nothing indexed."""
    meta = _meta(spark, sf)
    stale = meta.groupBy("lib").agg((F.max("doc_id") % 7 < 2).alias("stale")).unionByName(spark.sql("SELECT 'empty' AS lib, true AS stale"))
    told = F.array_join(F.transform("issues", lambda x: F.concat_ws(" ", x["reason"], x["n"])), ", ")
    return diagnostics.snapshot(meta, stale).select("lib", "files", "chunks", "failed", "state", "overall", F.coalesce(told, F.lit("")).alias("issues"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS files, sum(event_id % 5)::BIGINT AS pages, sum(event_id % 5) > 800 AS over FROM events GROUP BY 1")
def daily_quota(spark, sf):
    log = table(spark, sf, "events").select("ts", F.lit(1).alias("files"), F.expr("event_id % 5").alias("pages"))
    return diagnostics.daily_quota(log).withColumn("day", F.col("day").cast("string"))


@query("WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT epoch(now) - epoch(ts) AS age FROM events, n WHERE epoch(now) - epoch(ts) < 86400) SELECT round(greatest(0, 86400 - max(age)), 3) AS wait FROM l")
def slot_waits(spark, sf):
    events = table(spark, sf, "events")
    now = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return streams.slot_wait(events, "ts", F.lit(now), 2, 86400).select(F.round("wait", 3).alias("wait"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) > 3")
def keep_newest(spark, sf):
    return diagnostics.keep_newest(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id", 3).select("source", "doc_id")


@query("SELECT lang AS ext, source AS lib, count(*) AS files FROM documents WHERE lang <> 'en' AND NOT (source = 'src1' AND lang = 'fr') GROUP BY 1, 2")
def pending_formats(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("lib"), F.concat(F.lit("f."), F.when(F.col("lang") == "en", "md").otherwise(F.col("lang"))).alias("rel"))
    return diagnostics.pending_formats(rows, values(spark, "('src1', 'fr')", "lib, ext"))


# Extraction and packages


@query("WITH c AS (SELECT md5(text) AS hash, CASE doc_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'mineru-text' ELSE 'ocr:mineru-local' END AS route FROM documents) SELECT DISTINCT hash, route FROM c QUALIFY dense_rank() OVER (PARTITION BY hash ORDER BY list_position(['ocr:mineru-cloud', 'ocr:mineru-local', 'mineru-text', 'local'], route)) = 1")
def cache_priority(spark, sf):
    route = F.when(F.expr("doc_id % 3 = 0"), "local").when(F.expr("doc_id % 3 = 1"), "mineru-text").otherwise("ocr:mineru-local")
    return extraction.best_cached(table(spark, sf, "documents").select(F.md5("text").alias("hash"), route.alias("route")).distinct())


@query("SELECT 'd' || doc_id AS rel, CASE WHEN doc_id % 13 = 0 THEN 'missing' ELSE 'mismatch' END AS problem FROM documents WHERE doc_id % 13 = 0 OR doc_id % 17 = 0")
def package_check(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id")).alias("rel"), F.col("text").cast("binary").alias("content"))
    damaged = files.where("doc_id % 13 <> 0").withColumn("content", F.when(F.expr("doc_id % 17 = 0"), F.lit("x").cast("binary")).otherwise(F.col("content")))
    return package.verify(package.manifest(files), package.manifest(damaged))


# Rates and gaps of events


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events")
def rate_window(spark, sf):
    return streams.rate(table(spark, sf, "events"), "user_id", "ts", 3600).select("event_id", "recent")


@query("SELECT event_id, round(gap, 3) AS gap, coalesce(gap > 25, false) AS stalled FROM (SELECT event_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)")
def gap_state(spark, sf):
    return streams.gaps(table(spark, sf, "events"), "user_id", "ts", "event_id").select("event_id", F.round("gap", 3).alias("gap"), "stalled")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    return streams.windowed_counts(table(spark, sf, "events"), "ts", "event_type", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# Joins of the business tables


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def orders_by_nation(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


from . import han_queries, note_queries  # noqa: E402, F401  register their queries with those above
