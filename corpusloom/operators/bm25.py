"""Keyword index and BM25 scores.

The index is two tables: postings (lib, term, cid, tf, dl) and lengths (lib, cid, dl); every library has
statistics of its own. A posting carries its chunk's length, so that a query reads nothing but the postings
of its terms and one aggregate of the lengths. Stored, postings are sorted by term (see ``stored``), and
the reader skips the row groups that have none of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, tokens
from ..storage import materialise

K1, B = 1.5, 0.75
Terms = Callable[[Column], Column]  # of a text
LISTED_TERMS = 1000  # a query with more is joined, not listed in a filter


@dataclass
class Index:
    """postings: lib, term, cid, tf, dl. lengths: lib, cid, dl. totals: lib, n, avgdl, if they are stored. listed: lib, cid,
    terms, of an index that isn't. lists: what makes lists of terms in Arrow batches, if there is; then listed has lower-case texts in their place."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame | None = None
    listed: DataFrame | None = None
    lists: Callable[[pa.Array], Iterable[list[pa.Array]]] | None = None

    def statistics(self) -> DataFrame:
        return self.totals if self.totals is not None else statistics(self.lengths)


def build(docs: DataFrame, key: str, text: str, lib: str | None = None, terms: Terms = tokens) -> Index:
    """docs: a row for each chunk. lib: column that says whose statistics count; else all rows are one.
    terms: what makes the terms, of questions too."""
    group = F.col(lib) if lib else F.lit("")
    listed = docs.select(group.alias("lib"), F.col(key).alias("cid"), terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    measured = listed.withColumn("dl", F.size("terms").cast("long"))
    postings = measured.select("lib", "cid", "dl", F.explode("terms").alias("term")).groupBy("lib", "term", "cid", "dl").agg(F.count("*").alias("tf"))
    lists = getattr(terms, "lists", None)
    if lists:
        listed = docs.select(group.alias("lib"), F.col(key).alias("cid"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    return Index(postings.select("lib", "term", "cid", "tf", "dl"), measured.select("lib", "cid", "dl"), listed=listed, lists=lists)


def stored(postings: DataFrame) -> DataFrame:
    """Postings in the order in which they are to be written."""
    return postings.repartitionByRange("term", "lib").sortWithinPartitions("term", "lib")


def query_terms(spark, query: str, terms: Terms = tokens) -> dict[str, int]:
    """The query's terms and how often each is in it."""
    asked = spark.range(1).select(F.explode(terms(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))
    return {r["term"]: r["qtf"] for r in asked.collect()}  # no more than the query has


def score_term(tf: Column, qtf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl)) * qtf


def statistics(lengths: DataFrame) -> DataFrame:
    """(lib, n, avgdl): a row for each library."""
    return lengths.groupBy("lib").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def score_many(index: Index, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, lib, cid, bm25) of the chunks that have any term of a query. queries: qid, term, qtf."""
    asked = queries.select("term").distinct()
    hits = index.postings.join(asked, "term", "left_semi")
    frequency = hits.groupBy("lib", "term").agg(F.count("*").alias("df"))
    weighed = frequency.join(index.statistics(), "lib").join(queries, "term")
    hits = hits.join(weighed, ["lib", "term"])
    part = score_term(*map(F.col, ("tf", "qtf", "df", "dl", "n", "avgdl")), k1, b)
    return hits.groupBy("qid", "lib", "cid").agg(F.sum(part).alias("bm25")).where("bm25 > 0")


def score(index: Index, query: str, k1: float = K1, b: float = B, terms: Terms = tokens) -> DataFrame:
    """(lib, cid, bm25) of the chunks that have any of the query's terms."""
    spark, asked = index.postings.sparkSession, query_terms(index.postings.sparkSession, query, terms)
    if not asked:
        return index.postings.select("lib", "cid", F.lit(0.0).alias("bm25")).limit(0)
    rows = spark.createDataFrame(list(asked.items()), "term string, qtf long").withColumn("qid", F.lit(0))
    narrow = index.postings.where(F.col("term").isin(*asked)) if len(asked) <= LISTED_TERMS else index.postings
    return score_many(Index(narrow, index.lengths, index.totals), rows, k1, b).drop("qid")


def score_documents(docs: DataFrame, key: str, text: str, query: str, *more: str, k1: float = K1, b: float = B) -> DataFrame:
    """(cid, more, bm25) without an index: texts are read once, and of each only its length and how often
    it has the query's terms are kept."""
    asked = query_terms(docs.sparkSession, query)
    if not asked:
        return docs.select(F.col(key).alias("cid"), *more, F.lit(0.0).alias("bm25")).limit(0)
    wanted = F.array(*map(F.lit, asked))
    found = docs.select(F.col(key).alias("cid"), *more, let(tokens(F.coalesce(F.col(text), F.lit(""))), lambda t: F.struct(F.size(t).cast("long").alias("dl"), F.filter(t, lambda x: F.array_contains(wanted, x)).alias("hits"))).alias("f"))
    slim = materialise(found.select("cid", *more, "f.dl", "f.hits"), "bm25")
    counted = slim.where(F.size("hits") > 0).select("cid", *more, "dl", F.explode(F.array_distinct("hits")).alias("term"), "hits")
    counted = counted.withColumn("tf", F.size(F.filter("hits", lambda x: x == F.col("term"))).cast("long")).drop("hits")
    frequency = slim.select(F.explode(F.array_distinct("hits")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # a row for each term of the query
    if not frequency:
        return counted.select("cid", *more, F.lit(0.0).alias("bm25")).limit(0)
    whole = slim.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()  # one row
    known = lambda pairs: F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), F.col("term"))
    part = score_term(F.col("tf"), known(asked.items()), known((r["term"], r["df"]) for r in frequency), F.col("dl"), F.lit(whole["n"]), F.lit(whole["avgdl"]), k1, b)
    return counted.groupBy("cid", *more).agg(F.sum(part).alias("bm25")).where("bm25 > 0")
