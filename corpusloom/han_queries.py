"""Queries over texts without spaces, with their DuckDB SQL.

The tables have no Han texts. Here each pair of letters of a word becomes a Han sign and the spaces go, so
words are one to four signs long as a rule, their limits are known, and every other sign ends a run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import let
from .operators import bm25, evaluation, hanwords
from .operators.hanwords import FIRST
from .queries import query, table
from .storage import materialise

_PARTS = "[a-z]{1,2}|[.!?]"


def _as_han(text: F.Column) -> F.Column:
    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return _signed(batch)

    return run(F.lower(F.coalesce(text, F.lit(""))))


def _signed(texts: pa.Array) -> pa.Array:
    """The signs of lower-case texts: pairs of letters from a word's first one on, or its last one alone, and ends of sentences."""
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    signs = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    made = np.where((signs == ord(".")) | (signs == ord("!")) | (signs == ord("?")), ord("。"), 0).astype(np.uint16)
    at = np.flatnonzero((signs >= ord("a")) & (signs <= ord("z")))
    if len(at):
        begins = np.zeros(len(signs) + 1, bool)
        begins[ends] = True
        begin = np.append(True, np.diff(at) != 1) | begins[at]
        place = np.arange(len(at))
        odd = (place - np.maximum.accumulate(np.where(begin, place, 0))) & 1
        letter = signs[at].astype(np.uint16) - ord("a")
        second = np.where(np.append(odd[1:], 0) == 1, np.append(letter[1:], 0) + 1, 0)
        made[at[odd == 0]] = (FIRST + 27 * letter + second)[odd == 0]
    kept = np.flatnonzero(made)
    said = made[kept].astype("<u2").tobytes().decode("utf-16-le").encode()
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((3 * np.searchsorted(kept, ends)).astype(np.int32)), pa.py_buffer(said))


def _han(spark, sf, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return table(spark, sf, name).select(key, _as_han(F.col("text")).alias("han"))


_HAN = f"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(coalesce(text, '')), '{_PARTS}'), lambda p: CASE WHEN p[1] BETWEEN 'a' AND 'z'
  THEN chr(19968 + ((ascii(p) - 97) * 27 + CASE WHEN length(p) > 1 THEN ascii(p[2]) - 96 ELSE 0 END)::INT) ELSE '。' END), '') AS han FROM documents"""


@query(f"""
WITH h AS ({_HAN}),
r AS (SELECT '<' || unnest(regexp_extract_all(han, '[一-鿿]+')) || '>' AS run FROM h),
g AS (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM r),
c AS (SELECT substr(run, i, k) AS gram, k, count(*) AS n FROM g, (SELECT unnest(range(1, {hanwords.LONGEST + 2})) AS k) WHERE i + k - 1 <= length(run) GROUP BY ALL),
p AS (SELECT * FROM c WHERE gram NOT LIKE '%<%' AND gram NOT LIKE '%>%'),
t AS (SELECT sum(n) AS total FROM p WHERE k = 1),
x AS (SELECT p.gram AS word, p.n::BIGINT AS n, ln(p.n) - sum(CASE WHEN y.gram[-1] = '>' THEN 0 ELSE y.n * ln(y.n) END) / p.n AS behind
  FROM p JOIN c AS y ON y.k = p.k + 1 AND y.gram[:-2] = p.gram WHERE p.k BETWEEN 2 AND {hanwords.LONGEST} AND p.n >= {hanwords.LEAST} GROUP BY p.gram, p.n),
z AS (SELECT x.word, ln(x.n) - sum(CASE WHEN y.gram[1] = '<' THEN 0 ELSE y.n * ln(y.n) END) / x.n AS before
  FROM x JOIN c AS y ON y.k = length(x.word) + 1 AND y.gram[2:] = x.word GROUP BY x.word, x.n),
s AS (SELECT word, n, unnest(range(1, length(word))) AS i FROM x),
w AS (SELECT s.word, min(ln(s.n) + ln(t.total) - ln(a.n) - ln(b.n)) AS cohesion FROM s JOIN p AS a ON a.gram = s.word[:s.i] JOIN p AS b ON b.gram = s.word[s.i + 1:], t GROUP BY s.word)
SELECT word, n, round(cohesion, 6) AS cohesion, round(least(before, behind), 6) AS freedom FROM x JOIN z USING (word) JOIN w USING (word)
WHERE least(before, behind) >= {hanwords.FREEDOM} AND cohesion >= {hanwords.COHESION}""")
def han_words(spark, sf):
    """The words that are found in the documents."""
    return hanwords.discover(_han(spark, sf), "han").select("word", "n", F.round("cohesion", 6).alias("cohesion"), F.round("freedom", 6).alias("freedom"))


@query()
def han_segments(spark, sf):
    """Each document's number of words by the dictionary that is learned from all, and their digest."""
    docs = materialise(_han(spark, sf), "han")
    cutter = hanwords.segmenter(spark, hanwords.learn(docs, "han"))
    return docs.select("doc_id", let(cutter.words(F.col("han")), lambda w: F.struct(F.size(w).alias("words"), F.md5(F.array_join(w, " ")).alias("digest"))).alias("r")).select("doc_id", "r.words", "r.digest")


@query()
def han_retrieval(spark, sf):
    """The benchmark's whole passages as questions to the documents, both without spaces: hits with two-letter
    shingles alone and with words beside them."""
    docs = materialise(_han(spark, sf), "han")
    asked = _han(spark, sf, "benchmark", "item_id").toDF("qid", "question")
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    gold = materialise(evaluation.containing(items, table(spark, sf, "documents").select(F.col("doc_id").alias("cid"), "text"), "item_id").withColumnRenamed("item_id", "qid"), "gold")
    cutter = hanwords.segmenter(spark, hanwords.learn(docs, "han"))
    rows = None
    for name, terms in {"shingles": hanwords.shingles, "words": cutter.tokens}.items():
        index = bm25.build(docs, "doc_id", "han", terms=terms)
        made = evaluation.hits(evaluation.keyword_ranks(index, asked, 5, terms=terms), gold).select(F.lit(name).alias("terms"), "*")
        rows = made if rows is None else rows.unionByName(made)
    return rows
