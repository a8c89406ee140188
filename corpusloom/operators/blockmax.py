"""Keyword search by block maxima: a stored index of which a query reads a part.

Chunks are numbered by length within their library and cut into blocks of ``SIZE`` of them. The index has a row
for each term and block that has it: the largest frequency and the smallest length of the entries there,
and the entries themselves, in a column of their own. From the two numbers follows the most that a chunk
of the block can get from the term, whatever the statistics are.

A query reads the two numbers of its terms' blocks first, without entries. Their sums bound the blocks. The
entries of the ``SEEDS`` most promising blocks give true scores; the k-th best of these is what others must
reach. Entries are then read of the blocks whose bound reaches it, and of no others; nothing is lost.
Rows lie sorted by (lib, term, block), so the reader skips row groups and pages that hold other ones.

To build it, texts move once, to their chunk's number. Their terms are then sorted where they are: a task sends to each range of
(lib, term, span of blocks) one compressed row, with the documents that it has there and the entries as numbers of them.

The statistics are stored with the index: chunks and words of each library, and of each term in how many
chunks it is. A query aggregates neither lengths nor postings.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions.text import tokens
from ..storage import materialise
from .bm25 import B, K1, Terms, query_terms, score_term
from .ranking import group_rank

SIZE = 128
SEEDS = 8
SPAN = 1024  # blocks whose entries of a term move to one place
WORDS, MOST_DOCS = 1 << 21, 1 << 16  # of texts that are packed at a time; entries of a part, about
POINTS, MOST_POINTS, SAMPLED = 64, 1 << 18, 4096  # keys that are sampled for a bound, for all; documents they come from, at least
ROWS = 1 << 14  # blocks that leave together
LISTED_BLOCKS = 2000  # more are joined, not listed in a filter
MARGIN = 1e-6  # for scores that differ by rounding


class BlockIndex(NamedTuple):
    """blocks: lib, term, block, n, most_tf, least_dl, entries (cid, tf, dl). terms: lib, term, df.
    totals: lib, n, words."""

    blocks: DataFrame
    terms: DataFrame
    totals: DataFrame


class Ordered(BlockIndex):
    """Its blocks lie in the order in which they are to be written."""


def build(docs: DataFrame, key: str, text: str, lib: str | None = None, size: int = SIZE, terms: Terms = tokens) -> BlockIndex:
    """docs: a row for each chunk. lib: column that says whose statistics count; else all rows are one.
    terms: what makes the terms, of questions too."""
    group = F.col(lib) if lib else F.lit("")
    texts = docs.select(group.alias("lib"), F.col(key).alias("cid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    listed = texts.select("lib", "cid", terms(F.col("text")).alias("terms"))
    lengths = materialise(listed.select("lib", "cid", F.size("terms").cast("long").alias("dl")), "lengths")  # read four times: to count, to find ranges, to number, for the totals
    numbered = group_rank(lengths, "lib", [F.col("dl"), F.col("cid")], "rank")
    numbered = numbered.select(F.col("lib").alias("_lib"), F.col("cid").alias("_cid"), (F.col("rank") - 1).alias("rank"))

    def placed(some: DataFrame) -> DataFrame:
        met = some.join(numbered.hint("shuffle_hash"), F.col("lib").eqNullSafe(F.col("_lib")) & (F.col("cid") == F.col("_cid")))
        return met.select("lib", "cid", "rank", terms(F.col("text")).alias("terms"))

    whole = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()  # one row
    parts, reach = -(-whole["words"] // WORDS), size * SPAN
    bounds = []
    if parts > 1:
        points = min(POINTS * parts, MOST_POINTS)
        share = min(1.0, max(SAMPLED / whole["n"], 16 * points / whole["words"]))
        keys = placed(texts.sample(share, 0)).select("lib", F.explode(F.array_distinct("terms")).alias("term"), F.expr(f"rank div {reach}").alias("span"))
        seen = sorted(map(_place, keys.sample(min(1.0, points / whole["words"] / share), 0).collect()))
        bounds = sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []
    blocks = _blocks(_packed(placed(texts), reach, bounds), len(bounds) + 1, texts.schema["lib"].dataType, texts.schema["cid"].dataType, size)
    totals = lengths.groupBy("lib").agg(F.count("*").alias("n"), F.sum("dl").alias("words"))
    return Ordered(blocks, blocks.groupBy("lib", "term").agg(F.sum("n").alias("df")), totals)


def _place(key: tuple) -> tuple:
    """Of (lib, term, span), in an order in which null comes first."""
    return (key[0] is not None, *((key[0],) if key[0] is not None else ()), *key[1:])


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(numbers of the values, distinct values), both in order; null comes first."""
    found = values.dictionary_encode("encode")
    order = pc.sort_indices(found.dictionary, null_placement="at_start")
    number = np.empty(len(order), np.int64)
    number[order.to_numpy()] = np.arange(len(order))
    return number[found.indices.to_numpy()], found.dictionary.take(order)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before, and the first."""
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))) if len(columns[0]) else np.zeros(0, int)


def _chunk_schema(lib: pa.DataType, cid: pa.DataType) -> pa.Schema:
    """Of the entries of some documents' terms, in one row: terms and how many entries each has; entries: number of the document, tf;
    documents: lib, cid, rank, dl."""
    kinds = {"term": pa.string(), "n": pa.int32(), "doc": pa.uint16(), "tf": pa.int32(), "lib": lib, "cid": cid, "rank": pa.int64(), "dl": pa.int32()}
    return pa.schema([(name, pa.list_(kind)) for name, kind in kinds.items()])


def _packed(placed: DataFrame, reach: int, bounds: list[tuple]) -> DataFrame:
    """(part, size, chunk) of placed documents (lib, cid, rank, terms): what a task has of a part of all (lib, term, span), which
    bounds cut; compressed, size is what it was before. A span has reach ranks."""

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        listed, rank = docs.column("terms"), docs.column("rank").to_numpy()
        dl, span = listed.value_lengths().to_numpy(), rank // reach
        of_lib, libs = _coded(docs.column("lib"))
        number, names = _coded(listed.flatten())
        if not len(names):
            return
        code, tf = np.unique(number * len(docs) + np.repeat(np.arange(len(docs)), dl), return_counts=True)
        term, doc = np.divmod(code, len(docs))
        order = np.lexsort((span[doc], term, of_lib[doc]))
        term, doc, tf = term[order], doc[order], tf[order]
        keys = _changes(of_lib[doc], term, span[doc])
        key = lambda i: _place((libs[of_lib[doc[i]]].as_py(), names[int(term[i])].as_py(), int(span[doc[i]])))
        cuts = [0, *(int(keys[at]) if (at := bisect_left(range(len(keys)), b, key=lambda j: key(int(keys[j])))) < len(keys) else len(doc) for b in bounds), len(doc)]
        schema, made = _chunk_schema(docs.column("lib").type, docs.column("cid").type), []
        for part, (low, high) in enumerate(itertools.pairwise(cuts)):
            if low == high:
                continue
            some, here = np.unique(doc[low:high], return_inverse=True)
            first = _changes(of_lib[doc[low:high]], term[low:high])
            columns = [names.take(pa.array(term[low:high][first])), np.diff(np.append(first, high - low)), here, tf[low:high], *(docs.column(c).take(pa.array(some)) for c in ("lib", "cid")), rank[some], dl[some]]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c, f.type.value_type)) for c, f in zip(columns, schema, strict=True)]
            message = pa.RecordBatch.from_arrays(lists, schema=schema).serialize()
            made.append((part, message.size, pa.compress(message, "zstd", asbytes=True)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "size", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, rows = [], 0, 0
        for batch in batches:
            sizes = np.cumsum(batch.column("terms").value_lengths().to_numpy())
            begin = 0
            while begin < len(batch):  # as many documents as have WORDS words, one at least
                before = int(sizes[begin - 1]) if begin else 0
                end = min(max(begin + 1, int(np.searchsorted(sizes, before + WORDS - words, "right"))), begin + MOST_DOCS - rows)
                held.append(batch.slice(begin, end - begin))
                words, rows, begin = words + int(sizes[end - 1]) - before, rows + end - begin, end
                if words >= WORDS or rows >= MOST_DOCS or begin < len(batch):
                    yield from pack(held)
                    held, words, rows = [], 0, 0
        if held:
            yield from pack(held)

    return placed.mapInArrow(run, "part int, size long, chunk binary")


def _blocks(chunks: DataFrame, parts: int, lib: DataType, cid: DataType, size: int) -> DataFrame:
    """Blocks of what _packed() makes. The files that they are written to are sorted by lib, term and block."""
    schema = _chunk_schema(to_arrow_type(lib), to_arrow_type(cid))

    def unpack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {f.name: pa.concat_arrays([b.column(f.name).flatten() for b in held]) for f in schema}
        n = np.array([[len(b.column(c)[0]) for c in ("doc", "rank")] for b in held])
        doc = lists["doc"].to_numpy().astype(np.int64) + np.repeat(np.cumsum(n[:, 1]) - n[:, 1], n[:, 0])
        of_lib, libs = _coded(lists["lib"])
        number, names = _coded(lists["term"])
        term, tf = np.repeat(number, lists["n"].to_numpy()), lists["tf"].to_numpy().astype(np.int64)
        rank, dl = lists["rank"].to_numpy(), lists["dl"].to_numpy().astype(np.int64)
        order = np.lexsort((dl[doc], rank[doc], term, of_lib[doc]))
        term, doc, tf = term[order], doc[order], tf[order]
        # rows with one key and length are one document, their frequencies are added; it is met at each of their ranks
        first = _changes(of_lib[doc], term, rank[doc], dl[doc])
        term, doc, tf = term[first], doc[first], np.add.reduceat(tf, first)
        block, long = rank[doc] // size, dl[doc]
        at = _changes(of_lib[doc], term, block)
        ends = np.append(at, len(doc))
        most, least, of_entry = np.maximum.reduceat(tf, at), np.minimum.reduceat(long, at), pa.array(doc)
        for i in range(0, len(at), ROWS):
            here, bound = at[i : i + ROWS], ends[i : i + ROWS + 1]
            low, high = int(bound[0]), int(bound[-1])
            entries = pa.StructArray.from_arrays([lists["cid"].take(of_entry[low:high]), pa.array(tf[low:high]), pa.array(long[low:high])], ["cid", "tf", "dl"])
            columns = [libs.take(pa.array(of_lib[doc[here]])), names.take(pa.array(term[here])), *map(pa.array, (block[here], np.diff(bound), most[i : i + ROWS], least[i : i + ROWS]))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array((bound - low).astype(np.int32)), entries)], ["lib", "term", "block", "n", "most_tf", "least_dl", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None
        for batch in batches:
            for i in range(len(batch)):
                if held and batch.column("part")[i].as_py() != part:
                    yield from unpack(held)
                    held = []
                part = batch.column("part")[i].as_py()
                message = pa.decompress(batch.column("chunk")[i].as_buffer(), batch.column("size")[i].as_py(), "zstd")
                held.append(pa.ipc.read_record_batch(message, schema))
        if held:
            yield from unpack(held)

    kind = f"lib {lib.simpleString()}, term string, block long, n long, most_tf long, least_dl long, entries array<struct<cid: {cid.simpleString()}, tf: long, dl: long>>"
    dealt = chunks.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, kind).withColumn("entries", F.array_sort("entries"))


def write(index: BlockIndex, path: str, row_group: int | None = None) -> BlockIndex:
    """Stores the index under path. row_group: bytes of a row group, if not the default."""
    spark = index.blocks.sparkSession
    rows = index.blocks if isinstance(index, Ordered) else index.blocks.repartitionByRange("lib", "term", "block").sortWithinPartitions("lib", "term", "block")
    rows = rows.write
    (rows.option("parquet.block.size", row_group) if row_group else rows).parquet(f"{path}/blocks")
    stored = spark.read.parquet(f"{path}/blocks")
    terms = stored.groupBy("lib", "term").agg(F.sum("n").alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    index.totals.write.parquet(f"{path}/totals")
    return read(spark, path)


def read(spark, path: str) -> BlockIndex:
    return BlockIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "terms", "totals")))


class Weights(NamedTuple):
    """Of a query: a row for each library and term that has it."""

    rows: DataFrame  # lib, term, qtf, df, docs, avgdl
    terms: list[str]


def weights(index: BlockIndex, query: str, terms: Terms = tokens) -> Weights | None:
    spark, asked = index.blocks.sparkSession, query_terms(index.blocks.sparkSession, query, terms)
    if not asked:
        return None
    rows = spark.createDataFrame(list(asked.items()), "term string, qtf long")
    known = index.terms.where(F.col("term").isin(*asked)).join(F.broadcast(rows), "term")  # the query's terms
    totals = index.totals.select(F.col("lib").alias("_lib"), F.col("n").alias("docs"), (F.col("words") / F.col("n")).alias("avgdl"))
    joined = known.join(totals, F.col("lib").eqNullSafe(F.col("_lib"))).drop("_lib")
    return Weights(joined, list(asked))


def _part(tf: Column, dl: Column) -> Column:
    return score_term(tf, F.col("qtf"), F.col("df"), dl, F.col("docs"), F.col("avgdl"), K1, B)


def bounded(index: BlockIndex, asked: Weights) -> DataFrame:
    """(lib, block, bound): the most that a chunk of each block can score. Entries are not read."""
    heads = index.blocks.where(F.col("term").isin(*asked.terms)).select("lib", "term", "block", "most_tf", "least_dl")
    w = asked.rows.withColumnRenamed("lib", "_lib").withColumnRenamed("term", "_term")
    joined = heads.join(w, F.col("lib").eqNullSafe(F.col("_lib")) & (F.col("term") == F.col("_term")))
    return joined.groupBy("lib", "block").agg(F.sum(_part(F.col("most_tf"), F.col("least_dl"))).alias("bound"))


def scored(index: BlockIndex, asked: Weights, chosen: DataFrame, listed: list[int] | None = None) -> DataFrame:
    """(lib, cid, bm25) of the chunks in the chosen blocks (lib, block). listed: their numbers, if they are few."""
    rows = index.blocks.where(F.col("term").isin(*asked.terms))
    if listed is not None:
        rows = rows.where(F.col("block").isin(*listed)) if listed else rows.limit(0)
    c = chosen.select(F.col("lib").alias("_lib"), F.col("block").alias("_block"))
    rows = rows.join(c, F.col("lib").eqNullSafe(F.col("_lib")) & (F.col("block") == F.col("_block")), "left_semi")
    w = asked.rows.withColumnRenamed("lib", "_lib").withColumnRenamed("term", "_term")
    rows = rows.join(w, F.col("lib").eqNullSafe(F.col("_lib")) & (F.col("term") == F.col("_term"))).drop("_lib", "_term")
    entries = rows.select("*", F.inline("entries"))
    return entries.groupBy("lib", "cid").agg(F.sum(_part(F.col("tf"), F.col("dl"))).alias("bm25")).where("bm25 > 0")


class Found(NamedTuple):
    """rows: lib, cid, bm25. bounds: the blocks that have a term of the query; wanted: those whose entries are read."""

    rows: DataFrame
    bounds: DataFrame
    wanted: DataFrame

    @property
    def blocks(self) -> int:
        return self.bounds.count()

    @property
    def read(self) -> int:
        return self.wanted.count()


def top(index: BlockIndex, query: str, k: int, seeds: int = SEEDS, margin: float = MARGIN, terms: Terms = tokens) -> Found:
    """Of each library the k best chunks, and those within the margin of the k-th."""
    spark, asked = index.blocks.sparkSession, weights(index, query, terms)
    lib, cid = index.blocks.schema["lib"].dataType, index.blocks.schema["entries"].dataType.elementType["cid"].dataType
    if asked is None:
        none = index.blocks.select("lib", "block").limit(0)
        return Found(none.select("lib", F.lit(None).cast(cid).alias("cid"), F.lit(0.0).alias("bm25")), none, none)
    bounds = materialise(bounded(index, asked), "block-bounds")
    place = F.row_number().over(Window.partitionBy("lib").orderBy(F.desc("bound"), "block"))
    first = bounds.withColumn("place", place).where(F.col("place") <= seeds).select("lib", "block").collect()  # a few of each library
    frame = spark.createDataFrame([tuple(r) for r in first], f"lib {lib.simpleString()}, block long")
    known = scored(index, asked, frame, sorted({r["block"] for r in first}) if len(first) <= LISTED_BLOCKS else None)
    best = F.row_number().over(Window.partitionBy("lib").orderBy(F.desc("bm25")))
    least = known.withColumn("place", best).where(F.col("place") == k).select("lib", F.col("bm25") - margin).collect()  # a row for each library
    least = F.broadcast(spark.createDataFrame([tuple(r) for r in least], f"_lib {lib.simpleString()}, least double"))
    # libraries with fewer than k scores so far have no least: all of their blocks are read
    wanted = bounds.join(least, F.col("lib").eqNullSafe(F.col("_lib")), "left").where("least IS NULL OR bound >= least").select("lib", "block")
    some = [r["block"] for r in wanted.select("block").distinct().limit(LISTED_BLOCKS + 1).collect()]
    rows = scored(index, asked, wanted, some if len(some) <= LISTED_BLOCKS else None)
    rows = rows.join(least, F.col("lib").eqNullSafe(F.col("_lib")), "left").where("least IS NULL OR bm25 >= least")
    return Found(rows.select("lib", "cid", "bm25"), bounds, wanted)
