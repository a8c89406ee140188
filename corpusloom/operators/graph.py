"""Links between notes, the graph around them and semantic edges."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem, stripped, suffix
from ..storage import materialise
from . import vectorindex

#: Themes and the words in a path that mean them, in order of priority.
THEMES = (
    ("wemm", ("wemm", "页级", "视觉导航")),
    ("mineru", ("mineru", "ocr", "扫描")),
    ("chunk", ("切块", "清洗", "chunk", "嵌入", "向量", "检索", "重排", "embedding")),
    ("daily", ("journal", "日记", "周会", "会议记录", "meeting")),
    ("config", ("设置", "配置", "config", "门禁", "隐私")),
)
PAGE_NODES, HUBS = 24, 5
EDGE_SIMILARITY, EDGES_A_NODE, EDGE_CAP = 0.62, 4, 2000
BLOCKS, SMALL_BLOCK, LARGE_BLOCK = 16, 1024, 16_384  # many vectors: large blocks, so that each moves to few others
STRIPE = 512  # vectors of a block that are compared at a time
EDGE_CELLS = 64  # cells with bounds at most, if not told otherwise: blocks move once for each cell that is near
RETRIED = ("scanned", "extract-failed")


def theme(rel: Column) -> Column:
    low, out = F.lower(rel), F.lit("general")
    for name, words in reversed(THEMES):
        out = F.when(low.rlike("|".join(words)), F.lit(name)).otherwise(out)
    return out


def resolved_links(files: DataFrame) -> DataFrame:
    """(lib, src, dst): links that resolve, not to themselves. files: lib, rel, pos, links.

    A link is a path of its library, else a stem; of files with the same stem the last one is meant.
    """
    links = files.select("lib", F.col("rel").alias("src"), F.explode("links").alias("name"))
    exact = files.select(F.col("lib"), F.col("rel").alias("name"), F.col("rel").alias("by_path"))
    by_stem = files.groupBy("lib", stem(F.col("rel")).alias("stem")).agg(F.max_by("rel", F.struct("pos", "rel")).alias("by_stem"))
    found = links.withColumn("stem", stem(F.col("name"))).join(exact, ["lib", "name"], "left").join(by_stem, ["lib", "stem"], "left")
    return found.select("lib", "src", F.coalesce("by_path", "by_stem").alias("dst")).where("dst IS NOT NULL AND dst <> src").distinct()


def relations(files: DataFrame) -> DataFrame:
    """(lib, rel, outlinks, inlinks), sorted arrays, for every file."""
    links = resolved_links(files)
    outs = links.groupBy("lib", F.col("src").alias("rel")).agg(F.array_sort(F.collect_set("dst")).alias("outlinks"))
    ins = links.groupBy("lib", F.col("dst").alias("rel")).agg(F.array_sort(F.collect_set("src")).alias("inlinks"))
    none = F.array().cast("array<string>")
    joined = files.select("lib", "rel").join(outs, ["lib", "rel"], "left").join(ins, ["lib", "rel"], "left")
    return joined.select("lib", "rel", F.coalesce("outlinks", none).alias("outlinks"), F.coalesce("inlinks", none).alias("inlinks"))


def link_edges(files: DataFrame) -> DataFrame:
    """(lib, a, b): undirected, a < b."""
    return resolved_links(files).select("lib", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def pdf_state(failed: Column, reason: Column, signature: Column, current: str | None) -> Column:
    """done; queued: scanned, and nothing that could read it has changed; else failed."""
    waiting = (reason == "scanned") & signature.eqNullSafe(F.lit(current))
    return F.when(~F.coalesce(failed, F.lit(False)), F.lit("done")).when(waiting, F.lit("queued")).otherwise(F.lit("failed"))


def file_nodes(meta: DataFrame, on_disk: DataFrame, pages: DataFrame, signature: str | None = None) -> DataFrame:
    """Nodes of the indexed files and of PDFs on disk that aren't indexed.

    meta: lib, rel, chunks, updated, xfail, reason, xsrc. on_disk: lib, rel of PDFs. pages: lib, rel,
    pages, failed, reason of the page index.
    """
    pdf = F.lower("rel").endswith(".pdf")
    state = F.when(pdf, pdf_state(F.col("xfail"), F.col("reason"), F.col("xsrc"), signature)).otherwise(F.lit("done"))
    kind = F.when(suffix(F.col("rel")) == "", F.lit("md")).otherwise(suffix(F.col("rel")))
    known = meta.select(
        "lib", "rel", kind.alias("type"), F.when(state == "done", F.coalesce("chunks", F.lit(0))).otherwise(F.lit(0)).alias("chunks"), "updated",
        F.when(F.col("xfail"), F.col("reason")).alias("fail_reason"), state.alias("mineru"),
    )
    lower = meta.select(F.col("lib").alias("l"), F.lower("rel").alias("r"))
    new = on_disk.join(lower, (F.col("lib") == F.col("l")) & (F.lower("rel") == F.col("r")), "left_anti").select(
        "lib", "rel", F.lit("pdf").alias("type"), F.lit(0).alias("chunks"), F.lit(None).cast(known.schema["updated"].dataType).alias("updated"), F.lit(None).cast("string").alias("fail_reason"), F.lit("none").alias("mineru")
    )
    p = pages.select(F.col("lib").alias("l"), F.col("rel").alias("r"), F.col("failed").alias("page_failed"), F.col("reason").alias("page_reason"), F.col("pages").alias("n_pages"))
    both = known.unionByName(new).join(p, (F.col("lib") == F.col("l")) & (F.col("rel") == F.col("r")) & (F.col("type") == "pdf"), "left")
    wemm = F.when(F.col("r").isNull(), F.lit("none")).when(F.col("page_failed"), F.lit("failed")).otherwise(F.lit("done"))
    reason = F.coalesce("fail_reason", F.when(F.col("page_failed"), F.coalesce("page_reason", F.lit("页库渲染失败"))))
    return both.select(
        F.concat_ws("|", "lib", "rel").alias("id"), "lib", "rel", "type", "chunks", "updated", reason.alias("fail_reason"), theme(F.col("rel")).alias("theme"),
        F.struct(F.col("mineru"), wemm.alias("wemm")).alias("pipeline"), F.when(wemm == "done", F.col("n_pages")).alias("pages"),
    )


def page_nodes(pages: DataFrame, most: int = PAGE_NODES) -> DataFrame:
    """(lib, rel, id, parent, type, page): a node for each page, or one group node for a long file."""
    good = pages.where(~F.coalesce("failed", F.lit(False)))
    small = good.where(F.col("pages").between(1, most)).select("lib", "rel", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    small = small.select("lib", "rel", F.concat(F.col("lib"), F.lit("|wemm|"), F.col("rel"), F.lit("|p"), F.col("page")).alias("id"), F.lit("page").alias("type"), F.col("page").cast("int").alias("page"))
    large = good.where(F.col("pages") > most).select("lib", "rel", F.concat(F.col("lib"), F.lit("|wemm|"), F.col("rel"), F.lit("|grp")).alias("id"), F.lit("pagegroup").alias("type"), F.col("pages").cast("int").alias("page"))
    return small.unionByName(large).withColumn("parent", F.concat_ws("|", "lib", "rel"))


def hubs(edges: DataFrame, n: int = HUBS) -> DataFrame:
    """(id, degree) of the n best connected nodes, by id among equals. edges: a, b."""
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(n)


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(lib, nodes, edges) of a graph of several libraries. nodes: lib; edges: lib."""
    n, e = nodes.groupBy("lib").agg(F.count("*").alias("nodes")), edges.groupBy("lib").agg(F.count("*").alias("edges"))
    return n.join(e, "lib", "left").select("lib", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def mark_hubs(nodes: DataFrame, edges: DataFrame, n: int = HUBS) -> DataFrame:
    top = hubs(edges, n).select(F.col("id").alias("_hub"))  # n rows
    return nodes.join(F.broadcast(top), F.col("id") == F.col("_hub"), "left").withColumn("big", F.col("_hub").isNotNull()).drop("_hub")


def _unit(ids: list, vectors: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of a packed block, by id."""
    names = np.array(ids)
    order = np.argsort(names, kind="stable")
    x = np.frombuffer(vectors, kind).reshape(len(names), -1).astype(np.float64)[order]
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return names[order], x / np.where(norms > 0, norms, 1)


def _points(key: str, vector: str, vectors: DataFrame) -> Column:
    """(id, v); floats stay floats, all else is double."""
    floats = vectors.schema[vector].dataType.simpleString() == "array<float>"
    return F.struct(F.col(key).alias("id"), F.col(vector).cast("array<float>" if floats else "array<double>").alias("v"))


def _kind(dealt: DataFrame) -> str:
    return "<f4" if dealt.schema["p"].dataType["v"].dataType.elementType.simpleString() == "float" else "<f8"


def _blocks_of(rows: Column, block: int | None) -> Column:
    """How many blocks a cell of so many rows has."""
    size = F.lit(block) if block else F.greatest(F.lit(SMALL_BLOCK), F.least(F.lit(LARGE_BLOCK), F.ceil(rows / F.lit(BLOCKS))))
    return F.ceil(rows / size).cast("int")


def _packed(dealt: DataFrame) -> DataFrame:
    """(cell, blk, ids, vs) of dealt (cell, blk, p). vs: a block's vectors, one behind the other."""
    kind, key = _kind(dealt), dealt.schema["p"].dataType["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                points = batch.column(2)[i].values
                vs = points.field("v").flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, len(points)], pa.int32()), points.field("id"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), ids, pa.array([vs], pa.binary())], ["cell", "blk", "ids", "vs"])

    lists = dealt.groupBy("cell", "blk").agg(F.collect_list("p").alias("ps")).select("cell", "blk", "ps")
    return lists.mapInArrow(pack, f"cell int, blk int, ids array<{key}>, vs binary")


def _cells(vectors: DataFrame, key: str, vector: str, centers: int, probes: int):
    """Column function of a vector: the numbers of the nearest centers, which are as many vectors, those with
    the smallest hashes."""
    sample = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(centers)
    points = np.array([r[0] for r in sample.select(F.col(vector).cast("array<double>")).collect()], np.float64)  # centers rows
    norms = np.linalg.norm(points, axis=1, keepdims=True) if len(points) else np.ones((0, 1))
    points = (points / np.where(norms > 0, norms, 1)).astype(np.float32)

    @F.pandas_udf("array<int>")
    def run(batch: pd.Series) -> pd.Series:
        x = np.array(batch.tolist(), np.float32).reshape(len(batch), -1)
        return pd.Series(list(np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :probes].astype(np.int32))) if len(x) else pd.Series([], dtype=object)

    return run


def semantic_edges(vectors: DataFrame, key: str, vector: str, threshold: float = EDGE_SIMILARITY, per_node: int = EDGES_A_NODE, cap: int | None = EDGE_CAP, block: int | None = None, centers: int = 0, probes: int = 4) -> DataFrame:
    """(a, b, sim): each node's nearest at threshold or above, undirected, sim rounded after the test;
    cap: that many, in the order of nodes and their ranks.

    Exactly (centers=0), every vector is a query against all rows, so the work is quadratic by its nature.
    It is done block against block, each two of them once, for the nodes of both: vectors are packed into
    blocks in their own type, pairs of blocks meet by an equality on the pair (neither side is broadcast and
    there is no cross join), and of each pair only the nearest ``per_node`` of each node come out of the
    matrix product. A vector moves once for each block, so blocks are large (LARGE_BLOCK) where vectors are
    many; a task holds two blocks and a stripe of their product. block: another size.

    For many vectors there are cells: a vector belongs to its ``probes`` nearest of ``centers`` sampled
    vectors (a stated bound on the sample), and only blocks of a cell meet. Every vector is compared; an edge is found if its
    ends share a cell. The work is that of the exact way times probes^2 / centers for even cells. Recall is
    measured in the tests; more probes raise it.
    """
    kind = vectors.schema[key].dataType.simpleString()
    points = vectors.where(F.col(vector).isNotNull())
    cells = _cells(points, key, vector, centers, probes)(F.col(vector)) if centers else F.array(F.lit(0))
    dealt = points.select(_points(key, vector, vectors).alias("p"), F.explode(cells).alias("cell"))
    dealt = materialise(dealt, "cells")
    sizes = dealt.groupBy("cell").agg(_blocks_of(F.count("*"), block).alias("blocks"))  # a row for each cell
    numbered = dealt.join(F.broadcast(sizes), "cell").withColumn("blk", F.pmod(F.xxhash64("p.id"), F.col("blocks")).cast("int"))
    packed = materialise(_packed(numbered.select("cell", "blk", "p")), "blocks").join(F.broadcast(sizes), "cell")
    left = packed.select("cell", F.col("blk").alias("ba"), F.explode(F.sequence(F.col("blk"), F.col("blocks") - 1)).alias("bb"), F.col("ids").alias("ia"), F.col("vs").alias("va"))
    right = packed.select("cell", F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("ba"), F.col("blk").alias("bb"), F.col("ids").alias("ib"), F.col("vs").alias("vb"))

    met = left.join(right, ["cell", "ba", "bb"]).select((F.col("ba") == F.col("bb")).alias("same"), "ia", "va", "ib", "vb")
    met = met.mapInArrow(_best(threshold, per_node, _kind(dealt), kind), f"a {kind}, b {kind}, sim double")
    met = met.groupBy("a", "b").agg(F.max("sim").alias("sim")) if centers else met
    return _undirected(met, per_node, cap)


def _first(of: np.ndarray, other: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the first of their node: by similarity, then by the other."""
    order = np.lexsort((other, -np.round(sim, 9), of))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) != 0])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < most]


def _candidates(sims: np.ndarray, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of what may be among the first of its row or column."""
    good = sims >= threshold
    if good.mean() > 0.05:
        for axis in (0, 1):
            size = sims.shape[axis]
            least = np.partition(sims, size - min(most, size), axis=axis).take([size - min(most, size)], axis=axis) - 2e-9
            enough = sims >= least if axis == 0 else enough | (sims >= least)
        good &= enough
    return np.nonzero(good)


def _best(threshold: float, per_node: int, kind: str, key: str):
    """Of packed blocks (same, ia, va, ib, vb) each node's nearest in the other block, at threshold or above."""
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}

    def nearest(same: bool, left: tuple, right: tuple) -> Iterator[pa.RecordBatch]:
        (ia, xa), (ib, xb) = _unit(*left, kind), _unit(*right, kind)
        behind = []
        for i in range(0, len(ia), STRIPE):
            sims = xa[i : i + STRIPE] @ xb.T
            sims[ia[i : i + STRIPE, None] == ib[None, :]] = -2
            rows, columns = _candidates(sims, threshold, per_node)
            found, rows = sims[rows, columns], rows + i
            first = _first(rows, columns, found, per_node)
            yield batch(ia[rows[first]], ib[columns[first]], found[first])
            if not same:
                first = _first(columns, rows, found, per_node)
                behind.append((columns[first], rows[first], found[first]))
        if behind:
            of, other, sim = map(np.concatenate, zip(*behind, strict=True))
            first = _first(of, other, sim, per_node)
            yield batch(ib[of[first]], ia[other[first]], sim[first])

    def batch(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, types.get(key)), pa.array(b, types.get(key)), pa.array(sim, pa.float64())], ["a", "b", "sim"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in batches:
            for i in range(len(met)):
                same, ia, va, ib, vb = (met.column(k)[i] for k in range(5))
                yield from nearest(same.as_py(), (ia.values.to_pylist(), va.as_buffer()), (ib.values.to_pylist(), vb.as_buffer()))

    return best


def _undirected(met: DataFrame, per_node: int, cap: int | None) -> DataFrame:
    near = met.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("sim", 9)), "b"))).where(F.col("r") <= per_node)
    first = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct(F.col("a").alias("node"), "r")).alias("at"), F.max("sim").alias("sim"))
    out = first.select("a", "b", F.round("sim", 3).alias("sim"), "at")
    return (out.orderBy("at.node", "at.r", "a", "b").limit(cap) if cap else out).drop("at")


class BoundedBlocks(NamedTuple):
    """packed: cell, blk, ids, vs. pairs: cell, ba, other, bb, those that can reach the threshold. every: the number of all pairs."""

    packed: DataFrame
    pairs: DataFrame
    every: int
    kind: str


def bounded_blocks(vectors: DataFrame, key: str, vector: str, threshold: float, block: int | None = None, cells: int | None = None) -> BoundedBlocks:
    """Vectors packed in blocks of their cells (see vectorindex), and which blocks are to meet: two vectors are at
    least as far apart as their cells' centers, less both cells' widest angles, so cells for which that is
    more than the threshold's angle never meet."""
    points = vectors.where(F.col(vector).isNotNull()).select(_points(key, vector, vectors).alias("p")).select("p.id", "p.v")
    if cells is None:
        cells = min(EDGE_CELLS, vectorindex.default_cells(points.count()))
    centers = vectorindex.fit_centers(points, "v", cells)
    placed = materialise(vectorindex.assigned(points, "v", centers).select("cell", "angle", F.struct("id", "v").alias("p")), "placed")
    size = F.lit(block or LARGE_BLOCK)
    found = placed.groupBy("cell").agg(F.max("angle").alias("most"), F.ceil(F.count("*") / size).cast("int").alias("blocks")).orderBy("cell").collect()  # vectorindex.MOST_CELLS + 1 rows
    reach = np.arccos(np.clip(threshold, -1, 1)) + 1e-7
    known = [r for r in found if r["cell"] != vectorindex.NOWHERE]
    numbers, most = np.array([r["cell"] for r in known], int), np.array([r["most"] for r in known], float)
    away = np.arccos(np.clip(centers[numbers] @ centers[numbers].T, -1, 1)) if len(known) else np.zeros((0, 0))
    near = [(int(numbers[i]), int(numbers[j])) for i, j in np.argwhere(away - most[:, None] - most[None, :] <= reach)]
    if threshold <= 0:  # vectors without length have similarity 0 to all
        near += [pair for r in found for pair in {(vectorindex.NOWHERE, r["cell"]), (r["cell"], vectorindex.NOWHERE)}] if any(r["cell"] == vectorindex.NOWHERE for r in found) else []
    spark = vectors.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(r["cell"], r["blocks"]) for r in found], "cell int, blocks int"))
    dealt = placed.join(sizes, "cell").withColumn("blk", F.pmod(F.xxhash64("p.id"), F.col("blocks")).cast("int"))
    packed = materialise(_packed(dealt.select("cell", "blk", "p")), "bounded-blocks")
    meet = spark.createDataFrame(sorted(set(near)), "cell int, other int")
    names = packed.select("cell", "blk")
    pairs = names.withColumnRenamed("blk", "ba").join(meet, "cell").join(names.select(F.col("cell").alias("other"), F.col("blk").alias("bb")), "other")
    return BoundedBlocks(packed, pairs.select("cell", "ba", "other", "bb"), sum(r["blocks"] for r in found) ** 2, _kind(dealt))


def semantic_edges_by_bounds(vectors: DataFrame, key: str, vector: str, threshold: float = EDGE_SIMILARITY, per_node: int = EDGES_A_NODE, cap: int | None = EDGE_CAP, block: int | None = None, cells: int | None = None) -> DataFrame:
    """The rows of semantic_edges(), exactly, without the pairs of blocks that cannot reach the threshold. On vectors
    with topics most pairs go; on vectors without any, none does."""
    b = bounded_blocks(vectors, key, vector, threshold, block, cells)
    kind = vectors.schema[key].dataType.simpleString()
    left = b.packed.select("cell", F.col("blk").alias("ba"), F.col("ids").alias("ia"), F.col("vs").alias("va"))
    right = b.packed.select(F.col("cell").alias("other"), F.col("blk").alias("bb"), F.col("ids").alias("ib"), F.col("vs").alias("vb"))
    one, two = F.struct("cell", "ba"), F.struct(F.col("other").alias("cell"), F.col("bb").alias("ba"))
    once = b.pairs.where(one <= two).withColumn("same", one == two)  # each two blocks meet once, for the nodes of both
    met = once.join(left, ["cell", "ba"]).join(right, ["other", "bb"]).select("same", "ia", "va", "ib", "vb")
    return _undirected(met.mapInArrow(_best(threshold, per_node, b.kind, kind), f"a {kind}, b {kind}, sim double"), per_node, cap)


def backlink_target(link: Column) -> Column:
    """Of a link's inside: the file name, without alias, brackets, anchor and folder; empty if none."""
    t = stripped(F.substring_index(stripped(link), "|", 1))
    inner = stripped(F.regexp_extract(t, r"(?s)^\[(.*)\]$", 1))
    t = F.when(t.rlike(r"(?s)^\[.*\]$"), stripped(F.substring_index(inner, "|", 1))).otherwise(t)
    return stripped(F.substring_index(stripped(F.substring_index(t, "#", 1)), "/", -1))


def backlinks(files: DataFrame) -> DataFrame:
    """(target, sources): for each linked name, the files that link to it. files: rel, text."""
    links = files.select("rel", F.explode(F.regexp_extract_all("text", F.lit(r"!?\[\[([^\]]*)\]\]"), F.lit(1))).alias("link"))
    named = links.select("rel", backlink_target(F.col("link")).alias("target")).where("target <> ''").distinct()
    return named.groupBy("target").agg(F.array_sort(F.collect_list("rel")).alias("sources"))
