"""Near copies in a pipeline: several SimHash fingerprints a document, by meet-in-the-middle ball hashing.

One fingerprint of 64 bits within 3 bits finds copies with next to no edits: of pairs at a similarity of
0.8 (five-word shingles) that differ at all it finds few. So a document has ``FAMILIES`` independent
fingerprints of its set of words, which an edit changes least, and two documents are candidates if any
of these differ in at most ``RADIUS`` = 2 bits. Both walk half the radius: each fingerprint stands for
itself and its 64 variants at one bit, and all that share a variant of a family are within two bits of
each other. They are verified by the fingerprints of their three-word shingles, which see the order of
words: these differ in at most ``SHINGLE_BITS``; nine in ten pairs at a similarity of 0.8 do. Verification
has three levels, none of which makes all pairs. Each is verified against the first one, a star. Those
that are unlike the first, by the order of their words, are sorted by their shingles' fingerprint, rotated
by an amount that the variant sets, and each is verified against the ``LAGS`` before it. Links go through
distributed connected components. What these levels may leave out are links of the members of mixed groups,
those with a member unlike the first, that are still in different components (``rest``). For these a fingerprint is cut
into BLOCKS = RADIUS + 1 parts: two that differ in at most RADIUS bits have an equal one, so a class stands in 36 cells
there, not in 780 groups. In cells with more than one component each member is verified against all members of other
components, both by the family's fingerprints and by the shingles', by tiles of TILE members that meet in pairs, and what
is found joins components. So components are exactly those of all verified candidates. Cells of one component, nearly
all, are left out before any pair is made.

Unrelated documents are within 2 bits by chance with a probability of 1e-16 for each family, so the
number of candidates does not grow with the square of the number of documents.

Variants travel by the first bits of the variant: those that flip another bit stay where the fingerprint
itself goes, so a family costs a row for each of these first bits and one more.

Defined results: a null text is the empty text; empty texts are copies of each other. Texts have any
length. Of a group the row with the smallest (doc_id, hash of the text) stays, null last; of rows equal in
both, ties included, one stays, chosen by its other columns. An empty table gives an empty result. Other
columns are kept in a struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from ..operators.components import connected_components
from .shared import materialise, whole_row
from .simhash import DESTINATIONS, SEED, fingerprint

FAMILIES = 12
RADIUS = 2
SHINGLE_BITS = 13
LAGS = 4
TILE = 2048
BLOCKS = ((0, 21), (21, 21), (42, 22))  # (shift, bits), one more than RADIUS
_CHUNK = 255 * 4  # words at a time


def _mixed(h: np.ndarray) -> np.ndarray:
    """(words, FAMILIES) independent hashes from one, by the finalizer of SplitMix64."""
    steps = np.arange(1, FAMILIES + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        z = h[:, None] + steps * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def word_fingerprints(text: bytes | None) -> np.ndarray:
    """The FAMILIES fingerprints of a UTF-8 text's distinct words."""
    words = set((text or b"").lower().split())
    if not words:
        return np.zeros(FAMILIES, np.int64)
    hashes = np.frombuffer(b"".join(map(xxh64_digest, words, repeat(SEED))), ">u8").astype(np.uint64)
    ones = np.zeros(64 * FAMILIES, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(_mixed(hashes[i : i + _CHUNK]).astype(">u8").view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).view(">u8").astype(np.uint64).view(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() for t in batch.column(1).cast(pa.binary())]
        fps = pa.array([fingerprint(t) for t in texts], pa.int64())
        words = np.concatenate([word_fingerprints(t) for t in texts]) if texts else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * FAMILIES), pa.array(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fps, lists], ["doc_id", "text_hash", "fp", "words"])


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, words) of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(_mark, "doc_id long, text_hash long, fp long, words array<long>")


def grouped(classes: DataFrame) -> DataFrame:
    """(number, fp, family, top, variant): a row for each class and group. classes: number, fp, words, distinct in (fp, words)."""
    parts = max(DESTINATIONS, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = max(8, (8 * parts // FAMILIES).bit_length())  # bits that say where a variant goes
    low = 64 - first
    base = classes.select("number", "fp", F.posexplode("words").alias("family", "value"))
    # flip -1: the fingerprint itself and all variants by a low bit; else the variant by this one of the first bits
    dealt = base.select("number", "fp", "family", "value", F.explode(F.sequence(F.lit(-1), F.lit(first - 1))).alias("flip"))
    dealt = dealt.withColumn("value", F.expr(f"if(flip < 0, value, value ^ shiftleft(1L, flip + {low}))"))
    dealt = dealt.withColumn("top", F.expr(f"cast(shiftrightunsigned(value, {low}) as int)")).repartition(parts, "family", "top")
    near = F.expr(f"if(flip < 0, concat(array(value), transform(sequence(0, {low - 1}), i -> value ^ shiftleft(1L, i))), array(value))")
    return dealt.select("number", "fp", "family", "top", F.explode(near).alias("variant"))


def compared(classes: DataFrame) -> DataFrame:
    """(number, partner, mixed): what the first two levels find, and all members of mixed groups, those that have a
    member that is unlike the first one."""
    met = grouped(classes)
    in_group = Window.partitionBy("family", "top", "variant")
    group = in_group.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumns({"center": F.first("number").over(group), "center_fp": F.first("fp").over(group)})
    alike = lambda other: F.bit_count(F.col("fp").bitwiseXOR(other)) <= SHINGLE_BITS
    turn = F.expr("cast(4 * pmod(hash(variant, family), 16) as int)")
    turned = F.call_function("shiftleft", F.col("fp"), turn).bitwiseOR(F.call_function("shiftrightunsigned", F.col("fp"), (64 - turn).cast("int")))
    unlike = met.withColumn("close", alike(F.col("center_fp"))).withColumn("mixed", ~F.min("close").over(in_group))
    unlike = unlike.where("number != center OR mixed").withColumn("turned", turned)
    by_shingles = in_group.orderBy("close", "turned", "number")
    before = [F.lag(F.struct("number", "fp"), k).over(by_shingles) for k in range(1, LAGS + 1)]
    of_first = F.when(F.col("close") & (F.col("number") != F.col("center")), F.col("center"))
    partner = F.coalesce(of_first, *[F.when((F.col("number") != F.col("center")) & alike(x["fp"]), x["number"]) for x in map(F.col, (f"before_{k}" for k in range(LAGS)))])
    found = unlike.withColumns({f"before_{k}": x for k, x in enumerate(before)}).select("number", partner.alias("partner"), "mixed")
    return found.where("partner IS NOT NULL OR mixed")


def edges(found: DataFrame) -> DataFrame:
    """(a, b): edges between verified classes.

    In a large group a document has many partners, up to one for each of its variants. Instead of all of its
    edges to them there is one to the smallest, and one from each other partner to that: the same components
    with an edge for each document and some among the partners."""
    pairs = found.select("number", "partner").where("partner IS NOT NULL").distinct()
    least = pairs.groupBy("number").agg(F.min("partner").alias("b"), F.collect_list("partner").alias("partners"))  # FAMILIES * 65 at most
    return least.select(F.explode(F.concat(F.array("number"), "partners")).alias("a"), "b").where("a != b").distinct()


def links(classes: DataFrame) -> DataFrame:
    """(a, b): edges of the first two levels."""
    return edges(compared(classes))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): roots with near members in two tiles."""
    for batch in batches:
        for i in range(len(batch)):
            va, fa, ra, vb, fb, rb = (batch.column(k)[i].values.to_numpy() for k in range(6))
            apart = lambda x, y: np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64))
            found = set()
            for k in range(0, len(fa), 256):
                some = slice(k, k + 256)
                near = (apart(fa[some], fb) <= SHINGLE_BITS) & (ra[some, None] != rb[None, :])
                if near.any():
                    x, y = np.nonzero(near & (apart(va[some], vb) <= RADIUS))
                    found |= set(map(tuple, np.unique(np.stack([ra[k + x], rb[y]], axis=1), axis=0).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def rest(classes: DataFrame, found: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): roots that any two near members of mixed groups connect. roots: node, root."""
    named = roots.select(F.col("node").alias("number"), "root")
    mixed = classes.join(found.where("mixed").select("number").distinct(), "number", "left_semi").join(named, "number", "left")
    members = mixed.select("fp", F.coalesce("root", "number").alias("root"), F.posexplode("words").alias("family", "value")).distinct()
    parts = F.array(*[F.struct(F.lit(k).alias("block"), F.expr(f"shiftrightunsigned(value, {shift}) & {(1 << bits) - 1}L").alias("part")) for k, (shift, bits) in enumerate(BLOCKS)])
    cell, member = ["family", "block", "part"], F.struct("value", "fp", "root")
    members = materialise(members.select("*", F.inline(parts)), "near-members")
    groups = members.groupBy(*cell).agg(
        F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.xxhash64(member).cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), member)).alias("xor")
    )
    # cells of the same members are the same work: one of them stands for all
    apart = groups.where("low != high").groupBy("family", "size", "sum", "xor").agg(F.min(F.struct("block", "part")).alias("g")).select("family", "g.*", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    apart = materialise(apart, "near-apart")
    tile = F.pmod(F.xxhash64(member), F.col("tiles")).cast("int")
    tiles = members.join(apart, cell).groupBy(*cell, "tiles", tile.alias("tile")).agg(F.collect_list(member).alias("m"))
    tiles = materialise(tiles.select(*cell, "tiles", "tile", F.col("m.value").alias("values"), F.col("m.fp").alias("fps"), F.col("m.root").alias("roots")), "near-tiles")
    left = tiles.select(*cell, F.col("tile").alias("ta"), F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("tb"), F.col("values").alias("va"), F.col("fps").alias("fa"), F.col("roots").alias("ra"))
    right = tiles.select(*cell, F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("ta"), F.col("tile").alias("tb"), F.col("values").alias("vb"), F.col("fps").alias("fb"), F.col("roots").alias("rb"))
    return left.join(right, [*cell, "ta", "tb"]).select("va", "fa", "ra", "vb", "fb", "rb").mapInArrow(_across, "a long, b long").distinct()


def components(classes: DataFrame) -> DataFrame:
    """(node, root): the components of all verified candidates; classes without a partner are absent."""
    found = materialise(compared(classes), "near-compared")
    roots = materialise(connected_components(edges(found), "a", "b"), "near-roots")
    joined = connected_components(rest(classes, found, roots), "a", "b").select(F.col("node").alias("root"), F.col("root").alias("over"))
    # a class without a partner so far is its own root
    every = roots.unionByName(joined.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), "root"))
    return every.join(joined, "root", "left").select("node", F.coalesce("over", "root").alias("root"))


def keepers(marked: DataFrame) -> DataFrame:
    """(id, hash): of each group the smallest (doc_id, text_hash). marked: doc_id, text_hash, fp, words."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    classes = marked.groupBy("fp", "words").agg(F.min(first).alias("least")).withColumn("number", F.monotonically_increasing_id())
    classes = materialise(classes, "near-classes", marked.count())
    roots = materialise(components(classes.select("number", "fp", "words")), "near-components", classes.count())
    linked = roots.withColumnRenamed("node", "number")
    slim = classes.select("number", "least")
    grouped = slim.join(linked, "number").groupBy("root").agg(F.min("least").alias("least")).select("least")
    alone = slim.join(linked, "number", "left_anti").select("least")
    return grouped.unionByName(alone).select("least.id", "least.hash").distinct()


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and whatever else) that stay, one of each group."""
    marked = materialise(marks(docs), "near-marked")
    copies = marked.groupBy(F.col("doc_id").alias("id2"), F.col("text_hash").alias("hash2")).count()
    keep = keepers(marked).join(copies, F.col("id").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2"))).select("id", "hash", "count")
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_hash"))
    found = rows.join(keep, F.col("doc").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    again = found.where("count > 1").groupBy("id", "hash").agg(F.min("_row").alias("_row")).select("_row")
    return found.where("count = 1").select("_row").unionByName(again).select("_row.*")
