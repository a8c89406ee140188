"""Near-duplicate documents by bottom-k MinHash sketches and banded candidates.

Equal sketches are one class, represented by its smallest key: a text with thousands of copies is one
row from there on, and copies are never expanded into pairs. Buckets then hold distinct sketches only.

strict (the default, as in the reference) compares what shares a band of positions, and so misses links
at any similarity below 1; with strict=False every two sketches that can be similar enough are compared.

A bucket of many sketches (they share an opening or a licence) isn't compared all with all. Two sketches
with a similarity of t or more share a value among the rarest of each: of n values the n - ceil(t n) + 1
that are in the fewest sketches. Members of large buckets, and all sketches with strict=False, meet only
on those, which loses nothing and makes no candidates of what is common.
"""

from __future__ import annotations

from hashlib import sha1
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, BLANKS, let
from ..storage import materialise
from .components import connected_components

K, SHINGLE, BANDS, ROWS, THRESHOLD = 64, 4, 16, 4, 0.8
LARGE = 200  # sketches in a bucket that are compared by their rarest values


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The k smallest distinct 64-bit hashes of the shingles (n words each; fewer words make one), as 16 hexadecimal
    digits, which sort alike. A shingle is a slice of its text's bytes, and only distinct ones are hashed."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_smallest(t.as_py(), k, n) for t in texts], pa.list_(pa.string()))

    return run(F.lower(text))


def _smallest(text: str | None, k: int, n: int) -> list[str] | None:
    if text is None:
        return None
    words = [w.encode() for w in text.split()]  # at BLANKS
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    if len(words) < n:
        cut = {joined}
    else:
        cut = {joined[i : j - 1] for i, j in zip([0, *ends], ends[n - 1 :], strict=False)}
    return [h.hex() for h in sorted({sha1(s, usedforsecurity=False).digest()[:8] for s in cut})[:k]]


def jaccard(a: Column, b: Column, k: int = K) -> Column:
    """Estimated similarity of two sketches; two empty ones are equal."""
    shared, together = F.array_intersect(a, b), F.array_union(a, b)
    within = let(F.get(F.array_sort(together), F.lit(k - 1)), lambda kth: F.size(F.filter(shared, lambda h: h <= kth)) / F.lit(k))
    full = (F.size(a) >= k) & (F.size(b) >= k)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .when(full, within).otherwise(F.size(shared) / F.size(together))
    )


def bands(of: Column, number: int = BANDS, rows: int = ROWS) -> Column:
    """Consecutive positions of the sorted sketch; bands beyond its end don't exist."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda i: F.struct(i.alias("band"), F.slice(of, i * rows + 1, F.lit(rows)).alias("seg")))
    return F.filter(cut, lambda c: F.size(c["seg"]) > 0)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sk) of the documents with at least two words."""
    enough = F.regexp_like(F.col(text), F.lit(f"[^{BLANKS}]{BLANK}+[^{BLANKS}]"))
    return docs.where(enough).select(F.col(key).alias("key"), sketch(F.col(text)).alias("sk"))


def classes(sketched: DataFrame) -> DataFrame:
    """(rep, sk, copies): each distinct sketch with its smallest key. Written, as it is read many times."""
    return materialise(sketched.groupBy("sk").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "sketch-classes")


def rare_prefixes(reps: DataFrame, threshold: float) -> DataFrame:
    """(rep, v): of each sketch the values that are in the fewest sketches, as many as two similar ones
    cannot both do without."""
    values = reps.select("rep", F.size("sk").alias("n"), F.explode("sk").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("often"))
    ordered = values.join(often, "v").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("often", "v"))).alias("vs"))  # K values
    needed = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")).cast("int") + 1
    return ordered.select("rep", F.explode(F.slice("vs", F.lit(1), needed)).alias("p")).where("p.often > 1").select("rep", "p.v")


def _cells(reps: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """(rep, band, seg): two sketches that are to be compared share a cell. Rare values are band -1."""
    rare = lambda some: rare_prefixes(some, threshold).select("rep", F.lit(-1).alias("band"), F.xxhash64("v").alias("seg"))
    if not strict:
        return materialise(rare(reps), "sketch-cells")
    cells = materialise(reps.select("rep", F.explode(bands(F.col("sk"))).alias("cell")).select("rep", "cell.band", F.xxhash64("cell.seg").alias("seg")), "sketch-cells")
    sizes = cells.groupBy("band", "seg").agg(F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n") > LARGE).select("band", "seg"), "crowded-cells")
    if large.isEmpty():
        return cells
    crowded = cells.join(large, ["band", "seg"], "left_semi").select("rep").distinct()
    return materialise(cells.join(large, ["band", "seg"], "left_anti").unionByName(rare(reps.join(crowded, "rep", "left_semi"))), "sketch-cells")


def _met(cells: DataFrame) -> DataFrame:
    """(a, b) of the reps that share a cell."""
    left, right = cells.withColumnRenamed("rep", "a"), cells.withColumnRenamed("rep", "b")
    return left.join(right, ["band", "seg"]).where("a < b").select("a", "b").distinct()


def _verified(found: DataFrame, reps: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """found (a, b) with sim, those that are similar enough and, if strict, share a band."""
    sketched = lambda x, y: reps.select(F.col("rep").alias(x), F.col("sk").alias(y))
    found = found.join(sketched("a", "sa"), "a").join(sketched("b", "sb"), "b")
    if strict:
        found = found.where(F.exists(F.arrays_zip(bands(F.col("sa")).alias("x"), bands(F.col("sb")).alias("y")), lambda z: z["x"]["seg"] == z["y"]["seg"]))
    return found.withColumn("sim", jaccard(F.col("sa"), F.col("sb"))).where(F.col("sim") >= threshold).select("a", "b", "sim")


def pairs(reps: DataFrame, threshold: float = THRESHOLD, strict: bool = True) -> DataFrame:
    """(a, b, sim) between class representatives, a < b, sim >= threshold: all pairs, which a family of n
    texts has n * n of. strict: only pairs that share a band of positions."""
    return _verified(_met(_cells(reps, threshold, strict)), reps, threshold, strict).withColumn("sim", F.round("sim", 4))


def links(reps: DataFrame, threshold: float = THRESHOLD, strict: bool = True) -> DataFrame:
    """(a, b): some of the pairs, which connect what all of them connect, in two levels. First every sketch is
    compared with the first one of each of its cells; that joins a family by an edge or a few for each
    member. Then, in cells with more than one component, those outside the cell's largest component are
    compared with all that are in other components; within a component nothing is left to find."""
    cells = _cells(reps, threshold, strict)
    first = cells.groupBy("band", "seg").agg(F.min("rep").alias("b"))
    stars = cells.join(first, ["band", "seg"]).where("rep != b").select(F.col("rep").alias("a"), "b").distinct()
    stars = materialise(_verified(stars, reps, threshold, strict).select("a", "b"), "sketch-stars")
    roots = connected_components(stars, "a", "b")
    labelled = materialise(cells.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "labelled-cells")
    sizes = labelled.groupBy("band", "seg", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band", "seg").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1").drop("roots")
    held = labelled.join(mixed, ["band", "seg"])
    minor = held.where("root != main").select("band", "seg", F.col("rep").alias("x"), F.col("root").alias("of_x"))
    met = minor.join(held.select("band", "seg", F.col("rep").alias("y"), "root"), ["band", "seg"]).where("of_x != root")
    rest = _verified(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), reps, threshold, strict)
    return stars.unionByName(rest.select("a", "b"))


def library_pairs(docs: DataFrame, library: str, key: str, text: str, threshold: float = THRESHOLD, strict: bool = True) -> DataFrame:
    """(library, a, b, sim) of all libraries, each compared within itself: the library is part of every
    hash, so that sketches of different libraries share nothing."""
    made = sketches(docs.select(F.struct(library, key).alias("_key"), text), "_key", text)
    marked = made.withColumn("sk", F.transform("sk", lambda h: F.concat(h, F.lit("@"), F.coalesce(F.col(f"key.{library}").cast("string"), F.lit("")))))
    reps = classes(marked)
    return pairs(reps, threshold, strict).select(F.col(f"a.{library}").alias(library), F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), "sim")


def clusters(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD, strict: bool = True) -> DataFrame:
    """(key, cluster): the smallest key reachable; only documents that have a near-duplicate."""
    sketched = materialise(sketches(docs, key, text), "sketches")
    reps = classes(sketched)
    roots = connected_components(links(reps, threshold, strict), "a", "b")
    labelled = reps.join(roots, F.col("rep") == F.col("node"), "left").where((F.col("copies") > 1) | F.col("root").isNotNull())
    labelled = labelled.select("sk", F.coalesce("root", "rep").alias("cluster"))
    return sketched.join(labelled, "sk").select("key", "cluster")


def statistics(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD, strict: bool = True) -> DataFrame:
    """One row: scanned, skipped, pairs (between classes), groups."""
    sketched = materialise(sketches(docs, key, text), "sketches")
    reps = classes(sketched)
    edges = materialise(pairs(reps, threshold, strict), "sketch-pairs")
    roots = connected_components(edges, "a", "b")
    grouped = reps.join(roots, F.col("rep") == F.col("node"), "left").where((F.col("copies") > 1) | F.col("root").isNotNull())
    groups = grouped.agg(F.count_distinct(F.coalesce("root", "rep")).alias("groups"))
    one = docs.agg(F.count("*").alias("all")).crossJoin(sketched.agg(F.count("*").alias("scanned"))).crossJoin(edges.agg(F.count("*").alias("pairs"))).crossJoin(groups)  # one row each
    return one.select("scanned", (F.col("all") - F.col("scanned")).alias("skipped"), "pairs", "groups")


def report(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD, most: int = 20, names: int = 5) -> str:
    """The statistics and the ``most`` largest groups as a text, with the first ``names`` keys of each."""
    s = statistics(docs, key, text, threshold).first()  # one row
    members = materialise(clusters(docs, key, text, threshold), "clusters")
    largest = members.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(most)
    first = members.join(F.broadcast(largest), "cluster").withColumn("_n", F.row_number().over(Window.partitionBy("cluster").orderBy("key"))).where(F.col("_n") <= names)
    lines = [f"{s['scanned']} documents compared, {s['skipped']} without enough words; {s['groups']} groups, {s['pairs']} pairs of different texts."]
    for r in first.groupBy("cluster", "n").agg(F.array_sort(F.collect_list("key")).alias("keys")).orderBy(F.desc("n"), "cluster").collect():  # most rows of names keys
        lines.append(f"- {r['n']} documents: " + ", ".join(map(str, r["keys"])) + (" ..." if r["n"] > len(r["keys"]) else ""))
    return "\n".join(lines)
