"""Mixing sources to target weights along a time-varying curriculum (DataFrame operations only).

Every source has a weight schedule over training time 0..1: a base weight times a piecewise-linear
shape. Its integral is the source's share; targets are water-filled under a cap of ``max_epochs``
times the source's size. A source's words, epoch after epoch, are its cumulative demand; the inverse
of the integrated schedule turns the number of words before a document into a training position, and
documents are range-sorted by position.

The words before a document need a running sum in each source. A source may hold a third of all rows,
so the sum has two levels: 4096 hash buckets in a source, summed with map-side combination, then a
window inside each (source, bucket).

Defined results: a null text has size 0, texts have any length; a null source is a source of its own, ordered last; a null
doc_id orders as the empty string; repeated rows are documents of their own (equal rows tie, and it
does not matter which of them comes first); a source without words has target 0; an empty table gives
an empty result. Input columns are kept in a struct, so their names may clash with those made here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, materialise, whole_row

#: Base weights, dealt to the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: One shape for each weight: (time, factor) knots, joined linearly. Heavy sources fade, light ones
#: are annealed in at the end. Each of these integrates to 1, so shares are those of the base weights.
SHAPES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)),
)
MAX_EPOCHS = 3
BUCKET_DIGITS = 3  # hexadecimal digits of the order key: 4096 buckets in a source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def integral(shape: Sequence[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(shape, shape[1:], strict=False))


def invert(shape: Sequence[tuple[float, float]], u: Column) -> Column:
    """The time at which a source with this shape has used the fraction u of its demand."""
    total, done, out = integral(shape), 0.0, None
    for (t0, w0), (t1, w1) in zip(shape, shape[1:], strict=False):
        # a x^2 + w0 x = area, in the form that also holds for a = 0
        area = u * F.lit(total) - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * area, F.lit(0.0)))
        time = F.lit(t0) + F.when(area <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * area / (F.lit(w0) + root))
        done += (t1 - t0) * (w0 + w1) / 2
        out = F.when(u * F.lit(total) < F.lit(done), time) if out is None else out.when(u * F.lit(total) < F.lit(done), time)
    return out.otherwise(F.lit(shape[-1][0]))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, shapes=SHAPES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds tier, weight and target.

    Shares follow the integrated weights; a target stops at max_epochs times the source's size and
    the excess is shared again. With the sources ordered by cap / weight, the water level of the
    uncapped ones is the greatest of (all words - caps before) / (weights from here on).
    """
    alone = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    tiers = sizes.withColumn("tier", F.pmod(F.row_number().over(alone) - 1, F.lit(n)).cast("int"))
    integrated = [w * integral(shapes[i % len(shapes)]) for i, w in enumerate(weights)]
    tiers = tiers.withColumn("weight", F.element_at(F.array(*map(F.lit, integrated)), F.col("tier") + 1))
    tiers = tiers.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / rest
    out = tiers.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return out.select("source", "source_size", "tier", "weight", F.round(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")), 6).alias("target"))


def plan_mix(docs: DataFrame, size: Column, weights=WEIGHTS, shapes=SHAPES, max_epochs: int = MAX_EPOCHS, whole: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, source and whatever else): _row (the input row), size,
    source_size, target, taken, positions (one for each copy that the mix takes).

    A source takes its target to the word: whole epochs, then documents in the order of the MD5 of
    doc_id, the last of them in part. whole=True takes that last one wholly if half of it or more
    falls within the target, else not at all.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(whole_row(docs), F.col("source"), size.alias("size"), key.alias("key"), F.col("doc_id").alias("id"))
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, shapes, max_epochs)
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(running), F.lit(0)))
    offsets = offsets.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "words")
    offsets = materialise(offsets, "mix-offsets").withColumnsRenamed({"source": "s", "bucket": "b"})

    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, (F.col("bucket") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")))
    start = F.col("offset") + F.col("before")
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    left = goal - epochs * F.col("source_size")
    if whole:
        part = F.when(start + F.col("size") / 2 < left, F.col("size")).otherwise(F.lit(0))
    else:
        part = F.greatest(F.lit(0), F.least(left - start, F.col("size")))
    rows = rows.withColumns({"start": start, "epochs": epochs, "part": part.cast("long")})
    copies = (F.col("epochs") + (F.col("part") > 0).cast("int")).cast("int")
    used = lambda j: (j * F.col("source_size") + F.col("start")) / F.greatest(F.col("target"), F.lit(1.0))

    def position(j: Column) -> Column:
        out = F.when(F.col("tier") == 0, invert(shapes[0], used(j)))
        for i in range(1, len(weights)):
            out = out.when(F.col("tier") == i, invert(shapes[i % len(shapes)], used(j)))
        return F.round(out, 6)

    numbers = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    return rows.select(
        "_row", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        F.transform(numbers, position).alias("positions"),
    )


def mix_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, range-sorted by position."""
    plan = plan_mix(docs, word_count(F.col(text)), whole=True, **options)
    copies = plan.select("_row", F.explode("positions").alias("_position"))
    return copies.orderBy("_position", F.col("_row.doc_id")).select("_row.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """op1: the plan over all documents, range-sorted by first position; those not taken come last."""
    from .shared import documents

    sized = materialise(documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("words")), "mix-sizes")
    plan = plan_mix(sized, F.col("words"))
    out = plan.select(
        F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.when(F.size("positions") > 0, F.element_at("positions", 1)).alias("first_position"),
        F.size("positions").cast("long").alias("copies"),
    )
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def _sql_invert(shape, u: str) -> str:
    total, done, out = integral(shape), 0.0, "CASE"
    for (t0, w0), (t1, w1) in zip(shape, shape[1:], strict=False):
        area = f"({u} * {total}::DOUBLE - {done}::DOUBLE)"
        slope = 2 * (w1 - w0) / (t1 - t0)
        done += (t1 - t0) * (w0 + w1) / 2
        out += (
            f" WHEN {u} * {total}::DOUBLE < {done}::DOUBLE THEN {t0}::DOUBLE + CASE WHEN {area} <= 0 THEN 0.0::DOUBLE"
            f" ELSE 2.0::DOUBLE * {area} / ({w0}::DOUBLE + sqrt(greatest({w0 * w0}::DOUBLE + {slope}::DOUBLE * {area}, 0.0::DOUBLE))) END"
        )
    return out + f" ELSE {shape[-1][0]}::DOUBLE END"


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), t AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT AS tier FROM s
), w AS (
  SELECT *, CASE tier WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS cap FROM t
), v AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
     / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), g AS (
  SELECT source, source_size, tier, round(least(cap::DOUBLE, weight * max(level) OVER ()), 6) AS target FROM v
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.tier, g.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    CASE WHEN g.source_size > 0 THEN round(g.target)::BIGINT // g.source_size ELSE 0 END AS epochs
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), p AS (
  SELECT *, greatest(0, least(round(target)::BIGINT - epochs * source_size - start, size)) AS part, start / greatest(target, 1.0::DOUBLE) AS u FROM r
)
SELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken,
  CASE WHEN epochs + (part > 0)::INT > 0 THEN round(CASE tier WHEN 0 THEN {_sql_invert(SHAPES[0], "u")} WHEN 1 THEN {_sql_invert(SHAPES[1], "u")} ELSE {_sql_invert(SHAPES[2], "u")} END, 6) END AS first_position,
  (epochs + (part > 0)::INT)::BIGINT AS copies
FROM p
"""
