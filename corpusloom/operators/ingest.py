"""Incremental ingest: what changed, what is stale, what nobody refers to, and the index tables.

Everything is a join of the files as they are with the metadata as it was. A library whose folder is
missing or empty never loses its rows by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import CHUNK_LIMIT, SHORT_DOCUMENT, document_pieces
from ..functions.text import clean_wikilinks, context, front_body, front_field, placeholder_heavy, stem, strip_boilerplate, strip_dead_images, strip_page_numbers, strip_sidecar_noise, stripped, wikilink_targets

META_VERSION = 1
#: Reasons of files that have no pieces, and the mark of one that can't be read.
REASONS = ("unreadable", "extract-failed", "empty", "tbd", "scanned")
UNREADABLE = "unreadable"
RETRIED = ("scanned", "extract-failed")
PLACEHOLDER_RATIO = 0.1


def terminal(xfail: Column, tbd: Column) -> Column:
    """A state without pieces that is kept, so that the file isn't tried each time."""
    return F.coalesce(xfail, F.lit(False)) | F.coalesce(tbd, F.lit(False))


def worth_retrying(xfail: Column, reason: Column, signature: Column, current: Column) -> Column:
    """Failed by extraction under other abilities than there are now."""
    return F.coalesce(xfail & reason.isin(*RETRIED), F.lit(False)) & ~signature.eqNullSafe(current)


def converged(xfail: Column, known: Column, reason: Column) -> Column:
    return F.coalesce(xfail & (known == reason), F.lit(False))


def links_missing(xfail: Column, tbd: Column, links: Column) -> Column:
    return ~terminal(xfail, tbd) & links.isNull()


def diff(listing: DataFrame, meta: DataFrame, signature: str | None = None) -> DataFrame:
    """(lib, rel, status): added, removed, changed, retry or same.

    listing: lib, rel, size, mtime_ns, hash. meta: lib, rel, size, mtime_ns, hash, xfail, reason, xsrc.
    Equal size and time need no look at the hash.
    """
    old = meta.select("lib", "rel", *[F.col(c).alias(f"old_{c}") for c in ("size", "mtime_ns", "hash", "xfail", "reason", "xsrc")], F.lit(True).alias("known"))
    both = listing.select("lib", "rel", "size", "mtime_ns", "hash", F.lit(True).alias("there")).join(old, ["lib", "rel"], "full")
    untouched = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime_ns").eqNullSafe(F.col("old_mtime_ns"))
    retry = worth_retrying(F.col("old_xfail"), F.col("old_reason"), F.col("old_xsrc"), F.lit(signature))
    status = (
        F.when(F.col("known").isNull(), "added").when(F.col("there").isNull(), "removed").when(retry, "retry")
        .when(untouched | F.col("hash").eqNullSafe(F.col("old_hash")), "same").otherwise("changed")
    )
    return both.select("lib", "rel", status.alias("status"))


def diff_counts(diffed: DataFrame, meta: DataFrame) -> DataFrame:
    """(lib, added, removed, changed, retry, same, emptied, stale). A library that had files and lists
    none now is emptied: that is no reason to delete."""
    counts = diffed.groupBy("lib").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "retry", "same")])
    had = meta.groupBy("lib").agg(F.count("*").alias("had"))
    joined = counts.join(had, "lib", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    emptied = (F.col("had") > 0) & (F.col("removed") == F.col("had")) & (F.col("added") + F.col("changed") + F.col("retry") + F.col("same") == 0)
    stale = ~emptied & (F.col("added") + F.col("removed") + F.col("changed") + F.col("retry") > 0)
    return joined.select("lib", "added", "removed", "changed", "retry", "same", emptied.alias("emptied"), stale.alias("stale"))


def consistent(meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """(lib, expected, actual, consistent): pieces by the metadata and in the index."""
    expected = meta.groupBy("lib").agg(F.sum(F.coalesce("chunks", F.lit(0))).alias("expected"))
    actual = chunks.groupBy("lib").agg(F.count("*").alias("actual"))
    joined = expected.join(actual, "lib", "full").select("lib", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return joined.withColumn("consistent", F.col("expected") == F.col("actual"))


def fingerprint(meta: DataFrame) -> DataFrame:
    """(lib, fingerprint): of a library's paths and hashes, 16 hexadecimal digits."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "rel", "hash")))
    return meta.groupBy("lib").agg(F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 16).alias("fingerprint"))


def stale_chunks(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows of chunks (lib, rel, chunk) whose file is gone or has fewer pieces now."""
    live = meta.select("lib", "rel", F.coalesce("chunks", F.lit(0)).alias("_pieces"))
    joined = chunks.join(live, ["lib", "rel"], "left")
    return joined.where(F.col("_pieces").isNull() | (F.col("chunk") < 0) | (F.col("chunk") >= F.col("_pieces"))).drop("_pieces")


def orphans(existing: DataFrame, referenced: DataFrame, pending: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of existing (hash) that no registered library and no pending job refers to. An empty registry
    finds nothing: it is more likely lost than true."""
    live = referenced.join(registry.select("lib").distinct(), "lib", "left_semi").select("hash").unionByName(pending.select("hash")).distinct()
    known = registry.agg((F.count("*") > 0).alias("_any"))  # one row
    return existing.crossJoin(F.broadcast(known)).where("_any").drop("_any").join(live, "hash", "left_anti")


def live_jobs(pending: DataFrame, listing: DataFrame) -> DataFrame:
    """Pending jobs (path, hash) whose file still is what was sent."""
    return pending.join(listing.select("path", "hash").distinct(), ["path", "hash"], "left_semi")


def publish(old: DataFrame, new: DataFrame, touched: DataFrame, keys: tuple[str, ...] = ("lib", "rel")) -> DataFrame:
    """The next version of a table: rows of untouched keys as they were, and the new ones."""
    return old.join(touched.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def chunk_files(files: DataFrame, limit: int = CHUNK_LIMIT, short: int = SHORT_DOCUMENT, ratio: float = PLACEHOLDER_RATIO, with_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """files: lib, rel, text, and optionally blocks (page furniture by the extractor). Returns (chunks:
    lib, rel, chunk, heading, title, tags, hp, ctx, body, text; states: lib, rel, reason, links). with_links:
    chunks have their file's links too, for those who need both: each table cleans the texts by itself.

    Order of the cleaning: links out of the text, wiki links, dead images, page furniture, page numbers,
    lines that repeat.
    """
    has_blocks = "blocks" in files.columns
    heavy = placeholder_heavy(F.coalesce("text", F.lit("")), ratio)
    whole = F.coalesce(F.col("text"), F.lit(""))
    read = files.withColumns({"heavy": heavy, "title": front_field(whole, "title"), "tags": front_field(whole, "tags"), "front": front_body(whole)})
    body = strip_dead_images(clean_wikilinks(F.col("front")))
    body = strip_sidecar_noise(body, F.col("blocks")) if has_blocks else body
    clean = read.select("lib", "rel", "heavy", "title", "tags", wikilink_targets(F.col("front")).alias("links"), body.alias("body"))
    clean = clean.withColumn("body", strip_boilerplate(strip_page_numbers(F.col("body"))))
    reason = F.when(F.col("heavy"), F.lit("tbd")).when(stripped(F.col("body")) == "", F.lit("empty"))
    clean = clean.withColumn("reason", reason)
    states = clean.select("lib", "rel", "reason", F.when(F.col("reason").isNull(), F.col("links")).alias("links"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["reason"].isna()].drop(columns="reason")  # here, lest the cleaning be done again for a filter
            pdf["piece"] = [list(enumerate(document_pieces(t, b, limit, short))) for t, b in zip(pdf["title"], pdf["body"], strict=True)]
            rows = pdf.drop(columns="body").explode("piece").dropna(subset="piece")
            if len(rows):
                yield rows.assign(chunk=[i for i, _ in rows["piece"]], heading=[h for _, (h, _) in rows["piece"]], body=[b for _, (_, b) in rows["piece"]]).drop(columns="piece")

    carried = ["lib", "rel", "title", "tags", *["links"] * with_links]
    whole = clean.select(*carried, "body", "reason")
    kinds = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in carried)
    each = whole.mapInPandas(cut, f"{kinds}, chunk int, heading string, body string")
    path = F.when(F.col("heading") != "", F.split("heading", " / ")).otherwise(F.array().cast("array<string>"))
    ctx = context(F.concat(F.array(stem(F.col("rel")), F.col("title"), F.col("tags")), path))
    chunks = each.select("lib", "rel", "chunk", "heading", "title", "tags", F.col("heading").alias("hp"), ctx.alias("ctx"), "body", *["links"] * with_links)
    return chunks.withColumn("text", F.when(F.col("ctx") != "", F.concat_ws("\n", "ctx", "body")).otherwise(F.col("body"))), states
