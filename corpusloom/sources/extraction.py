"""Extraction of other formats, its cache and its queue.

What turns a PDF or Word file into text is a pluggable ``Extractor``; routing, caching and the rules
around them are joins and expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..models import Deferred, Extractor

TEXT_PAGE_LEAST = 10
ROUTES = ("ocr:mineru-cloud", "ocr:mineru-local", "mineru-text", "local")


def scanned(pages: Column) -> Column:
    """Whether any page has too little text: the whole book goes to recognition then."""
    return F.exists(pages, lambda p: F.length(stripped(F.coalesce(p, F.lit("")))) < TEXT_PAGE_LEAST)


def classify(is_pdf: Column, cached: Column, pages: Column, scan_backend: str, text_backend: str, key_ready: bool) -> Column:
    """(kind, n_pages, is_ocr, route): cloud, local or inline."""
    n = F.coalesce(F.size(pages), F.lit(0))
    made = lambda kind, ocr, route: F.struct(F.lit(kind).alias("kind"), n.alias("n_pages"), F.lit(ocr).cast("boolean").alias("is_ocr"), F.lit(route).cast("string").alias("route"))
    nothing = F.struct(F.lit("inline").alias("kind"), F.lit(0).alias("n_pages"), F.lit(None).cast("boolean").alias("is_ocr"), F.lit(None).cast("string").alias("route"))
    cloud_scan, local_scan = scan_backend == "mineru-cloud" and key_ready, scan_backend == "mineru-local"
    by_scan = made("cloud", True, "ocr:mineru-cloud") if cloud_scan else made("local", True, "ocr:mineru-local") if local_scan else made("inline", None, None)
    by_text = made("cloud", False, "mineru-text") if text_backend == "mineru-cloud" and key_ready else made("inline", None, None)
    return F.when(~is_pdf | cached | (n <= 0), nothing).when(scanned(pages), by_scan).otherwise(by_text)


def best_cached(cache: DataFrame, routes: tuple[str, ...] = ROUTES) -> DataFrame:
    """cache: hash, route, markdown. For each hash the entry whose route comes first."""
    order = F.array_position(F.array(*map(F.lit, routes)), F.col("route"))
    rank = F.row_number().over(Window.partitionBy("hash").orderBy(order))
    return cache.where(F.col("route").isin(*routes)).withColumn("_n", rank).where("_n = 1").drop("_n")


def missing(files: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """Files whose (hash, route) isn't in the cache in this version."""
    return files.join(cache.where(F.col("version") == version).select("hash", "route").distinct(), ["hash", "route"], "left_anti")


def read_cached(files: DataFrame, cache: DataFrame, routes: tuple[str, ...] = ROUTES) -> DataFrame:
    """Adds markdown and reason (not-cached); never extracts."""
    joined = files.join(best_cached(cache, routes).select("hash", "markdown"), "hash", "left")
    return joined.withColumn("reason", F.when(F.col("markdown").isNull(), F.lit("not-cached")))


def extract(files: DataFrame, extractor: Extractor) -> DataFrame:
    """files: hash, rel, content. (hash, pages, sidecar, deferred): page texts, null where the file can't be
    read; the extractor's blocks as JSON, if it has any. A batch of files at a time; a failure is a row, not
    a failed task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, rel, content in zip(pdf["hash"], pdf["rel"], pdf["content"], strict=True):
                pages, sidecar, deferred = None, None, False
                try:
                    pages = extractor.pages(rel, bytes(content))
                    sidecar = extractor.sidecar(rel, bytes(content)) if pages is not None and hasattr(extractor, "sidecar") else None
                except Deferred:
                    deferred = True
                except Exception:  # noqa: BLE001  whatever a parser raises
                    pages = None
                rows.append((key, pages, sidecar, deferred))
            yield pd.DataFrame(rows, columns=["hash", "pages", "sidecar", "deferred"])

    return files.select("hash", "rel", "content").mapInPandas(run, "hash string, pages array<string>, sidecar string, deferred boolean")


def heading_marks(style: Column) -> Column:
    """Markdown marks of a paragraph style: Title and levels 1 to 3; deeper levels count as 3."""
    name = stripped(style)
    level = F.regexp_extract(name, r"(?i)^(?:Heading|标题)\s*(\d+)$", 1)
    marks = F.when(F.lower(name) == "title", F.lit(1)).when(level != "", F.greatest(F.lit(1), F.least(F.lit(3), F.try_to_number(level, F.lit("999999999")).cast("int"))))
    return F.coalesce(F.repeat(F.lit("#"), marks), F.lit(""))


def response_text(payload: Column) -> Column:
    """The first text that isn't blank in a recognition service's answer, in the shapes it has had."""
    entries = "map<string,struct<md_content:string,md:string>>"
    listed = F.map_values(F.from_json(F.get_json_object(payload, "$.results"), entries))
    first = lambda texts: F.get(F.filter(texts, lambda t: stripped(t) != ""), F.lit(0))
    tries = [F.get_json_object(payload, p) for p in ("$.md_content", "$.md", "$.markdown", "$.results[0].md_content")]
    tries += [first(F.transform(listed, lambda e: e["md_content"])), first(F.transform(listed, lambda e: e["md"]))]
    return F.coalesce(*[F.when(stripped(t) != "", t) for t in tries])


def resume(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs under way for files as they are: equal path and hash."""
    return files.join(jobs, ["path", "hash"])
