"""Language identification by Bayesian fusion of evidence.

The text's likelihood comes from hashed letter trigrams, fitted on a bounded sample of labelled rows
(about ``sample_rows``, those with the smallest hash). It is combined with the language that the markup
declares, the suffix of the address and a prior of the host. Host priors are counts of the text's own
decisions, grouped by host and domain over all rows and smoothed hierarchically: all rows -> domain ->
host. A row's own decision is taken out of its host's counts. A row is rejected if no language of the
list explains it better than the class ``und`` does, a uniform trigram model, or if it has no letters.

Defined results: a null or empty text, or one without letters, is ``und`` and rejected; a null or
unknown declaration, suffix or host is no evidence; repeated rows each count; an empty table gives an
empty result. Without labelled rows every language is as likely as the unknown, so the other evidence
decides. Whole texts are read, a mebibyte at a time, with the same trigrams wherever that cuts them. Of
languages that tie, the first of the list wins, before ``und``. Input columns are kept in a struct, so
their names may clash with those made here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, materialise, table, whole_row

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
SAMPLE_ROWS = 4000
BUCKETS = 1 << 15
SMOOTHING = 0.2  # added to each count of a trigram bucket
TEMPER = 1 / 3  # each letter is in three trigrams
UNKNOWN_PRIOR = 0.02
DECLARED, SUFFIX = 0.9, 0.7  # how often a declaration or an address suffix is right
HOST_STRENGTH = 10.0  # rows that the level above a host or domain counts for
#: Languages of country suffixes.
SUFFIXES = {"de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "uk": "en", "us": "en", "au": "en", "ie": "en"}
#: Bytes that are not part of letters become spaces.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_PIECE = 1 << 20


def trigrams(text: bytes | None) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's letter trigrams, piece by piece: of its words, joined by one space,
    with one before the first and one after the last, wherever the pieces are cut."""
    text, kept = text or b"", b" "
    for i in range(0, len(text), _PIECE):
        part = text[i : i + _PIECE].lower().translate(_LETTERS)
        more = b" ".join(part.split())
        if part[:1] == b" " and kept[-1:] != b" ":
            more = b" " + more
        if part[-1:] == b" " and more and more[-1:] != b" " or i + _PIECE >= len(text) and (kept + more)[-1:] != b" ":
            more += b" "
        b = np.frombuffer(kept + more, np.uint8).astype(np.uint32)
        kept = (kept + more)[-2:]
        if len(b) > 2:
            yield ((b[:-2] * np.uint32(40503) + b[1:-1] * np.uint32(9973) + b[2:] * np.uint32(257)) ^ (b[1:-1] << np.uint32(7))) % np.uint32(BUCKETS)


def sampled(docs: DataFrame, languages=LANGUAGES, sample_rows: int = SAMPLE_ROWS) -> Column:
    """Whether a row of docs is in the sample: labelled rows whose hash falls below the share that makes
    sample_rows of them, on average."""
    labelled = F.col("lang").isin(*languages) & F.col("text").isNotNull()
    share = min(1.0, sample_rows / max(1, docs.where(labelled).count()))
    below = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
    return F.coalesce(labelled & (F.xxhash64(*docs.columns) <= below), F.lit(False))


def fit(docs: DataFrame, languages=LANGUAGES, sample_rows: int = SAMPLE_ROWS, chosen: Column | None = None) -> np.ndarray:
    """Log probabilities, a row for each language, from the sample of docs (text, lang, and a key such as
    doc_id). It is counted where it lies, and the driver gets a number for each language and bucket.
    """
    chosen = sampled(docs, languages, sample_rows) if chosen is None else chosen
    sample = docs.where(chosen).select("lang", F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*batch.columns, strict=True):
                total = sums.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                for t in trigrams(text.as_py()):
                    total += np.bincount(t, minlength=BUCKETS)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used)), "bucket": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = np.full((len(languages), BUCKETS), SMOOTHING)
    for r in counted.toLocalIterator():  # len(languages) * BUCKETS rows at most
        found[languages.index(r["lang"]), r["bucket"]] += r["n"]
    return np.log(found / found.sum(axis=1, keepdims=True)).astype(np.float32)


def likelihoods(model: np.ndarray):
    """A function of a text (binary): the number of trigrams, then a tempered log likelihood for each
    language and for the unknown."""
    by_bucket = np.ascontiguousarray(model.T)
    flat = -math.log(BUCKETS)

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), model.shape[0] + 2))
        for i, text in enumerate(texts):
            for t in trigrams(text.as_py()):
                out[i, 0] += len(t)
                out[i, 1:-1] += TEMPER * by_bucket[t].sum(axis=0, dtype=np.float64)
        out[:, -1] = TEMPER * flat * out[:, 0]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

    return run


def _domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _best(scores: Column, names: Column) -> Column:
    return F.when(F.col("n") > 0, F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))).otherwise(F.lit(UNKNOWN))


def host_counts(marked: DataFrame, languages=LANGUAGES) -> DataFrame:
    """(host, host_n, domain_n, all_n), arrays of counts by language, from marked (host, text_lang)."""
    names = [*languages, UNKNOWN]
    counts = F.array(*[F.count_if(F.col("text_lang") == x).cast("double") for x in names])
    add = lambda c: F.array(*[F.sum(c[i]) for i in range(len(names))])
    by_host = materialise(marked.groupBy("host").agg(counts.alias("host_n")), "langid-hosts")
    by_domain = by_host.groupBy(_domain(F.col("host")).alias("domain")).agg(add(F.col("host_n")).alias("domain_n"))
    everything = by_host.agg(add(F.col("host_n")).alias("all_n")).first()["all_n"]  # a number for each language
    joined = by_host.join(by_domain, _domain(F.col("host")).eqNullSafe(F.col("domain"))).drop("domain")
    return materialise(joined.withColumn("all_n", F.array(*[F.lit(float(x or 0)) for x in everything])), "langid-priors")


def identify(rows: DataFrame, text: str, declared: Column, suffix: Column, host: Column, model: np.ndarray, languages=LANGUAGES, with_text: bool = True) -> DataFrame:
    """For each row: _row (without the text unless with_text), lang, confidence, text_lang, n_trigrams,
    kept. Texts are scored once; the scored rows are written to the shared folder, read there for the
    hosts' counts and again for the result."""
    names, k = F.array(*map(F.lit, [*languages, UNKNOWN])), len(languages) + 1
    base = rows.select(
        whole_row(rows if with_text else rows.drop(text)), F.lower(F.substring(declared, 1, 2)).alias("declared"), suffix.alias("suffix"), host.alias("host"),
        likelihoods(model)(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("found"),
    )
    base = base.withColumns({"n": F.element_at("found", 1), "scores": F.slice("found", 2, k)}).drop("found")
    base = base.withColumn("text_lang", _best(F.col("scores"), names))
    base = materialise(base, "langid-scores")
    priors = host_counts(base.select("host", "text_lang"), languages).withColumnRenamed("host", "of")
    # a host that no row has cannot be missing here: both sides come from the same rows
    joined = base.join(priors, F.col("host").eqNullSafe(F.col("of")))

    own = F.transform(names, lambda x: (x == F.col("text_lang")).cast("double"))
    without = lambda c: F.zip_with(c, F.col("own"), lambda a, b: a - b)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    smooth = lambda c, above: F.zip_with(c, above, lambda a, p: (a + F.lit(HOST_STRENGTH) * p) / (total(c) + F.lit(HOST_STRENGTH)))
    joined = joined.withColumn("own", own)
    flat = F.array_repeat(F.lit(1.0 / k), k)
    joined = joined.withColumn("p", smooth(without(F.col("all_n")), flat))
    joined = joined.withColumn("p", F.when(F.col("host").isNull(), F.col("p")).otherwise(smooth(without(F.col("domain_n")), F.col("p"))))
    joined = joined.withColumn("p", F.when(F.col("host").isNull(), F.col("p")).otherwise(smooth(without(F.col("host_n")), F.col("p"))))

    def evidence(claim: Column, right: float) -> Column:
        known = claim.isin(*languages)
        said = lambda x: F.when(x == F.lit(UNKNOWN), F.lit(1.0 / len(languages))).when(x == claim, F.lit(right)).otherwise(F.lit((1 - right) / (len(languages) - 1)))
        return F.transform(names, lambda x: F.when(known, F.log(said(x))).otherwise(F.lit(0.0)))

    implied = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    prior = F.zip_with("p", names, lambda p, x: F.log(p * F.when(x == F.lit(UNKNOWN), F.lit(UNKNOWN_PRIOR)).otherwise(F.lit(1 - UNKNOWN_PRIOR))))
    parts = [F.col("scores"), prior, evidence(F.col("declared"), DECLARED), evidence(F.element_at(implied, F.coalesce("suffix", F.lit(""))), SUFFIX)]
    fused = parts[0]
    for part in parts[1:]:
        fused = F.zip_with(fused, part, lambda a, b: a + b)
    joined = joined.withColumn("fused", fused).withColumn("top", F.array_max("fused"))
    joined = joined.withColumn("lang", _best(F.col("fused"), names))
    weight = total(F.transform("fused", lambda x: F.exp(x - F.col("top"))))
    return joined.select(
        "_row", "lang", F.when(F.col("n") > 0, F.round(1 / weight, 6)).otherwise(F.lit(1.0)).alias("confidence"),
        "text_lang", F.col("n").cast("long").alias("n_trigrams"), (F.col("lang") != UNKNOWN).alias("kept"),
    )


def identify_documents(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, with_text: bool = True) -> DataFrame:
    """docs: doc_id, text, lang (declared), source (host), and whatever else. The text model has learnt the
    declarations of the sample's rows, so for these they aren't evidence once more."""
    nothing, labelled = F.lit(None).cast("string"), docs.select("doc_id", "text", "lang")
    chosen = sampled(labelled, sample_rows=sample_rows)
    return identify(docs, "text", F.when(~chosen, F.col("lang")), nothing, F.col("source"), fit(labelled, chosen=chosen), with_text=with_text)


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>|&[A-Za-z#0-9]{1,10};", " ")


def identify_pages(pages: DataFrame, model: np.ndarray, by_markup: bool = True) -> DataFrame:
    """pages: page_id, url, html. Declared language: the lang attribute of the root element, evidence
    if by_markup."""
    host = F.lower(F.regexp_extract("url", r"^[^:/?#]+://([^/?#:]*)", 1))
    host = F.when(host == "", F.lit(None)).otherwise(host)
    rows = pages.select(
        "page_id", host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"),
        F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1).alias("declared"), visible_text(F.col("html")).alias("text"),
    )
    return identify(rows, "text", F.col("declared") if by_markup else F.lit(None).cast("string"), F.col("suffix"), F.col("host"), model, with_text=False)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs in a language of the list."""
    return identify_documents(docs).where("kept").select("_row.*")


def op4_langid(spark, sf_dir: str) -> DataFrame:
    """op4: language of every document; source is its host, lang the declared language."""
    found = identify_documents(documents(spark, sf_dir, "doc_id", "text", "lang", "source"), with_text=False)
    return found.select("_row.doc_id", "lang", "confidence", "text_lang", "n_trigrams", "kept")


def langid_pages(spark, sf_dir: str) -> DataFrame:
    """The same over all pages, with markup, suffix and host; the text model comes from documents."""
    model = fit(documents(spark, sf_dir, "doc_id", "text", "lang"))
    found = identify_pages(table(spark, sf_dir, "pages"), model)
    return found.select("_row.page_id", F.col("_row.declared").alias("declared"), "lang", "confidence", "text_lang", "n_trigrams", "kept")
