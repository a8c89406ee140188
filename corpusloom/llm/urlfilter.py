"""URL filters: a blocked Bloom filter, then an exact hash join.

The list holds canonical URLs. An entry that ends in ``/`` also covers everything below it and, if it
names a host alone, all subdomains; so a page is looked up by its canonical URL and by the parents of
its host and path. Canonical: user, port and final dot go from the host; in the path, escapes of plain
letters are undone, other escapes are upper-cased, empty and ``.`` segments are dropped, and ``..`` takes
the segment before it along. Listed keys go to blocks of 512 bits, built by grouped bit_or; a block is
picked by one part of the hash and eight bits in it by the rest. The filter has at most ``MAX_BLOCKS``
blocks (64 MiB), whatever the list's length, and is all that is broadcast. Each url is judged by it
once; the answer is written with the page. Pages whose keys may be listed go on to an exact join with the
list, which removes false positives; the others never shuffle.

A rule table decides first: the longest rule (host and path together) whose host and path fit wins; of
rules of the same length the first of the table.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is
allowed; urls may be of any length (parents longer than the longest entry aren't looked up, as none can
be listed); repeated rows stay repeated; an empty list blocks nothing; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .shared import materialise, table

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The production list is made from these: hosts that advertise, spam or sell bets and pills, with their
#: numbered mirrors, under each domain; sections and withdrawn pages of sites that are else in order.
FAMILIES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
DOMAINS = ("example.com", "example.net", "example.org")
MIRRORS = 99
SITES = ("tionble.example.org", "ththan.example.com", "m.ththes.example.org")
SECTION, WITHDRAWN = "/es/", "/en/"
PAGES = 999  # tens
KEYS_A_BLOCK = 32  # 16 bits a key
MAX_BLOCKS = 1 << 20
BITS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (verdict, rule), or null."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        made = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def canonical(host: Column, path: Column) -> Column:
    """The canonical URL, without scheme, query and fragment; the empty path is /."""
    plain = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")

    def unescaped(part: Column, i: Column) -> Column:
        code = F.upper(F.substring(part, 1, 2))
        letter = F.char(F.conv(code, 16, 10).cast("int"))
        known = F.when(letter.rlike("[A-Za-z0-9._~-]"), F.concat(letter, F.substring(part, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), code, F.substring(part, 3, 1 << 30)))
        return F.when(i == 0, part).when(code.rlike("^[0-9A-F]{2}$"), known).otherwise(F.concat(F.lit("%"), part))

    clear = F.when(F.contains(path, F.lit("%")), F.array_join(F.transform(F.split(path, "%"), unescaped), "")).otherwise(path)
    walk = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))

    def folded(p: Column) -> Column:
        kept = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), walk)
        below = F.when(p.rlike(r"/\.{0,2}$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.lit("/"), F.array_join(kept, "/"), below)

    return let(clear, lambda p: F.concat(plain, F.when(p == "", F.lit("/")).when(p.rlike(r"/\.{0,2}/|/\.{1,2}$"), folded(p)).otherwise(p)))


def lookup_keys(canon: Column, longest: int) -> Column:
    """The canonical URL, its host's parents (as host/) and its path's parents (ending in /); of the
    parents those that are no longer than the longest entry."""

    def keys(canon: Column, host: Column) -> Column:
        labels, parts = F.split(F.right(host, F.lit(longest)), r"\."), F.split(F.substr(canon, F.length(host) + 1, F.lit(longest)), "/")
        hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
        paths = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
        short = F.filter(F.concat(hosts, paths), lambda k: F.length(k) <= longest)
        return F.when(host != "", F.array_distinct(F.concat(F.array(canon), short))).otherwise(F.array().cast("array<string>"))

    return let(canon, lambda c: let(F.substring_index(c, "/", 1), lambda h: keys(c, h)))


def build_filter(listed: DataFrame) -> np.ndarray:
    """listed: key, distinct. The blocks, as rows of eight 64-bit words."""
    n = listed.count()
    blocks = 1
    while blocks < min(MAX_BLOCKS, n / KEYS_A_BLOCK):
        blocks *= 2
    h, g = F.xxhash64("key"), F.xxhash64("key", F.lit(1))
    word = lambda w: F.expr("0L" + "".join(f" | if((g >> {9 * i + 6} & 7) = {w}, shiftleft(1L, cast(g >> {9 * i} & 63 as int)), 0L)" for i in range(7)) + f" | if((h >> 62 & 3) * 2 + (h >> 61 & 1) = {w}, shiftleft(1L, cast(h >> 55 & 63 as int)), 0L)")
    keys = listed.select(h.alias("h"), g.alias("g"))
    made = keys.select(F.expr(f"cast(h & {blocks - 1} as int)").alias("block"), *[word(w).alias(f"w{w}") for w in range(8)])
    made = made.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(8)])
    out = np.zeros((blocks, 8), np.int64)
    for r in made.toLocalIterator():  # MAX_BLOCKS rows at most
        out[r["block"]] = r[1:]
    return out


def maybe_listed(bits: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which of the keys with these two hashes may be in the filter."""
    block = bits[h & (len(bits) - 1)]
    rows, one = np.arange(len(h)), np.int64(1)
    sure = np.ones(len(h), bool)
    for i in range(BITS - 1):
        word, bit = g >> np.int64(9 * i + 6) & 7, g >> np.int64(9 * i) & 63
        sure &= (block[rows, word] >> bit & one).astype(bool)
    word, bit = (h >> np.int64(62) & 3) * 2 + (h >> np.int64(61) & 1), h >> np.int64(55) & 63
    return sure & (block[rows, word] >> bit & one).astype(bool)


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """pages: page_id, url. listed: key, canonical URLs. Returns page_id, url, host, path, rule, verdict, listed."""
    listed = listed.select("key").where("key IS NOT NULL").distinct()
    longest = listed.agg(F.max(F.length("key")).alias("n")).first()["n"] or 0
    shared = pages.sparkSession.sparkContext.broadcast(build_filter(listed))

    @F.arrow_udf("boolean")
    def may(hashes: pa.Array, others: pa.Array) -> pa.Array:
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (hashes, others)]
        hits = np.concatenate([[0], np.cumsum(maybe_listed(shared.value, *flat))])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(hashes).to_numpy(zero_copy_only=False))])
        return pa.array(np.diff(hits[ends]) > 0)

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    keys = lookup_keys(canonical(F.col("host"), F.col("path")), longest)
    judged = rows.withColumn("keys", keys).withColumn("possible", may(*[F.transform("keys", h) for h in (lambda k: F.xxhash64(k), lambda k: F.xxhash64(k, F.lit(1)))]))
    rows = materialise(judged.drop("keys"), "urls-judged")
    hits = rows.where("possible").select("host", "path").distinct().select("host", "path", F.explode(keys).alias("key"))
    hits = hits.join(listed, "key", "left_semi").select(F.col("host").alias("of_host"), F.col("path").alias("of_path")).distinct()
    found = rows.where("possible").join(hits, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
    checked = found.withColumn("listed", F.col("of_host").isNotNull()).drop("of_host", "of_path")
    every = rows.where("NOT possible").withColumn("listed", F.lit(False)).unionByName(checked)
    every = every.withColumn("decided", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("decided.verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return every.select("page_id", "url", "host", "path", F.col("decided.rule").alias("rule"), verdict.alias("verdict"), "listed")


def production_list(spark) -> DataFrame:
    """About 7800 canonical URLs."""
    strings = lambda xs: F.array(*map(F.lit, xs))
    numbers = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.lit(MIRRORS)), lambda n: n.cast("string")))
    hosts = spark.range(1).select(F.explode(strings(FAMILIES)).alias("family")).select("family", F.explode(strings(DOMAINS)).alias("domain")).select("family", "domain", F.explode(numbers).alias("n"))
    sites = spark.range(1).select(F.explode(strings(SITES)).alias("site"))
    withdrawn = sites.select("site", F.explode(F.sequence(F.lit(1), F.lit(PAGES))).alias("n")).select("site", "n", F.explode(strings(("", ".html"))).alias("end"))
    return (
        hosts.select(F.concat("family", "n", F.lit("."), "domain", F.lit("/")).alias("key"))
        .unionByName(sites.select(F.concat("site", F.lit(SECTION)).alias("key")))
        .unionByName(withdrawn.select(F.concat("site", F.lit(WITHDRAWN), (F.col("n") * 10).cast("string"), "end").alias("key")))
    )


def op7_urls(spark, sf_dir: str) -> DataFrame:
    """op7: the verdict on every page."""
    found = filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), production_list(spark))
    return found.select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    case = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    verdict = "".join(f" WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in RULES)
    family = rf"(^|\.)({'|'.join(FAMILIES)})([1-9][0-9]?)?\.({'|'.join(d.replace('.', chr(92) + '.') for d in DOMAINS)})$"
    listed = f"regexp_matches(bare, '{family}') OR bare IN {SITES} AND (starts_with(path, '{SECTION}') OR regexp_full_match(path, '{WITHDRAWN}[1-9][0-9]{{0,2}}0(\\.html)?'))"
    return f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r AS (
  SELECT *, CASE{case} END AS rule, regexp_replace(host, '\\.?(:[0-9]*)?$', '') AS bare FROM u
)
SELECT page_id, host, path, rule, CASE{verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


ORACLE = _oracle()
