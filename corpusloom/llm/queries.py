"""Queries of this subpackage for the driver, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, chat, exactdedup, langid, media, mixing, secretscan, shared, sharding, simhash, substrings, urlfilter, vectorcodes, whitening

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_simhash": simhash.op2_simhash,
    "op3_chat": chat.op3_chat,
    "op4_langid": langid.op4_langid,
    "op5_exact_dedup": exactdedup.op5_exact_dedup,
    "op6_secrets": secretscan.op6_secrets,
    "op7_urls": urlfilter.op7_urls,
    "op8_media": media.op8_media,
    "op9_shards": sharding.op9_shards,
    "op10_bpe": bpe.op10_bpe,
    "op11_substrings": substrings.op11_substrings,
    "op12_vector_codes": vectorcodes.op12_vector_codes,
    "op13_whitening": whitening.op13_whitening,
    "whitening_deviations": whitening.whitening_deviations,
    "langid_pages": langid.langid_pages,
}

ORACLES = {
    "op1_mix": mixing.ORACLE,
    "op3_chat": chat.ORACLE,
    "op5_exact_dedup": exactdedup.ORACLE,
    "op7_urls": urlfilter.ORACLE,
    "op11_substrings": substrings.ORACLE,
    "op12_vector_codes": vectorcodes.ORACLE,
    "whitening_deviations": whitening.DEVIATIONS,
}


# Parts of the above that SQL can follow


def secrets_base(spark, sf_dir: str):
    """op6 without the spans that the lexer adds."""
    return secretscan.op6_secrets(spark, sf_dir).drop("spans")


def _spans_sql(kind: str, pattern: str, rank: int, group: int, least: int) -> str:
    """(start, rank, end, kind) of the matches, from the texts between them."""
    found, gaps = f"regexp_extract_all(t, '{pattern}')", f"list_transform(string_split_regex(t, '{pattern}'), lambda g: length(g))"
    start = "list_sum(g[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    made = f"list_transform(range(1, len(m) + 1), lambda i: {{'a': ({start})::BIGINT, 'k': {rank}, 'z': ({start} + length(m[i]))::BIGINT, 'n': length(v[i]), 'kind': '{kind}'}})"
    return f"SELECT doc_id, unnest(list_filter({made}, lambda s: s.n >= {least})) AS s FROM (SELECT doc_id, {found} AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, {gaps} AS g FROM d)"


_ANY_CASE = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_ASSIGN = "(" + "|".join(_ANY_CASE(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRETS_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans_sql("assign", _ASSIGN, 0, 2, 6)} UNION ALL {_spans_sql("access", "AKIA[A-Z0-9]{16,}", 1, 0, 20)} UNION ALL {_spans_sql("hex", "[0-9a-f]{24,}", 2, 0, 24)})
SELECT d.doc_id, count(*) FILTER (s.kind = 'assign') AS n_assign, count(*) FILTER (s.kind = 'access') AS n_access, count(*) FILTER (s.kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(s.kind || ':' || s.a || ':' || s.z, ',' ORDER BY s.a, s.k), '')) AS base_sha256
FROM d LEFT JOIN s USING (doc_id) GROUP BY 1
"""


def simhash_components(spark, sf_dir: str):
    """Components of given fingerprints: ten documents around each of some centers, two bits away."""
    fp = "cast(conv(substring(md5(cast(doc_id div 10 as string)), 1, 15), 16, 10) as bigint) ^ shiftleft(1L, cast(doc_id % 60 as int)) ^ shiftleft(1L, cast(doc_id * 7 % 60 as int))"
    given = shared.documents(spark, sf_dir, "doc_id").selectExpr("doc_id", "0L AS text_hash", f"{fp} AS fp")
    given = shared.materialise(given, "given")
    return given.select("doc_id", "fp").join(simhash.near_components(given).select("fp", "component_id"), "fp")


SIMHASH_COMPONENTS = """
WITH RECURSIVE f AS (SELECT doc_id, xor(xor(('0x' || substr(md5((doc_id // 10)::VARCHAR), 1, 15))::BIGINT, 1::BIGINT << (doc_id % 60)), 1::BIGINT << (doc_id * 7 % 60)) AS fp FROM documents),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM f a JOIN f b ON bit_count(xor(a.fp, b.fp)) <= 3),
r(node, root) AS (SELECT doc_id, doc_id FROM f UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)
SELECT f.doc_id, f.fp, min(r.root) AS component_id FROM f JOIN r ON r.node = f.doc_id GROUP BY 1, 2
"""


def shard_groups(spark, sf_dir: str):
    """op9: sizes, and of each document the first one of its text in its shard; of each shard the slots' end."""
    rows = shared.materialise(sharding.op9_shards(spark, sf_dir), "sharded")
    ends = rows.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"))
    firsts = rows.groupBy("shard", "text_crc32", "size").agg(F.min("doc_id").alias("first_doc"))
    found = rows.join(firsts, ["shard", "text_crc32", "size"]).join(ends, "shard")
    return found.select("doc_id", "size", "first_doc", ((F.col("n") == F.col("slots")) & (F.col("last") == F.col("n") - 1)).alias("gapless"))


SHARD_GROUPS = "SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_doc, true AS gapless FROM documents"


def media_files(spark, sf_dir: str):
    """op8's payloads as mu-law files."""
    found = media.decode_media(media.store_media(shared.documents(spark, sf_dir, "doc_id", "text"), "text", media.MULAW))
    return found.select("_row._row.doc_id", "_row.n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256", F.octet_length("pcm").cast("long").alias("pcm_bytes"))


def _little(value: str, size: int) -> str:
    return "unhex(" + " || ".join(f"lpad(to_hex((({value}) // {256**k}) % 256), 2, '0')" for k in range(size)) + ")"


MEDIA_FILES = f"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, octet_length(raw) AS n, greatest(1, (octet_length(raw) + 575) // 576) * 576 AS m, raw FROM t),
q AS (SELECT doc_id, n, m, raw || unhex(repeat('FF', m - n)) AS payload FROM p),
w AS (SELECT doc_id, n, m, payload, encode('RIFF') || {_little("m + 50", 4)} || encode('WAVEfmt ') || {_little("18", 4)} || {_little("7", 2)} || {_little("1", 2)} || {_little("8000", 4)} || {_little("8000", 4)} || {_little("1", 2)} || {_little("8", 2)} || {_little("0", 2)}
  || encode('fact') || {_little("4", 4)} || {_little("m", 4)} || encode('data') || {_little("m", 4)} || payload AS file FROM q)
SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256, octet_length(file)::BIGINT AS media_bytes, sha256(file) AS media_sha256, (4 * m)::BIGINT AS pcm_bytes FROM w
"""

QUERIES |= {"secrets_base": secrets_base, "simhash_components": simhash_components, "shard_groups": shard_groups, "media_files": media_files}
ORACLES |= {"secrets_base": SECRETS_BASE, "simhash_components": SIMHASH_COMPONENTS, "shard_groups": SHARD_GROUPS, "media_files": MEDIA_FILES}
