"""Substring dedup with a count-min prefilter: repeated windows of words are removed, the rest stays.

Documents are dealt to chunks of some ``CHUNK`` bytes. Each chunk counts its windows in a count-min sketch
of ``DEPTH`` rows (a count stops at two, more is never asked for) and sends the cells that it touched to
the tasks that own them, ranges of the sketch; what a chunk holds often is sent once. Owners merge the
partial sketches and answer each chunk with a bit for each of its cells: counted twice or more, or not.
A window whose cells are all counted twice is estimated repeated. Estimates never fall below the true
count, so no repeated window is lost; the second pass groups only the windows estimated repeated, by 128
bits of their words, again in owner tasks that answer with bits. A chunk then removes the words that
repeated windows cover.

The sketch has about ``ROOM`` cells a window in each row, so one window in a hundred is estimated wrongly
at any size. It is never sent to anyone whole. Texts move once; all that asks for them reads that
shuffle. Cells travel sorted, as compressed differences, some three bytes a window. With very many
chunks and owners a message holds few cells, and what is sent nears the size of the windows' hashes.

Defined results: a null or empty text has no words and none removed; texts of fewer than ``window`` words
stay. White space between kept words becomes one space. Windows are judged on the input: all copies of a
passage go, also the first, and overlapping copies within a document too. A repeated row is a document of
its own, so its windows are repeated. Texts of any length are read whole, with some hundred bytes of memory
a word. An empty table gives an empty result. Other columns are kept in a struct, whatever their names.
Docs must give the same rows to the same partitions if read again, as a stored table does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_128_digest

from .shared import documents, nullable, whole_row

WINDOW = 35
DEPTH = 2
ROOM = 4  # cells of a sketch row for each window
BYTES_A_WORD = 6  # sets the width of the sketch and nothing else
CHUNK = 4 << 20  # bytes of text
OWNED = 22  # an owner holds 2^22 cells at most

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SLICE = 1 << 20
_BASES = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)  # odd


class Layout(NamedTuple):
    """Widths as powers of two: cells in a row of the sketch, owners of a row, words in a window."""

    cells: int
    owners: int
    window: int


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a mebibyte at a time."""
    start = 0
    while start < len(text):
        gap = _SPACE.search(text, start + _SLICE)
        end = gap.start() if gap else len(text)
        yield text[start:end].split()
        start = end


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """(n - window + 1, 2): for each start the polynomial of its words' hashes, in two bases."""
    n = len(words)
    found = np.empty((max(0, n - window + 1), 2), np.uint64)
    for lane, base in enumerate(_BASES):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words[:, lane] * _powers(base, n), out=sums[1:])
        found[:, lane] = (sums[window:] - sums[: n + 1 - window])[: len(found)] * _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(found))
    return found


def _mixed(h: np.ndarray, row: int) -> np.ndarray:
    """Independent hashes by the finalizer of SplitMix64."""
    z = h + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


class Chunk:
    """The windows of a chunk's documents, none across two of them."""

    def __init__(self, texts: list[bytes | None], layout: Layout):
        digests, self.lengths = [], []
        for text in texts:
            n = 0
            for words in slices(text or b""):
                digests.append(b"".join(map(xxh3_128_digest, words)))
                n += len(words)
            self.lengths.append(n)
        words = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
        del digests
        ends = np.repeat(np.cumsum(self.lengths, dtype=np.int64), self.lengths)
        self.layout, self.n_words = layout, len(words)
        self.starts = np.flatnonzero(np.arange(len(words)) + layout.window <= ends)
        self.windows = window_hashes(words, layout.window)[self.starts]

    def cells(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct cells, sorted; for each window the number of its cell; whether cells are counted twice here."""
        cells = _mixed(self.windows[:, 0], row) >> np.uint64(64 - self.layout.cells)
        distinct, number, counts = np.unique(cells, return_inverse=True, return_counts=True)
        return distinct, number, counts > 1

    def estimated(self, answers: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Whether each window is estimated repeated. answers: bits by row of the sketch, in order of owners."""
        hot = np.ones(len(self.windows), bool)
        for row in range(DEPTH):
            if len(hot):
                hot &= np.concatenate(answers[row])[self.cells(row)[1]]
        return hot

    def candidates(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows among the hot ones, sorted; the number of each hot one; whether they are here twice."""
        return distinct_pairs(self.windows[hot])


def distinct_pairs(pairs: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    ordered = pairs[order]
    first = np.ones(len(pairs), bool)
    first[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    number = np.empty(len(pairs), np.int64)
    number[order] = np.cumsum(first) - 1
    return ordered[first], number, np.bincount(number, weights, minlength=int(first.sum())) > 1


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 as compressed differences, byte by byte of their places."""
    return pa.compress(np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpack_sorted(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def by_owner(keys: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    """Ranges of sorted keys that go to one owner, the key's bits above shift."""
    owners = keys >> np.uint64(shift)
    edges = [0, *(np.flatnonzero(owners[1:] != owners[:-1]) + 1), len(owners)] if len(owners) else []
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(owners[a]), slice(a, b)


ASKED = pa.schema([("owner", pa.int64()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("twice", pa.binary())])
ANSWERED = pa.schema([("chunk", pa.int64()), ("stage", pa.int32()), ("owner", pa.int64()), ("n", pa.int32()), ("bits", pa.binary())])
_ASKED = "owner long, chunk long, n int, keys binary, twice binary"
_ANSWERED = "chunk long, stage int, owner long, n int, bits binary"


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(column, kind.type) for column, kind in zip(zip(*rows), schema)] if rows else [[]] * len(schema), schema)


def _texts(rows: pa.Table) -> list[bytes | None]:
    return rows.column("text").cast(pa.binary()).to_pylist()


def _answers(rows: pa.Table, stage: int, layout: Layout) -> dict[int, list[np.ndarray]]:
    """Bits by row of the sketch (0 for the second pass), in order of owners."""
    found = sorted((r["owner"], r["n"], r["bits"]) for r in rows.to_pylist() if r["stage"] == stage)
    by_row: dict[int, list[np.ndarray]] = {}
    for owner, n, bits in found:
        by_row.setdefault(owner >> layout.owners if stage == 0 else 0, []).append(_bits(bits, n))
    return by_row


def sketch_messages(layout: Layout):
    def run(rows: pa.Table) -> pa.Table:
        chunk, asked = Chunk(_texts(rows), layout), []
        for row in range(DEPTH):
            cells, _, twice = chunk.cells(row)
            for owner, part in by_owner(cells, layout.cells - layout.owners):
                asked.append((owner | row << layout.owners, rows.column("chunk")[0].as_py(), part.stop - part.start, pack_sorted(cells[part]), np.packbits(twice[part]).tobytes()))
        return _table(asked, ASKED)

    return run


def merge_sketches(layout: Layout):
    """The cells of an owner, merged over all chunks; a bit for each cell that a chunk has sent."""

    def run(rows: pa.Table) -> pa.Table:
        counts = np.zeros(1 << layout.cells - layout.owners, np.uint8)
        sent = [(r["chunk"], r["owner"], r["n"], (unpack_sorted(r["keys"], r["n"]) & np.uint64(len(counts) - 1)).astype(np.uint32), r["twice"]) for r in rows.to_pylist()]
        for _, _, n, cells, twice in sent:
            counts[cells] = np.minimum(2, counts[cells] + 1 + _bits(twice, n))
        return _table([(chunk, 0, owner, n, np.packbits(counts[cells] > 1).tobytes()) for chunk, owner, n, cells, _ in sent], ANSWERED)

    return run


def candidate_messages(layout: Layout):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([], ASKED)
        chunk, asked = Chunk(_texts(rows), layout), []
        keys, _, twice = chunk.candidates(chunk.estimated(_answers(answers, 0, layout)))
        for owner, part in by_owner(keys[:, 0], 64 - layout.owners):
            asked.append((owner, rows.column("chunk")[0].as_py(), part.stop - part.start, keys[part].tobytes(), np.packbits(twice[part]).tobytes()))
        return _table(asked, ASKED)

    return run


def group_windows(rows: pa.Table) -> pa.Table:
    """The windows of an owner, grouped exactly; a bit for each window that a chunk has sent."""
    sent = rows.to_pylist()
    pairs = np.concatenate([np.frombuffer(r["keys"], np.uint64).reshape(-1, 2) for r in sent])
    weights = np.concatenate([1 + _bits(r["twice"], r["n"]) for r in sent])
    _, number, repeated = distinct_pairs(pairs, weights)
    parts = np.split(repeated[number], np.cumsum([r["n"] for r in sent])[:-1])
    return _table([(r["chunk"], 1, r["owner"], r["n"], np.packbits(p).tobytes()) for r, p in zip(sent, parts)], ANSWERED)


def remover(layout: Layout):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _texts(rows)
        chunk = Chunk(texts, layout)
        hot = chunk.estimated(_answers(answers, 0, layout)) if rows.num_rows else np.zeros(0, bool)
        removed = np.zeros(chunk.n_words, bool)
        if hot.any():
            repeated = np.concatenate(_answers(answers, 1, layout)[0])[chunk.candidates(hot)[1]]
            starts = chunk.starts[hot][repeated]
            edges = np.zeros(chunk.n_words + 1, np.int32)
            edges[starts] += 1
            edges[starts + layout.window] -= 1
            removed = np.cumsum(edges)[:-1] > 0
        kept, gone, at = [], [], 0
        for text, n in zip(texts, chunk.lengths):
            out = removed[at : at + n]
            kept.append(b" ".join(w for w in _kept_words(text or b"", out)))
            gone.append(int(out.sum()))
            at += n
        columns = [rows.column("_row"), pa.array(chunk.lengths, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table(columns, ["_row", "n_words", "n_removed", "kept"])

    return run


def _kept_words(text: bytes, removed: np.ndarray) -> Iterator[bytes]:
    at = 0
    for words in slices(text):
        for word, out in zip(words, removed[at : at + len(words)].tolist()):
            if not out:
                yield word
        at += len(words)


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK, room: int = ROOM) -> DataFrame:
    """A row for each row of docs (text and whatever else): _row (the other columns), n_words, n_removed
    and kept, the text without the words that repeated windows cover."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    cells = max(10, (room * size // BYTES_A_WORD).bit_length())
    layout = Layout(cells, max(0, min(cells, max(cells - OWNED, (parts - 1).bit_length()))), window)
    rest = docs.drop("text")
    kind = nullable(rest.select(whole_row(rest)).schema["_row"].dataType)
    # the partition parts rows that are equal in all
    dealt = docs.select(whole_row(rest).cast(kind).alias("_row"), "text").withColumn("chunk", F.pmod(F.xxhash64("_row", "text", F.spark_partition_id()), F.lit(max(parts, -(-size // chunk_bytes)))))
    asked = dealt.groupBy("chunk").applyInArrow(sketch_messages(layout), _ASKED)
    estimates = asked.groupBy("owner").applyInArrow(merge_sketches(layout), _ANSWERED)
    asked = dealt.groupBy("chunk").cogroup(estimates.groupBy("chunk")).applyInArrow(candidate_messages(layout), _ASKED)
    groups = asked.groupBy("owner").applyInArrow(group_windows, _ANSWERED)
    answers = estimates.unionByName(groups)
    result = StructType().add("_row", kind).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(remover(layout), result)


def op11_substrings(spark, sf_dir: str) -> DataFrame:
    """op11: words of each document, removed words, and what is kept."""
    found = remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("_row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
h AS (SELECT r, j, word, md5(string_agg(word, ' ') OVER x) AS h, count(*) OVER x AS n FROM p WINDOW x AS (PARTITION BY r ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
g AS (SELECT r, j, word, n = {WINDOW} AND count(*) OVER (PARTITION BY h) > 1 AS again FROM h),
c AS (SELECT r, j, word, bool_or(again) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM g),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
