"""Media columns: telephony audio.

Bytes are stored as WAVE files of 8-bit mu-law or A-law samples or of IMA ADPCM blocks. Decoding expands
mu-law and A-law through 256-entry tables, made from the codecs' rules, and decodes ADPCM with numpy
across blocks: all blocks of a slice of rows advance together, a nibble at a time. PCM is resampled from
8 to 16 kHz by linear interpolation in integers and stored as a column of 16-bit little-endian samples.
Files are decoded piece by piece, so that besides a row's own file and PCM only pieces are in memory.

Defined results: a null payload is the empty one; payloads have any length; equal payloads give equal
files, features and PCM, so rows that tie or repeat are independent of each other; an empty table gives
an empty result. Other columns are kept in a struct, so their names may clash with those made here.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, materialise, whole_row

RATE = 8000
UNIT = 576
PAD = 255
ACROSS = 2048  # ADPCM blocks decoded together
PIECE = 1 << 20  # mu-law or A-law samples decoded at a time
ROWS, SLICE = 256, 1 << 20  # rows of a batch, and bytes of their files, worked on at a time
#: WAVE format tags.
ALAW, MULAW, IMA = 6, 7, 17
#: Sizes of their blocks here.
BLOCKS = {MULAW: 1, ALAW: 1, IMA: UNIT}
#: Index steps of IMA ADPCM, by the three low bits of a nibble.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Step sizes of IMA ADPCM.
STEP_SIZES = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    b = ~np.arange(256) & 255
    size = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return np.where(b & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    b = np.arange(256) ^ 0x55
    high = b >> 4 & 7
    size = np.where(high > 0, ((b & 15) << 4) + 0x108 << np.maximum(high - 1, 0), ((b & 15) << 4) + 8)
    return np.where(b & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """blocks: (n, size) bytes of mono blocks. Returns (n, 1 + 2 * (size - 4)) samples."""
    n, size = blocks.shape
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    nibbles = np.empty((2 * (size - 4), n), np.uint8)
    nibbles[0::2], nibbles[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(nibbles) + 1, n), np.int16)
    out[0] = value
    for i, codes in enumerate(nibbles):
        code = codes.astype(np.int32)
        step = STEP_SIZES[index]
        change = step >> 3
        change += (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[code & 7], 0, 88)
        out[i + 1] = value
    return out.T


def pack(data: bytes, tag: int = MULAW, block: int = 1) -> bytes:
    """A WAVE file around the data. block: bytes of an ADPCM block, else 1."""
    samples = 2 * (block - 4) + 1 if tag == IMA else 1
    extra = struct.pack("<HH", 2, samples) if tag == IMA else struct.pack("<H", 0)
    bits, speed = (4, RATE * block // samples) if tag == IMA else (8, RATE)
    form = struct.pack("<HHIIHH", tag, 1, RATE, speed, block, bits) + extra
    fact = struct.pack("<I", len(data) // block * samples & 0xFFFFFFFF)
    chunks = b"".join([b"fmt ", struct.pack("<I", len(form)), form, b"fact", struct.pack("<I", 4), fact, b"data", struct.pack("<I", len(data)), data, b"\0" * (len(data) & 1)])
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unpack(media: bytes) -> tuple[int, int, bytes]:
    """(format tag, block size, data) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, block = 12, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, block = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
        elif name == b"data":
            return tag, block, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def pieces(files: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the file, PCM) of files (tag, block size, data), piece by piece, each file's in order.
    Blocks of ADPCM files of the same block size are decoded together."""
    for tag in TABLES:
        for k, raw in ((k, np.frombuffer(data, np.uint8)) for k, (t, _, data) in enumerate(files) if t == tag):
            for i in range(0, len(raw), PIECE):
                yield k, TABLES[tag][raw[i : i + PIECE]]
    if unknown := {t for t, _, _ in files} - {*TABLES, IMA}:
        raise ValueError(f"formats {sorted(unknown)} are not telephony audio")
    for size in {block for tag, block, _ in files if tag == IMA}:
        mine = [k for k, (tag, block, _) in enumerate(files) if tag == IMA and block == size]
        of = np.repeat(mine, [len(files[k][2]) // size for k in mine])
        blocks = np.frombuffer(b"".join([files[k][2][: len(files[k][2]) // size * size] for k in mine]), np.uint8).reshape(-1, size)
        for i in range(0, len(blocks), ACROSS):
            pcm, owners = decode_ima(blocks[i : i + ACROSS]), of[i : i + ACROSS]
            cuts = np.flatnonzero(np.diff(owners)) + 1
            for k, rows in zip(owners[np.append(0, cuts)], np.split(pcm, cuts), strict=True):
                yield int(k), rows.ravel()


def decode(tag: int, block: int, data: bytes) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int16), *(pcm for _, pcm in pieces([(tag, block, data)]))])


class Track:
    """A file's PCM, resampled from 8 to 16 kHz as it comes (between two samples their mean, rounded down;
    the last sample twice), and its features: samples, root mean square, peak, zero crossings and the
    checksum of the resampled PCM."""

    def __init__(self):
        self.stored, self.last = bytearray(), np.zeros(0, np.int16)
        self.n = self.energy = self.peak = self.crossings = 0

    def add(self, pcm: np.ndarray) -> None:
        wide = pcm.astype(np.int64)
        self.n += len(pcm)
        self.energy += int(np.dot(wide, wide))
        self.peak = max(self.peak, int(np.abs(wide).max(initial=0)))
        joined = np.concatenate([self.last, pcm])
        self.crossings += int(np.count_nonzero((joined[1:] < 0) != (joined[:-1] < 0)))
        self.last = joined[-1:]
        if len(joined) > 1:
            out = np.empty(2 * len(joined) - 2, "<i2")
            out[0::2], out[1::2] = joined[:-1], (joined[:-1].astype(np.int32) + joined[1:]) >> 1
            self.stored += out.tobytes()

    def finish(self) -> bytes:
        self.stored += np.repeat(self.last, 2).astype("<i2").tobytes()
        return bytes(self.stored)

    def feature(self, tag: int, stored: bytes) -> str:
        return f"tag={tag};n={self.n};rms={math.isqrt(self.energy // max(1, self.n))};peak={self.peak};zc={self.crossings};pcm16k_crc={zlib.crc32(stored)}"


def resample(pcm: np.ndarray) -> np.ndarray:
    track = Track()
    track.add(pcm)
    return np.frombuffer(track.finish(), "<i2")


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes([PAD]) * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def codec_of(data: bytes) -> int:
    """One of the three, by the data's checksum."""
    return (MULAW, ALAW, IMA)[zlib.crc32(data) % 3]


def sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of up to ROWS rows, that end where the bytes of the column exceed SLICE."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < batch.num_rows:
            stop = int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SLICE, side="right")) + 1
            stop = min(stop, i + ROWS, batch.num_rows)
            yield batch.slice(i, stop - i)
            i = stop


def _beside(rows: DataFrame, column: str) -> DataFrame:
    rest = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != column])
    return rows.select(whole_row(rest), F.col(f"`{column}`").cast("binary").alias("data"))


def store_media(rows: DataFrame, data: str, tag: int | None = None) -> DataFrame:
    """_row (the other columns), n_bytes and media: a WAVE file around the padded bytes of column data, in
    the codec of the tag, else in the one that codec_of picks. Written to the shared folder."""
    packed = _beside(rows, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            n, media = [], []
            for x in batch.column(1):
                raw = x.as_py() or b""
                n.append(len(raw))
                kind = codec_of(raw) if tag is None else tag
                media.append(pack(payload(raw), kind, BLOCKS[kind]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["_row", "n_bytes", "media"])

    return materialise(packed.mapInArrow(run, f"_row {packed.schema['_row'].dataType.simpleString()}, n_bytes long, media binary"), "media")


def decode_media(stored: DataFrame, media: str = "media") -> DataFrame:
    """Reads media back: _row (the other columns), payload digests, feature and pcm (16 kHz, 16 bits)."""
    files = _beside(stored, media)
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "pcm": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found: dict[str, list] = {k: [] for k in kinds}
            raw = [x or pack(b"") for x in batch.column(1).to_pylist()]
            opened = [unpack(x) for x in raw]
            tracks = [Track() for _ in opened]
            for k, pcm in pieces(opened):
                tracks[k].add(pcm)
            for whole, (tag, _, data), track in zip(raw, opened, tracks, strict=True):
                pcm = track.finish()
                values = len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(whole), hashlib.sha256(whole).hexdigest(), track.feature(tag, pcm), pcm
                for k, v in zip(kinds, values, strict=True):
                    found[k].append(v)
            yield pa.RecordBatch.from_pydict({"_row": batch.column(0)} | {k: pa.array(found[k], t) for k, t in kinds.items()})

    return files.mapInArrow(run, f"_row {files.schema['_row'].dataType.simpleString()}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary")


def op8_media(spark, sf_dir: str) -> DataFrame:
    """op8: digests, features and resampled PCM of every document, stored as mu-law, A-law or ADPCM."""
    found = decode_media(store_media(documents(spark, sf_dir, "doc_id", "text"), "text"))
    return found.select("_row._row.doc_id", "_row.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm")
