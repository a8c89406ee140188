"""Telephony audio: tables against the codecs' formulas, ADPCM against a sample-by-sample decoder, and the round trip."""

import hashlib
import math
import random
import zlib

import numpy as np

from corpusloom.llm import media


def slow_mulaw(b):
    b = ~b & 255
    size = ((((b & 15) << 3) + 132) << ((b >> 4) & 7)) - 132
    return -size if b & 128 else size


def slow_alaw(b):
    b ^= 0x55
    exponent, mantissa = (b >> 4) & 7, b & 15
    size = (mantissa << 4) + 8 if exponent == 0 else ((mantissa << 4) + 0x108) << (exponent - 1)
    return size if b & 128 else -size


def slow_ima(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEP_SIZES[index])
            change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(media.INDEX_STEPS[code & 7])))
            out.append(value)
    return out


def test_tables():
    assert media.TABLES[media.MULAW].tolist() == [slow_mulaw(b) for b in range(256)]
    assert media.TABLES[media.ALAW].tolist() == [slow_alaw(b) for b in range(256)]
    assert media.TABLES[media.MULAW][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]


def test_adpcm():
    rng = random.Random(3)
    blocks = [bytes(rng.randrange(256) for _ in range(40)) for _ in range(30)]
    got = media.decode_ima(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 40))
    assert got.tolist() == [slow_ima(b) for b in blocks]


def test_round_trip():
    for data in (b"", b"x", b"y" * 575, b"z" * 576, b"w" * 577, bytes(range(256)) * 9):
        padded = media.payload(data)
        assert len(padded) % 576 == 0 and padded.startswith(data) and set(padded[len(data) :]) <= {255} and padded
        for tag, block in ((media.MULAW, 1), (media.ALAW, 1), (media.IMA, 576)):
            assert media.unpack(media.pack(padded, tag, block)) == (tag, block, padded)


def test_resample():
    assert media.resample(np.array([0, 10, -3], np.int16)).tolist() == [0, 5, 10, 3, -3, -3]
    assert media.resample(np.array([], np.int16)).tolist() == []


def test_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in media.op8_media(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        raw = (r.text or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        tag = (media.MULAW, media.ALAW, media.IMA)[zlib.crc32(raw) % 3]
        if tag == media.IMA:
            samples = [x for i in range(0, len(padded), 576) for x in slow_ima(padded[i : i + 576])] if len(padded) < 20_000 else None
        else:
            samples = [(slow_mulaw if tag == media.MULAW else slow_alaw)(b) for b in padded]
        if samples:
            later = [*samples[1:], samples[-1]]
            pcm = np.array([x for a, b in zip(samples, later, strict=True) for x in (a, (a + b) >> 1)], "<i2").tobytes()
            rms = math.isqrt(sum(x * x for x in samples) // len(samples))
            zc = sum((a < 0) != (b < 0) for a, b in zip(samples, later, strict=True))
            assert g.pcm == pcm
            assert g.feature == f"tag={tag};n={len(samples)};rms={rms};peak={max(map(abs, samples))};zc={zc};pcm16k_crc={zlib.crc32(pcm)}"
        whole = media.pack(padded, tag, media.BLOCKS[tag])
        assert (g.media_bytes, g.media_sha256) == (len(whole), hashlib.sha256(whole).hexdigest())


def test_pieces_do_not_matter(monkeypatch):
    rng = random.Random(9)
    files = [(tag, block, bytes(rng.randrange(256) for _ in range(n * 40))) for tag, block, n in ((media.MULAW, 1, 5), (media.IMA, 40, 7), (media.IMA, 20, 3), (media.ALAW, 1, 0), (media.IMA, 40, 1))]
    want = [media.decode(*f).tolist() for f in files]
    for piece, across in ((7, 2), (1, 1), (100, 3)):
        monkeypatch.setattr(media, "PIECE", piece)
        monkeypatch.setattr(media, "ACROSS", across)
        got = [[] for _ in files]
        tracks = [media.Track() for _ in files]
        for k, pcm in media.pieces(files):
            got[k] += pcm.tolist()
            tracks[k].add(pcm)
        assert got == want
        for track, pcm in zip(tracks, want, strict=True):
            assert track.finish() == media.resample(np.array(pcm, np.int16)).tobytes()


def test_edge_rows(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "é"), (2, "")], "doc_id long, text string").selectExpr("*", "1 AS media", "'x' AS pcm", "2 AS feature", "3 AS data")
    stored = media.store_media(rows, "text")
    got = media.decode_media(stored).collect()
    assert len(got) == 4 and len({r.feature for r in got if r._row.n_bytes == 0}) == 1
    assert all(r._row._row.pcm == "x" and r._row._row.feature == 2 for r in got)
    for tag, per in ((media.MULAW, 4), (media.ALAW, 4)):
        assert all(len(r.pcm) == per * r.payload_bytes for r in media.decode_media(media.store_media(rows, "text", tag)).collect())
    assert media.decode_media(stored.where("false")).collect() == []
