"""The tokenization automaton against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got, decoded = bpe.encoder(PATH).encode_text(text)
    assert got == " ".join(map(str, ids)), repr(text)
    assert decoded == library.decode(ids, skip_special_tokens=False), repr(text)


def test_random_letters(library):
    rng = random.Random(1)
    letters = "aaaabbctheinre '’.,!?İΣςσßéñ漢字かな٣½ⅷ̀́\x1c\x1d\x85\xa0​　\t\n\r\x00\x7f😀<|>endoftext"
    for _ in range(1500):
        same(library, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))))


def test_random_tokens(library):
    rng, words = random.Random(2), sorted(library.get_vocab())
    for _ in range(1500):
        same(library, "".join(rng.choice(words).replace("</w>", "") for _ in range(rng.randint(1, 6))))


def test_special_and_long(library):
    for text in ["x<|endoftext|>y <|startoftext|>", "<|endoftext|><|endoftext|>", "a" * 30_000, "ab" * 9_999, "ΑΣ ΣΑΣ", "don't I'LL we've 'S", "école", "Ⅷ ① 12345", ""]:
        same(library, text)


def test_small_cache_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    fresh = bpe.Encoder(PATH)
    text = "the quick brown fox jumps over the lazy dog " * 3
    fresh.encode_text("some other words")
    assert fresh.encode_text(text)[0] == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_windows_and_batches_give_the_same(library, monkeypatch):
    rng, words = random.Random(3), sorted(library.get_vocab())
    texts = [" ".join(rng.choice(words).replace("</w>", "") + rng.choice(words)[:3] for _ in range(rng.randint(0, 400))) for _ in range(60)]
    want = [" ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in texts]
    for size in (50, 3000, 1 << 21):
        monkeypatch.setattr(bpe, "SLICE", size)
        enc = bpe.Encoder(PATH)
        got = [x for ids, ends in enc.encode_texts(texts) for x in enc.joined(enc.numbers, ids, ends).to_pylist()]
        assert got == want


def test_documents(spark, sf, library):
    got = {r.doc_id: r for r in bpe.op10_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a"), (2, "")], "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "'q' AS ids")
    got = bpe.encode_documents(docs, PATH, with_ids=True, with_decoded=True).collect()
    assert sorted((r.n_tokens, r.decoded, len(r.ids)) for r in got) == [(0, "", 0), (0, "", 0), (0, "", 0), (1, "a</w>", 1)]
    assert bpe.encode_documents(docs.where("false"), PATH).collect() == []
