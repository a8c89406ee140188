"""Near copies: fingerprints and groups against brute force, and how many planted near copies are found."""

import random

import numpy as np
from xxhash import xxh64_intdigest

from corpusloom.llm import nearcopies
from tests.llm.test_simhash import slow_fingerprint

M = (1 << 64) - 1


def slow_words(text):
    words = {w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w}
    out = []
    for k in range(1, nearcopies.FAMILIES + 1):
        ones = [0] * 64
        for w in words:
            z = (xxh64_intdigest(w.encode(), 42) + k * 0x9E3779B97F4A7C15) & M
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & M
            z = (z ^ z >> 27) * 0x94D049BB133111EB & M
            z ^= z >> 31
            for b in range(64):
                ones[b] += z >> b & 1
        out.append(sum((2 * n > len(words)) << b for b, n in enumerate(ones)))
    return out


def slow_groups(texts):
    """texts: key -> text. The smallest key of each group."""
    words, shingles = {k: slow_words(t) for k, t in texts.items()}, {k: slow_fingerprint(t) & M for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (shingles[a] ^ shingles[b]).bit_count() <= nearcopies.SHINGLE_BITS and any((x ^ y).bit_count() <= 2 for x, y in zip(words[a], words[b], strict=True)):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def test_fingerprints():
    for text in ("", "a", "A a b", "one two three\tfour\nfive " * 300, " ".join(f"w{i}é" for i in range(3000))):
        assert [int(x) & M for x in nearcopies.word_fingerprints(text.encode())] == slow_words(text)
    assert not nearcopies.word_fingerprints(None).any()


def test_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in nearcopies.drop_near_copies(docs).collect()} == set(slow_groups(texts).values())


def edited(rng, words, share):
    out = []
    for w in words:
        if rng.random() >= share:
            out.append(w)
        elif rng.random() < 0.6:
            out.append(f"new{rng.randrange(10**6)}")
    return out


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_near_copies(spark):
    """Edited copies of documents at a five-word similarity of 0.8 or more: at least nine in ten are found;
    unrelated documents, texts of the same words in another order and templates with other entries stay."""
    rng = random.Random(8)
    docs = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("n_chars BETWEEN 800 AND 4000").orderBy("doc_id").limit(700).collect()]
    rows, planted = [], []
    for i, words in enumerate(docs):
        rows.append((i, " ".join(words)))
        copy = edited(rng, words, rng.choice((0.004, 0.01, 0.02)))
        if copy != words and jaccard(words, copy) >= 0.8:
            planted.append(10_000 + i)
            rows.append((10_000 + i, " ".join(copy)))
    apart = list(range(20_000, 20_040))
    for i in apart[:20]:
        mixed = list(docs[i - 20_000])
        rng.shuffle(mixed)
        rows.append((i, " ".join(mixed)))
    form = "order {} of customer {} was sent on day {} by carrier {} and paid with card {}"
    rows += [(i, form.format(*(rng.randrange(10**6) for _ in range(5)))) for i in apart[20:]]
    kept = {r.doc_id for r in nearcopies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(p not in kept for p in planted) / len(planted)
    assert len(planted) > 400 and found >= 0.9, found
    assert set(apart) <= kept


def test_edge_rows(spark):
    words = "the small house near the river is older than the town and the people who live there say so"
    given = [(1, None), (2, ""), (3, words), (3, words), (None, words), (None, "something else"), (7, words.upper()), (8, "x " * 300_000)]
    df = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS words", "3 AS number", "4 AS id", "5 AS _row")
    out = nearcopies.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 3), (False, 8), (True, 0)]
    assert nearcopies.drop_near_copies(df.where("false")).collect() == []


def test_crowded_groups(spark):
    """Pairs of near copies among shuffles of the same words: whatever stands first in their groups, all pairs
    are found, and no shuffle goes; groups are those of all pairs."""
    rng = random.Random(3)
    for pairs, shuffles in ((20, 20), (60, 200)):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts = {}
        for i in range(shuffles):
            texts[i] = " ".join(rng.sample(words, len(words)))
        for i in range(pairs):
            base = rng.sample(words, len(words))
            k = rng.randrange(len(words) - 1)
            copy = base[:k] + [base[k + 1], base[k]] + base[k + 2 :]
            texts |= {1000 + 2 * i: " ".join(base), 1001 + 2 * i: " ".join(copy)}
        kept = {r.doc_id for r in nearcopies.drop_near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
        assert kept == {k for k in texts if k < 1000 or k % 2 == 0}


def test_template(spark):
    """Thousands of variants of one text, with few edges for each of them."""
    rng = random.Random(4)
    words = [f"t{rng.randrange(10**6)}" for _ in range(300)]
    texts = {}
    for i in range(1500):
        made = list(words)
        for _ in range(3):
            made[rng.randrange(len(made))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(made)
    marked = nearcopies.marks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    classes = marked.select(marked.doc_id.alias("number"), "fp", "words")
    edges = nearcopies.links(classes).count()
    assert edges < 40 * len(texts), edges
    kept = {r.doc_id for r in nearcopies.drop_near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(kept) <= 3 and 0 in kept, len(kept)


def test_groups_beyond_the_first_levels_are_compared_exactly(spark, monkeypatch):
    """Fingerprints in one group that are near others than its first: components are those of all pairs."""
    rng = random.Random(8)
    chain = [0, (1 << 10) - 1, (1 << 20) - 1]  # the last is near the second only, which is near the first
    crowd = []
    for _ in range(60):
        center = rng.getrandbits(64)
        crowd += [center] + [center ^ sum(1 << b for b in rng.sample(range(64), rng.choice([9, 12, 16]))) for _ in range(3)]
    for fps, tile in ((chain, 2048), (crowd, 2048), (crowd, 50)):
        monkeypatch.setattr(nearcopies, "TILE", tile)
        fps = list(dict.fromkeys(fps))
        root = list(range(len(fps)))
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= nearcopies.SHINGLE_BITS:
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        marked = spark.createDataFrame([(i, i, signed(x), [7] * nearcopies.FAMILIES) for i, x in enumerate(fps)], "doc_id long, text_hash long, fp long, words array<long>")
        assert {r.id for r in nearcopies.keepers(marked).collect()} == set(root)


def test_mixed_groups_make_few_rows_for_each_member(spark):
    """A template whose members are apart by order: what the exact level stores has at most a row for each family and
    block of a member, and links are those of all pairs by both fingerprints."""
    rng = random.Random(9)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flipped = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    word, shingle = [rng.getrandbits(64) for _ in range(nearcopies.FAMILIES)], [rng.getrandbits(64) for _ in range(12)]
    rows = {(flipped(rng.choice(shingle), rng.choice([0, 5, 9, 12])), tuple(flipped(w, rng.choice([0, 1, 2, 3])) for w in word)) for _ in range(150)}
    rows = list(rows)
    root = list(range(len(rows)))
    for i, (fa, wa) in enumerate(rows):
        for j, (fb, wb) in enumerate(rows[:i]):
            if (fa ^ fb).bit_count() <= nearcopies.SHINGLE_BITS and any((x ^ y).bit_count() <= nearcopies.RADIUS for x, y in zip(wa, wb, strict=True)):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    classes = spark.createDataFrame([(i, signed(f), [signed(x) for x in w]) for i, (f, w) in enumerate(rows)], "number long, fp long, words array<long>")
    stored, write = {}, nearcopies.materialise
    try:
        nearcopies.materialise = lambda df, label, *most: stored.setdefault(label, write(df, label, *most))
        got = {r.node: r.root for r in nearcopies.components(classes).collect()}
    finally:
        nearcopies.materialise = write
    assert {i: got.get(i, i) for i in range(len(rows))} == dict(enumerate(root))
    assert 1 < len(set(root)) < len(rows)
    assert 0 < stored["near-members"].count() <= len(rows) * nearcopies.FAMILIES * len(nearcopies.BLOCKS)
    assert stored["near-compared"].columns == ["number", "partner", "mixed"]
