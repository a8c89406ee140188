"""The exhaustive search for near-duplicates against brute force over all pairs."""

import random
import sys
from itertools import combinations

from pyspark.sql import functions as F

from corpusloom.functions.text import BLANKS, shingles, words
from corpusloom.operators import neardup

SCHEMA = "lib string, key int, text string"


def similarity(a, b):
    if not a or not b:
        return float(not a and not b)
    shared, together = set(a) & set(b), sorted(set(a) | set(b))
    if min(len(a), len(b)) >= neardup.K:
        return sum(h <= together[neardup.K - 1] for h in shared) / neardup.K
    return len(shared) / len(together)


def texts():
    rng, out = random.Random(3), []
    for _ in range(12):
        words = [f"w{rng.randrange(1000)}" for _ in range(rng.choice((20, 60, 200)))]
        for edits in (0, 1, 1, 2, 3):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "new"
            out.append((f"l{len(out) % 2}", len(out), " ".join(copy)))
    return out


def test_exhaustive(spark):
    docs = spark.createDataFrame(texts(), SCHEMA)
    lib = {k: x for x, k, _ in texts()}
    sk = {r.key: r.sk for r in neardup.sketches(docs, "key", "text").collect()}
    rep = {k: min(x for x in sk if sk[x] == sk[k]) for k in sk}
    want = {(a, b) for a, b in combinations(sorted(set(rep.values())), 2) if similarity(sk[a], sk[b]) >= neardup.THRESHOLD}
    reps = neardup.classes(neardup.sketches(docs, "key", "text"))
    assert {(r.a, r.b) for r in neardup.pairs(reps, strict=False).collect()} == want
    assert {(r.a, r.b) for r in neardup.pairs(reps).collect()} < want
    links = want | {(r, k) for k, r in rep.items() if r != k}
    root = {k: k for ab in links for k in ab}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.key: r.cluster for r in neardup.clusters(docs, "key", "text", strict=False).collect()} == root
    stats = neardup.statistics(docs, "key", "text", strict=False).first()
    assert tuple(stats) == (len(sk), 0, len(want), len(set(root.values())))
    within = {(r.lib, r.a, r.b) for r in neardup.library_pairs(docs, "lib", "key", "text", strict=False).collect()}
    assert {(a, b) for _, a, b in within} >= {(a, b) for a, b in want if lib[a] == lib[b] and len(sk[a]) < neardup.K > len(sk[b])}
    assert all(lib[a] == lib[b] == x for x, a, b in within)


def test_large_buckets_give_the_same(spark, monkeypatch):
    """Whether buckets are compared directly or by their rarest values."""
    docs = spark.createDataFrame(texts(), SCHEMA)
    reps = neardup.classes(neardup.sketches(docs, "key", "text"))
    want = sorted(map(tuple, neardup.pairs(reps).collect()))
    for large in (1, 2, 3):
        monkeypatch.setattr(neardup, "LARGE", large)
        assert sorted(map(tuple, neardup.pairs(reps).collect())) == want
    assert want


def test_a_common_opening_makes_no_candidates(spark):
    """300 texts with the same long opening and licence but bodies of their own: rare values hardly meet."""
    common = " ".join(f"c{i}" for i in range(60))
    docs = spark.range(300).selectExpr("int(id) AS key", f"concat('{common} ', array_join(transform(sequence(1, 200), i -> concat('b', id, 'x', i)), ' ')) AS text")
    reps = neardup.classes(neardup.sketches(docs, "key", "text"))
    assert neardup._met(neardup._cells(reps, 0.8, False)).count() < 300
    assert neardup.pairs(reps, strict=False).count() == 0 and neardup.pairs(reps).count() == 0


def test_links_of_a_template(spark):
    """400 variants of one text: clusters are those of all pairs, with edges in proportion to the rows."""
    rng, docs = random.Random(6), []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(120)]
        for i in range((400, 40, 3)[family]):
            made = list(base)
            for _ in range(rng.randrange(1, 7)):
                made[rng.randrange(len(made))] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(made)))
    frame = spark.createDataFrame(docs, "key int, text string")
    reps = neardup.classes(neardup.sketches(frame, "key", "text"))
    for strict in (True, False):
        sk = {r.rep: r.sk for r in reps.collect()}
        edges = [(r.a, r.b) for r in neardup.links(reps, strict=strict).collect()]
        assert len(edges) < 32 * len(sk)  # a few for each of its cells
        every = [(r.a, r.b) for r in neardup.pairs(reps, strict=strict).collect()]
        assert len(every) > 2 * len(edges)

        def roots(links):
            root = {k: k for k in sk}

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in links:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
            return {k: find(k) for k in sk}

        assert roots(edges) == roots(every)


def test_sketches_are_those_of_the_shingles(spark):
    """Hashes in Spark's own functions; words end at every blank, and one word alone has no sketch."""
    assert set(BLANKS) == {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()}
    rng = random.Random(4)
    blanks = [*BLANKS, "  \n", "　 "]
    rows = ["", " ", None, "one", " one ", "one two", " one\ttwo \n", "Ein ZWEI Straße", "a a a a a a a", "ab \U0001f600 İx ǅ é"]
    rows += ["".join(rng.choice(["W", "é", "字", "x1"]) + str(rng.randrange(9)) + rng.choice(blanks) for _ in range(n)) for n in (3, 4, 5, 80, 400)]
    docs = spark.createDataFrame(list(enumerate(rows)), "key int, text string")
    hashes = F.transform(shingles(words(F.col("text")), 4), lambda s: F.substring(F.sha1(s.cast("binary")), 1, 16))
    plain = docs.where(F.size(words(F.coalesce("text", F.lit("")))) >= 2).select("key", F.slice(F.array_sort(F.array_distinct(hashes)), 1, 64).alias("sk"))
    made = neardup.sketches(docs, "key", "text")
    want = {r.key: r.sk for r in plain.collect()}
    assert {r.key: r.sk for r in made.collect()} == want and len(want) == 10
    assert "transform(" not in made._jdf.queryExecution().toString()  # no steps for each shingle in Spark's interpreted lambdas
