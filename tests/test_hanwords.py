"""Words of Han texts against slow versions and known words."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom import han_queries
from corpusloom.api import Engine
from corpusloom.functions.text import tokens
from corpusloom.operators import blockmax, bm25, evaluation, hanwords
from corpusloom.tables import Conflict


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")


def slow_words(rows, longest, least, cohesion, freedom):
    runs = [r for t in rows for r in re.findall("[一-鿿]+", t or "")]
    n, sides = Counter(), defaultdict(lambda: (Counter(), Counter()))
    for r in runs:
        for i in range(len(r)):
            for k in range(1, min(longest, len(r) - i) + 1):
                g = r[i : i + k]
                n[g] += 1
                sides[g][0][r[i - 1] if i else object()] += 1
                sides[g][1][r[i + k] if i + k < len(r) else object()] += 1
    total = sum(c for g, c in n.items() if len(g) == 1)
    entropy = lambda c: -sum(x / sum(c.values()) * math.log(x / sum(c.values())) for x in c.values())
    out = {}
    for g, c in n.items():
        if len(g) > 1 and c >= least:
            free = min(map(entropy, sides[g]))
            holds = min(math.log(c * total / (n[g[:i]] * n[g[i:]])) for i in range(1, len(g)))
            if free >= freedom and holds >= cohesion:
                out[g] = (c, round(holds, 6), round(free, 6))
    return out


def made_up(seed, size=60):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("火箭发动机推进剂燃烧室喷管水泵") for _ in range(rng.choice([1, 2, 2, 3, 4]))) for _ in range(25)]
    return ["。".join("".join(rng.choice(lexicon) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 6))) for _ in range(size)]


def test_discovery_is_what_the_slow_version_finds(spark, monkeypatch):
    for seed, longest, piece in ((1, 4, 1024), (2, 3, 5), (3, 2, 1)):  # short pieces: runs are counted in parts
        monkeypatch.setattr(hanwords, "PIECE", piece)
        rows = made_up(seed) + [None, "", "no Han", "机"]
        got = {r.word: (r.n, round(r.cohesion, 6), round(r.freedom, 6)) for r in hanwords.discover(texts(spark, *rows), "text", longest, 3, 0.5, 0.4).collect()}
        want = slow_words(rows, longest, 3, 0.5, 0.4)
        assert len(want) > 5
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(a - b) < 1e-5 for w in want for a, b in zip(got[w][1:], want[w][1:], strict=True))


def slow_cut(run, weights, unknown):
    """The best of all ways to cut a run; of equal ones that with the longer first words."""
    def ways(rest):
        if not rest:
            yield []
        for k in range(1, len(rest) + 1):
            if k == 1 or rest[:k] in weights:
                yield from ([rest[:k], *w] for w in ways(rest[k:]))

    return max(ways(run), key=lambda ws: (sum(weights.get(w, unknown) for w in ws), [len(w) for w in ws]))


def test_cut_is_the_most_likely():
    rng = random.Random(5)
    for _ in range(300):
        signs = "天地人和"[: rng.randint(1, 4)]
        weights = {"".join(rng.choice(signs) for _ in range(rng.randint(1, 4))): -rng.randint(1, 6) for _ in range(rng.randint(0, 14))}
        unknown, run = min(weights.values(), default=0) - 1, "".join(rng.choice("天地人和") for _ in range(rng.randint(0, 10)))
        longest = max(map(len, weights), default=1)
        assert hanwords.cut(run, weights, unknown, longest) == slow_cut(run, weights, unknown)


def test_words_in_spark_equal_the_slow_cut(spark):
    rows = [*made_up(7, 40), None, "", "abc 火箭 x", "龘龘火"]
    entries = hanwords.learn(texts(spark, *rows), "text", least=3)
    cutter, listed = hanwords.segmenter(spark, entries), {r.word: r.n for r in entries.collect()}
    weights = {w: round(math.log(n / sum(listed.values())) * hanwords.MICRO) for w, n in listed.items()}
    assert cutter.weights.value == weights and max(map(len, weights)) > 1
    got = {r.id: r.words for r in texts(spark, *rows).select("id", cutter.words(F.col("text")).alias("words")).collect()}
    for i, t in enumerate(rows):
        runs = re.findall("[一-鿿]+", t or "")
        assert "".join(got[i]) == "".join(runs)
        if all(len(r) <= 14 for r in runs):
            assert got[i] == [w for r in runs for w in slow_cut(r, weights, cutter.unknown)]


def test_empty_and_long_texts(spark):
    none = texts(spark).where("false")
    assert hanwords.discover(none, "text").count() == 0 and hanwords.learn(none, "text").count() == 0
    cutter = hanwords.segmenter(spark, none.select(F.col("text").alias("word"), F.lit(1).cast("long").alias("n")))
    assert texts(spark, "火箭 ab").select(cutter.tokens(F.col("text")).alias("t")).first().t == ["ab", "火箭", "火", "箭"]
    long = "火箭发动机" * 60_000  # one run
    counts = {r.gram: r.n for r in hanwords.gram_counts(texts(spark, long), "text").where("length(gram) = 2").collect()}
    assert counts["火箭"] == 60_000 and counts["机火"] == 59_999 and counts[hanwords.EDGE + "火"] == 1
    got = texts(spark, long).select(F.size(cutter.words(F.col("text"))).alias("n")).first()
    assert got.n == 300_000


def test_stop_signs_are_no_terms_and_words_are(spark, tmp_path):
    rows = ["火箭发动机的喷管", "火箭发动机和水泵", "水泵的火箭发动机", "喷管和水泵", "的火箭发动机在水泵"] * 3
    entries = spark.createDataFrame([("火箭发动机", 9), ("喷管", 5), ("水泵", 9), *[(c, 1) for c in "火箭发动机的喷管和水泵在"]], "word string, n long")
    cutter = hanwords.segmenter(spark, entries)
    index = bm25.build(texts(spark, *rows), "id", "text", terms=cutter.tokens)
    terms = {r.term for r in index.postings.select("term").distinct().collect()}
    assert {"火箭发动机", "喷管", "水泵", "火箭", "的喷"} <= terms and not terms & set("的和在")
    found = {r.cid for r in bm25.score(index, "火箭发动机", terms=cutter.tokens).collect()}
    assert found == {i for i, t in enumerate(rows) if "火箭发动机" in t}
    blocks = blockmax.write(blockmax.build(texts(spark, *rows), "id", "text", terms=cutter.tokens), str(tmp_path / "blocks"))
    scores = {r.cid: round(r.bm25, 9) for r in bm25.score(index, "火箭发动机的水泵", terms=cutter.tokens).collect()}
    best = {r.cid: round(r.bm25, 9) for r in blockmax.top(blocks, "火箭发动机的水泵", 3, terms=cutter.tokens).rows.collect()}
    assert len(best) >= 3 and min(best.values()) >= sorted(scores.values())[-3] - 1e-5 and all(scores[c] == b for c, b in best.items())


def limits(words):
    ends, at = set(), 0
    for w in words:
        at += len(w)
        ends.add(at)
    return ends


def agreement(rows):
    """Precision and recall of the limits. rows: words that were said, and true ones."""
    said, true = zip(*((limits(a), limits(b)) for a, b in rows), strict=True)
    right = sum(len(a & b) for a, b in zip(said, true, strict=True))
    return right / sum(map(len, said)), right / sum(map(len, true))


def test_words_of_a_lexicon_are_found_again(spark):
    """Words of one to four of 300 signs, by a law of Zipf."""
    rng = random.Random(11)
    lexicon = list({"".join(chr(0x5000 + rng.randrange(300)) for _ in range(rng.choice([1, 2, 2, 2, 3, 4]))) for _ in range(400)})
    weights = [1 / (i + 3) for i in range(len(lexicon))]
    said = [rng.choices(lexicon, weights, k=rng.randint(1, 60)) for _ in range(1500)]
    docs = texts(spark, *map("".join, said))
    cutter = hanwords.segmenter(spark, hanwords.learn(docs, "text"))
    got = {r.id: r.words for r in docs.select("id", cutter.words(F.col("text")).alias("words")).collect()}
    precision, recall = agreement([(got[i], w) for i, w in enumerate(said)])
    print("lexicon: precision", precision, "recall", recall)
    assert precision > 0.95 and recall > 0.95


def test_limits_in_documents_against_single_signs_and_pairs(spark, sf):
    """Documents whose spaces were taken. Three words in ten are used less than five times, so they can't be found."""
    source = spark.read.parquet(f"{sf}/documents.parquet")
    docs = source.select("doc_id", "text", han_queries._as_han(F.col("text")).alias("han"))
    cutter = hanwords.segmenter(spark, hanwords.learn(docs, "han"))
    found, signs, pairs = [], [], []
    for r in docs.select("text", "han", cutter.words(F.col("han")).alias("words")).collect():
        runs = re.findall("[一-鿿]+", r.han)
        assert "".join(r.words) == "".join(runs)
        true = ["x" * ((len(w) + 1) // 2) for w in re.findall("[a-z]+", (r.text or "").lower())]
        found.append((r.words, true))
        signs.append(("".join(runs), true))
        pairs.append(([x[i : i + 2] for x in runs for i in range(0, len(x), 2)], true))
    mean = lambda rows: 2 / sum(1 / x for x in agreement(rows))
    print("documents:", agreement(found), "single signs:", agreement(signs), "pairs:", agreement(pairs))
    assert mean(found) > max(mean(signs), mean(pairs))


def test_queries(spark, sf):
    made = {r.doc_id: r for r in entry.queries()["han_segments"](spark, sf).collect()}
    assert set(made) == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.terms: r for r in entry.queries()["han_retrieval"](spark, sf).collect()}
    assert set(rows) == {"shingles", "words"}
    assert all(0 <= r.hit_1 <= r.hit_3 <= r.hit_5 <= r.questions for r in rows.values())


def test_terms_in_batches_are_those_of_tokens(spark):
    """Also for texts with Latin words, and without a text; the index's texts are cut where their terms are counted."""
    rows = [None, "", "火箭", "A水", "ab1 火箭发动机x水泵 C-3.x", "。火。箭", "x", "İK 水泵", "水泵" * 50, "no signs HERE"]
    for some in (rows, rows[:2], ["火箭水泵"], ["Ab cd"]):
        got = spark.createDataFrame([(t,) for t in some], "text string").select(tokens(F.col("text")).alias("a"), hanwords.shingles(F.col("text")).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]
    docs = texts(spark, *rows[1:])
    index = bm25.build(docs, "id", "text", terms=hanwords.shingles)
    assert "regexp_extract_all" not in index.listed._jdf.queryExecution().toString()
    questions = spark.createDataFrame([(1, "火箭发动机 c-3.x"), (2, "水泵 here")], "qid long, question string")
    ranks = lambda terms: sorted(map(tuple, evaluation.keyword_ranks(bm25.build(docs, "id", "text", terms=terms), questions, 4, terms=terms).collect()))
    assert ranks(hanwords.shingles) == ranks(tokens) != []


def test_signs_of_documents(spark):
    """Against a loop over the pairs of letters."""
    rows = [None, "", "a", "Ab", "abc.", "x1yz! İK", "ñaé zz?ab", "." * 5, "1 2", "abcdefg" * 9]
    sign = lambda p: "。" if p in ".!?" else chr(0x4E00 + 27 * (ord(p[0]) - 97) + (ord(p[1]) - 96 if len(p) > 1 else 0))
    df = spark.createDataFrame(enumerate(rows), "id long, text string").select("id", han_queries._as_han(F.col("text")).alias("han"))
    want = {i: "".join(map(sign, re.findall("[a-z]{1,2}|[.!?]", (t or "").lower()))) for i, t in enumerate(rows)}
    assert {r.id: r.han for r in df.collect()} == want and {r.id: r.han for r in df.where("id > 3").repartition(2).collect()} == {i: h for i, h in want.items() if i > 3}


def test_questions_are_whole_passages(spark, tmp_path):
    """Passages that differ only behind their first 60 letters."""
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    start = " ".join(letters(8) for _ in range(12))
    passages = [(i, start + " " + " ".join(letters(8) for _ in range(12))) for i in range(6)]
    spark.createDataFrame(passages, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.terms: r for r in entry.queries()["han_retrieval"](spark, str(tmp_path)).collect()}
    assert all((r.questions, r.hit_1) == (6, 6) for r in rows.values())


def test_engine_learns_words_and_searches_by_them(spark, tmp_path):
    rng = random.Random(3)
    lexicon = ["发动机", "推进剂", "燃烧室", "喷管", "水泵", "阀门", "涡轮", "管路", "支架", "冷却"]
    notes = tmp_path / "notes"
    notes.mkdir()
    lines = lambda n: "。\n\n".join("".join(rng.choices(lexicon, k=12)) for _ in range(n))
    for i in range(6):
        (notes / f"n{i}.md").write_text(f"# 笔记\n{lines(25)}。")
    engine = Engine(spark, "file://" + str(tmp_path / "index"))
    engine.add_library("notes", "file://" + str(notes))
    engine.reindex_knowledge("notes")
    postings = lambda: {r.term for r in engine.tables.read("postings").select("term").distinct().collect()}
    assert "发动" in postings() and not {"发动机", "推进剂", "燃烧室"} & postings()
    assert engine.learn_words() >= len(lexicon)
    assert {"发动", "发动机", "推进剂", "燃烧室"} <= postings()
    (notes / "new.md").write_text("# 新\n" + "发动机阀门水泵" * 4)
    engine.reindex_knowledge("notes")  # by the same dictionary
    lengths = {(r.rel, r.chunk): r.dl for r in engine.tables.read("lengths").select("cid.rel", "cid.chunk", "dl").collect()}
    terms = engine._terms(engine.tables.current())
    again = engine.tables.read("chunks").select("rel", "chunk", F.size(terms(F.col("text"))).alias("dl")).collect()
    assert lengths == {(r.rel, r.chunk): r.dl for r in again}
    best = engine.search_knowledge("发动机阀门水泵", top_k=1).first()
    assert best.rel == "new.md"


def test_a_library_that_changes_while_words_are_learned(spark, tmp_path, monkeypatch):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("# 笔记\n" + "火箭水泵。" * 9)
    engine = Engine(spark, "file://" + str(tmp_path / "index"))
    engine.add_library("notes", "file://" + str(notes))
    engine.reindex_knowledge("notes")
    learn = hanwords.learn

    def meanwhile(*args, **more):
        (notes / "b.md").write_text("# 二\n喷管")
        engine.reindex_knowledge("notes")
        return learn(*args, **more)

    monkeypatch.setattr(hanwords, "learn", meanwhile)
    with pytest.raises(Conflict):
        engine.learn_words()
    assert {r.rel for r in engine.tables.read("lengths").select("cid.rel").collect()} == {"a.md", "b.md"}


def test_runs_side_by_side_are_cut_like_one(monkeypatch):
    rng = random.Random(17)
    for beside in (1, 3, 24):
        monkeypatch.setattr(hanwords, "BESIDE", beside)
        for _ in range(40):
            signs = "天地人和火箭"[: rng.randint(1, 6)]
            weights = {"".join(rng.choice(signs) for _ in range(rng.randint(1, 4))): -rng.randint(1, 6) for _ in range(rng.randint(0, 20))}
            unknown = min(weights.values(), default=0) - 1
            rows = ["x".join("".join(rng.choice("天地人和火箭") for _ in range(rng.choice([1, 2, 9, 80]))) for _ in range(rng.randint(0, 9))) for _ in range(12)] + [None, "", "abc"]
            said = hanwords._said(rows, hanwords.Lexicon(weights, unknown)).to_pylist()
            longest = max(map(len, weights), default=1)
            assert said == [[w for run in re.findall("[一-鿿]+", t or "") for w in hanwords.cut(run, weights, unknown, longest)] for t in rows]


def test_one_window_moves_for_each_sign_and_rare_grams_stay_out(spark):
    rows = made_up(23)
    every = {r.gram: r.n for r in hanwords.gram_counts(texts(spark, *rows), "text").collect()}
    slow = Counter()
    for run in (hanwords.EDGE + r + hanwords.EDGE for t in rows for r in re.findall("[一-鿿]+", t)):
        slow.update(run[i : i + k] for i in range(len(run)) for k in range(1, hanwords.LONGEST + 2) if i + k <= len(run))
    del slow[hanwords.EDGE]
    assert every == slow
    often = hanwords.gram_counts(texts(spark, *rows), "text", least=2)
    assert {r.gram: r.n for r in often.collect()} == {g: n for g, n in slow.items() if n > 1 or len(g) == 1}
    windows = sum(n.sum() for _, n in hanwords._windows(rows, hanwords.LONGEST + 1, 100))
    assert windows == sum(len(r) + 1 for t in rows for r in re.findall("[一-鿿]+", t))
    wide = "".join(chr(0x4E00 + 7 * i) for i in range(2900)) * 2  # too many different signs for codes of 64 bits
    grams = [g for w, _ in hanwords._windows([wide * 3], 8, 1 << 20) for g in w.tolist()]
    assert len(grams) == len(set(grams)) and {wide[i : i + 8] for i in range(2900)} <= set(grams)


def test_longer_words_of_other_dictionaries(spark):
    entries = spark.createDataFrame([("火箭发动机", 9), ("火箭", 3), ("水泵", 4), *[(c, 1) for c in "火箭发动机水泵"]], "word string, n long")
    cutter = hanwords.segmenter(spark, entries)
    docs = texts(spark, "火箭发动机水泵火箭。水", None)
    assert [r.w for r in docs.select("id", cutter.words(F.col("text")).alias("w")).orderBy("id").collect()] == [["火箭发动机", "水泵", "火箭", "水"], []]
    assert {r.word: r.n for r in cutter.counted(docs, "text").collect()} == {"火箭发动机": 1, "水泵": 1, "火箭": 1, "水": 1}


def test_windows_move_as_numbers(spark):
    rng = random.Random(12)
    for size in (1, 3, 4, 5, 8, 9):
        signs = ["".join(rng.choices("一鿿中" + hanwords.EDGE, k=rng.randrange(1, size + 1))) for _ in range(60)]
        batch = hanwords._numbered(np.array(signs, f"<U{size}"), np.arange(60), size)
        back, n = hanwords._named(batch, size)
        assert back.tolist() == signs and n.tolist() == list(range(60))
        assert {str(t) for t in batch.schema.types} == {"int64"}
    plan = hanwords.gram_counts(texts(spark, "火箭发动机"), "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "g0" in plan and "substr" not in plan


def test_terms_leave_stop_signs_out(spark):
    for word in ("火箭", "火箭发动机"):  # of both ways to cut
        entries = spark.createDataFrame([(word, 50), ("的", 40), ("因为", 30), ("水", 3)], "word string, n long")
        cutter, docs = hanwords.segmenter(spark, entries), texts(spark, word + "的水因为的，了", "", "的", "ab 水的")
        got = {r.id: (r.t, r.w) for r in docs.select("id", cutter.tokens(F.col("text")).alias("t"), cutter.words(F.col("text"), terms=True).alias("w")).collect()}
        assert [got[i][1] for i in range(4)] == [[word, "水", "因为"], [], [], ["水"]]
        assert got[3][0] == ["ab", "水的", "水"] and "filter" not in docs.select(cutter.tokens(F.col("text")))._jdf.queryExecution().toString()
