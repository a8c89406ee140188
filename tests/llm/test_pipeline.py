"""The pipeline's stages, one after the other, against brute force on what each was given."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_nearcopies import slow_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("steps") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns


def test_language_keeps_what_has_a_language(steps):
    before, after = steps[0]
    dropped = set(rows(before)) - set(rows(after))
    assert len(dropped) <= 0.01 * before.count()
    assert all(sum(c.isalpha() for c in r[1] or "") < 20 for r in dropped)


def normal(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def test_exact(steps):
    before, after = steps[1]
    first = {}
    for r in sorted(rows(before)):
        first.setdefault(normal(r[1] or ""), r)
    assert rows(after) == sorted(first.values())


def test_near(steps):
    before, after = steps[2]
    assert {r[0] for r in rows(after)} == set(slow_groups({r.doc_id: r.text for r in before.collect()}).values())


def test_mix(steps):
    before, after = steps[3]
    size = lambda r: len((r.text or "").split())
    sizes, taken = {}, {}
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r)
    copies = {}
    for r in after.collect():
        taken[r.source] = taken.get(r.source, 0) + size(r)
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    order = sorted(sizes)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weights[s] / sum(weights[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    longest = {s: max(size(r) for r in before.collect() if r.source == s) for s in order}
    for s in order:
        assert abs(taken.get(s, 0) - target[s]) <= longest[s] / 2 + 1
    assert max(copies.values()) <= 3


def test_encode(steps):
    before, after = steps[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in before.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids, r.ids_sha256) for r in after.collect()) == sorted(want)


def test_run_is_the_same(spark, sf, steps):
    assert rows(corpus_pipeline.run(spark, sf)) == rows(steps[-1][1])


def test_stages_leave_no_tables_of_earlier_ones(spark, sf, steps):
    from corpusloom import storage

    corpus_pipeline.run(spark, sf)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(storage._own_dir(spark))
    left = {s.getPath().getName() for s in place.getFileSystem(conf).listStatus(place)}
    assert not left & {f"pipeline-stage-{i}" for i in range(4)} and {x for x in left if x.startswith("pipeline-result")} == {"pipeline-result-3"}


def test_edge_rows_in_every_stage(spark, sf, tmp_path):
    """Nulls, empty, repeated, very long and tied rows, clashing names, and the empty table."""
    long = "the house of the river and the water of the town " * 20_000
    words = "the small house near the river is older than the town and the people who live there say so"
    given = [
        (1, None, "en", "a"), (2, "", None, None), (3, words, "en", "a"), (3, words, "en", "a"), (None, words, None, None), (None, "der Hund und die Katze sind in dem Haus bei dem Fluss", "de", "b"),
        (5, long, "en", "b"), (6, long + "x", "xx", "b"), (7, words.upper(), "en", None), (8, "12 34", "en", "a"),
    ]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string, source string").selectExpr("*", "1L AS n_chars", "2 AS _row", "3 AS id", "4 AS h", "5 AS bucket", "6 AS fp", "7 AS size")
    for rows_in in (df, df.where("false")):
        docs = rows_in
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            path = f"{tmp_path}/{rows_in is df}-{i}"
            out.write.parquet(path)
            after = spark.read.parquet(path)
            assert i == len(corpus_pipeline.STAGES) - 1 or after.columns == df.columns
            docs = after
            if i == 1 and rows_in is df:
                assert sorted((r.doc_id is None, r.doc_id, r.text[:20]) for r in docs.collect() if r.doc_id != 6) == sorted([(False, 3, words[:20]), (True, None, "der Hund und die Kat"), (False, 5, long[:20]), (False, 7, words.upper()[:20])])
    assert docs.count() == 0
