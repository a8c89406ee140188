"""Segments, tombstones and compaction; commits and readers at the same time."""

import threading

import pytest

from corpusloom.tables import Change, Conflict, Tables


def rows(spark, *values):
    return spark.createDataFrame([("l", *v) for v in values], "lib string, rel string, v int")


def keys(spark, *names):
    return spark.createDataFrame([("l", n) for n in names], "lib string, rel string")


def seen(df):
    return sorted((r.rel, r.v) for r in df.collect())


def test_segments(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    t.commit({"a": {"p": Change(rows(spark, ("x", 1), ("y", 1), ("z", 1)), keys(spark, "x"))}})
    t.commit({"a": {"p": Change(rows(spark, ("x", 2), ("x", 3)), keys(spark, "x", "y"))}})
    assert seen(t.read("a")) == [("x", 2), ("x", 3), ("z", 1)]
    t.commit({"a": {"p": Change(rows(spark, ("y", 4)), keys(spark, "y"))}, "b": {"p": rows(spark, ("q", 1))}})
    t.commit({"a": {"p": Change(None, keys(spark, "z")), "other": rows(spark, ("zz", 9))}})
    want = [("x", 2), ("x", 3), ("y", 4), ("zz", 9)]
    assert seen(t.read("a")) == want and t.segments("a", "p") == 4 and t.read("a").columns == ["lib", "rel", "v"]
    assert seen(t.read("a", "lib string, rel string, v int", "p")) == want[:3]
    old = t.read("a")
    assert t.compact("p") == 1 and t.segments("a", "p") == 1 and t.compact("p") == 0
    assert seen(t.read("a")) == want == seen(old)
    t.commit({"a": {"p": Change(rows(spark, ("x", 5)), keys(spark, "x"))}})
    assert seen(t.read("a", part="p")) == [("x", 5), ("y", 4)]


def test_commits_of_different_parts(spark, tmp_path):
    """Threads that write parts of their own all succeed; of those that write one part one fails, without a trace."""
    t, failed = Tables(spark, str(tmp_path)), []
    t.commit({"a": {"shared": rows(spark, ("s", 0))}})

    def write(part, v):
        try:
            Tables(spark, str(tmp_path)).commit({"a": {part: rows(spark, (part, v))}})
        except Conflict:
            failed.append(part)

    threads = [threading.Thread(target=write, args=(f"p{i}", i)) for i in range(6)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not failed and seen(t.read("a")) == [("p0", 0), ("p1", 1), ("p2", 2), ("p3", 3), ("p4", 4), ("p5", 5), ("s", 0)]

    class Late(Tables):
        """Another commit comes while it writes."""

        def _written(self, name, part, *more):
            t.commit({"a": {other: rows(spark, (other, 7))}})
            return super()._written(name, part, *more)

    other = "p1"
    Late(spark, str(tmp_path)).commit({"a": {"shared": rows(spark, ("s", 1))}})
    assert ("s", 1) in seen(t.read("a")) and ("p1", 7) in seen(t.read("a"))
    other = "shared"
    with pytest.raises(Conflict):
        Late(spark, str(tmp_path)).commit({"a": {"shared": rows(spark, ("s", 2))}})
    assert ("shared", 7) in seen(t.read("a")) and not any(v == 2 and rel == "s" for rel, v in seen(t.read("a")))


def test_readers_outlive_commits(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    t.commit({"a": {"p": rows(spark, ("x", 0))}})
    reader = t.read("a")
    for v in range(1, 5):
        t.commit({"a": {"p": rows(spark, ("x", v))}})
    assert seen(reader) == [("x", 0)] and seen(t.read("a")) == [("x", 4)]
    Tables(spark, str(tmp_path), hours=0).commit({"a": {"p": rows(spark, ("x", 5))}})
    assert len(t.versions()) == 2


def test_a_half_written_manifest(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    t.commit({"a": {"p": rows(spark, ("x", 0))}})
    (tmp_path / "manifest" / "000000002.json").write_text('{"a": {"p"')
    assert seen(t.read("a")) == [("x", 0)]
    t.commit({"a": {"p": Change(rows(spark, ("y", 1)), keys(spark, "y"))}})
    assert seen(t.read("a")) == [("x", 0), ("y", 1)] and t.versions() == [1, 2, 3]


def test_one_changed_file_writes_its_own_rows(spark, tmp_path):
    """Of 300 files one changes: what is written has rows of this file only, and searches are equal before and
    after a compaction and after an index built anew."""
    from corpusloom.api import Engine

    vault = tmp_path / "vault"
    vault.mkdir()
    for i in range(300):
        (vault / f"n{i}.md").write_text(f"# Note {i}\nword{i} pumps and [[n{i + 1}]] water {'salt ' * (i % 7)}")
    engine = Engine(spark, str(tmp_path / "index"))
    engine.add_library("n", str(vault))
    engine.reindex_knowledge("n")
    (vault / "n7.md").write_text("# Other\nkerosene pumps")
    (vault / "n9.md").unlink()
    engine.reindex_knowledge("n")
    for name in ("file_meta", "file_text", "chunks", "vectors", "postings", "lengths"):
        entry = engine.tables.current()[name]["n"][-1]
        written = spark.read.parquet(f"{tmp_path}/index/{entry['rows']}")
        rel = "cid.rel" if "cid" in written.columns else "rel"
        assert {r[0] for r in written.select(rel).collect()} == {"n7.md"}, name
        assert spark.read.parquet(f"{tmp_path}/index/{entry['gone']}").count() == 2
    found = lambda e: [[tuple(r) for r in e.search_knowledge(q, top_k=8).select("rel", "score", "text", "total").collect()] for q in ("kerosene pumps", "word9", "salt water", "word8")]
    before = found(engine)
    assert before[0][0][0] == "n7.md" and engine.compact("n") == 6 and found(engine) == before
    anew = Engine(spark, str(tmp_path / "anew"))
    anew.add_library("n", str(vault))
    anew.reindex_knowledge("n")
    assert found(anew) == before
