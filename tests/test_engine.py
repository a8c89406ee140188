"""The whole engine on small folders: ingest, search, packages, streams, components, options."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.models import Deferred, HashedTokens, TokenOverlap, embed
from corpusloom.operators import components, delivery, graph, ingest, sampling
from corpusloom.plans import hybrid
from corpusloom.sources import config, extraction, files, package
from corpusloom.streaming import ingest as streams


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def write(folder, **texts):
    for name, content in texts.items():
        path = folder / name.replace("__", "/").replace("_md", ".md").replace("_bin", ".pdf")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_ingest_equals_rebuild(spark, tmp_path):
    write(tmp_path, a_md="# Rocket engines\n" + "The rocket engine burns fuel. " * 40, sub__b_md="[[a]] link. ok", empty_md=" \n", x_bin=b"%PDF \xff\xfe")
    seen = files.read(spark, str(tmp_path), "lib")
    rows = {r.rel: r for r in seen.collect()}
    assert set(rows) == {"a.md", "sub/b.md", "empty.md", "x.pdf"} and rows["empty.md"].text is None and rows["x.pdf"].content is not None
    notes = seen.where("text IS NOT NULL").select("lib", "rel", "text")
    chunks, states = ingest.chunk_files(notes)
    old = spark.createDataFrame(chunks.collect(), chunks.schema)
    assert {r.rel: r.links for r in states.collect()} == {"a.md": [], "sub/b.md": ["a"]}
    meta = seen.select("lib", "rel", "size", "mtime_ns", "hash", F.lit(False).alias("xfail"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("xsrc"))
    meta = spark.createDataFrame(meta.collect(), meta.schema)
    write(tmp_path, sub__b_md="[[a]] edited text", c_md="new note")
    (tmp_path / "empty.md").unlink()
    now = files.read(spark, str(tmp_path), "lib")
    status = {r.rel: r.status for r in ingest.diff(now, meta).collect()}
    assert status == {"a.md": "same", "sub/b.md": "changed", "c.md": "added", "empty.md": "removed", "x.pdf": "same"}
    touched = ingest.diff(now, meta).where("status <> 'same'")
    fresh, _ = ingest.chunk_files(now.join(touched.where("status IN ('added', 'changed')"), ["lib", "rel"], "left_semi").where("text IS NOT NULL").select("lib", "rel", "text"))
    full, _ = ingest.chunk_files(now.where("text IS NOT NULL").select("lib", "rel", "text"))
    assert sorted(map(str, ingest.publish(old, fresh, touched).collect())) == sorted(map(str, full.collect()))


def corpus(spark):
    body = {
        ("n", "fuel.md"): "# Fuel\nKerosene and oxygen burn in the chamber.\n## Pumps\n" + "Turbo pumps push kerosene at high pressure. " * 30,
        ("n", "cook.md"): "# Soup\nBoil water and add salt.", ("m", "sea.md"): "# Ships\nShips use pumps for sea water.", ("m", "sky.md"): "# Sky\nClouds are water.",
    }
    chunks, _ = ingest.chunk_files(spark.createDataFrame([(lib, rel, t) for (lib, rel), t in body.items()], "lib string, rel string, text string"))
    chunks = spark.createDataFrame(chunks.collect(), chunks.schema)
    return hybrid.Corpus(chunks, chunks.select("lib", "rel", "chunk", embed(F.col("text"), HashedTokens()).alias("vec")))


def test_search(spark):
    c = corpus(spark)
    hits = hybrid.search(c, "kerosene pumps pressure", hybrid.Options(top_k=3)).collect()
    assert ("n", "fuel.md", "Fuel / Pumps", True) in [(h.lib, h.rel, h.hp, h.backfilled) for h in hits[:2]]  # the best of each library is level
    assert len({(h.rel, h.hp) for h in hits}) == len(hits) and [h.delivered for h in hits] == list(range(1, len(hits) + 1))
    ranked = hybrid.search(c, "kerosene pumps pressure", hybrid.Options(top_k=2), reranker=TokenOverlap()).collect()
    assert ranked[0].rel == "fuel.md" and ranked[0].score == 1.0 and ranked[0].tier == "strong"
    only = hybrid.search(c, "water", hybrid.Options(top_k=5, libraries=("m",), folder="sky.md", with_body=False)).collect()
    assert [h.rel for h in only] == ["sky.md"] and only[0].text is None
    assert hybrid.search_hyde(c, "zzzz", lambda q: "kerosene pumps", hybrid.Options(top_k=1)).count() == 1


def test_delivery_equals_a_walk(spark):
    """The windows against walking through the candidates one by one."""
    rng = random.Random(4)
    for _ in range(3):
        cands = [("l", f"f{rng.randrange(4)}", i, f"s{rng.randrange(3)}", "t", rng.choice([None, rng.random()]), i) for i in range(60)]
        parents = {(f"f{a}", f"s{b}") for a in range(4) for b in range(3) if rng.random() < 0.5}
        done, per_file, want = set(), {}, []
        for _, rel, i, hp, _, score, pos in cands:
            if len(want) >= 7:
                break
            if (rel, hp) in parents and (rel, hp) in done or per_file.get(rel, 0) >= 3 or (score is not None and score < 0.2):
                continue
            done.add((rel, hp))
            per_file[rel] = per_file.get(rel, 0) + 1
            want.append(pos)
        frame = spark.createDataFrame(cands, "lib string, rel string, chunk int, hp string, body string, score double, pos int")
        sections = spark.createDataFrame([("l", r, h, "whole") for r, h in parents] or [("l", "-", "-", "-")], "lib string, rel string, hp string, parent string")
        assert [r.pos for r in delivery.deliver(frame, sections, 7, drop=0.2).orderBy("delivered").collect()] == want


def test_sampling(spark):
    points = [(i, "g", [x + dx, y + dx]) for i, (x, y, dx) in enumerate((x, y, d) for x, y in ((0, 0), (50, 0), (0, 50)) for d in (0.0, 0.1, 0.2))] + [(100, "h", [1.0, 1.0]), (101, "h", [2.0, 2.0])]
    df = spark.createDataFrame(points, "i long, g string, v array<double>")
    got = {}
    for r in sampling.farthest_points(df, "g", "i", "v", 3).collect():
        got.setdefault(r.g, []).append(r.i)
    assert sorted(i // 3 for i in got["g"]) == [0, 1, 2] and sorted(got["h"]) == [100, 101]
    assert sampling.farthest_points(df.where("false"), "g", "i", "v", 3).collect() == []


def test_semantic_edges(spark):
    df = spark.createDataFrame([("n0", [1.0, 0.0]), ("n1", [0.9, 0.1]), ("n2", [0.0, 1.0]), ("n3", [0.0, 0.95])], "id string, v array<double>")
    for block in (1, 4096):
        assert [(r.a, r.b) for r in graph.semantic_edges(df, "id", "v", threshold=0.9, block=block).collect()] == [("n0", "n1"), ("n2", "n3")]
    assert graph.semantic_edges(df, "id", "v", threshold=-1.0, per_node=3, cap=2).count() == 2


def test_semantic_edges_in_cells(spark):
    """Against the exact way: nothing that isn't there, and recall. Vectors of topics, as embeddings are; for
    vectors without any (sf0.1 at a similarity of 0.3) it is 0.76 with these settings."""
    rng = np.random.default_rng(2)
    topics = rng.normal(size=(60, 48))
    rows = [(i, (topics[i % 60] + 0.6 * rng.normal(size=48)).tolist()) for i in range(2400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {(r.a, r.b): r.sim for r in graph.semantic_edges(vectors, "vec_id", "embedding", cap=None).collect()}
    found = {(r.a, r.b): r.sim for r in graph.semantic_edges(vectors, "vec_id", "embedding", cap=None, centers=32, probes=4, block=200).collect()}
    hit = [k for k in exact if found.get(k) == exact[k]]
    assert len(exact) > 4000 and len(hit) / len(exact) >= 0.9, len(hit) / len(exact)
    same = {(r.a, r.b): r.sim for r in graph.semantic_edges(vectors.limit(300), "vec_id", "embedding", threshold=0.3, cap=None, centers=4, probes=4, block=50).collect()}
    assert same == {(r.a, r.b): r.sim for r in graph.semantic_edges(vectors.limit(300), "vec_id", "embedding", threshold=0.3, cap=None).collect()}
    assert graph.semantic_edges(vectors.where("false"), "vec_id", "embedding", centers=4).collect() == []


def test_semantic_edges_by_bounds(spark):
    """The rows of the exact way; on vectors with topics most pairs of blocks don't meet, on others nothing is lost."""
    rng = np.random.default_rng(2)
    topics = rng.normal(size=(12, 24))
    rows = [(i, (topics[i % 12] + 0.1 * rng.normal(size=24)).tolist()) for i in range(900)] + [(900, [0.0] * 24), (901, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = graph.semantic_edges(vectors, "vec_id", "embedding", cap=None).collect()
    found = graph.semantic_edges_by_bounds(vectors, "vec_id", "embedding", cap=None, block=20, cells=20).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, exact)) and len(exact) > 1500
    blocks = graph.bounded_blocks(vectors, "vec_id", "embedding", 0.62, 20, 20)
    assert blocks.pairs.count() < 0.5 * blocks.every, (blocks.pairs.count(), blocks.every)
    few = vectors.where("vec_id < 60 OR vec_id >= 900")
    for threshold in (0.0, 0.3):
        same = graph.semantic_edges(few, "vec_id", "embedding", threshold=threshold, cap=None).collect()
        assert sorted(map(tuple, graph.semantic_edges_by_bounds(few, "vec_id", "embedding", threshold=threshold, cap=None, block=9, cells=5).collect())) == sorted(map(tuple, same))
    assert graph.semantic_edges_by_bounds(vectors.where("false"), "vec_id", "embedding").collect() == []


def test_semantic_edges_move_vectors_in_their_type_once_for_each_block(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    for threshold in (0.3, -1.0):
        want = {(min(i, int(j)), max(i, int(j))) for i in range(90) for j in np.argsort(-np.round(sims[i], 9), kind="stable")[:4] if sims[i, j] >= threshold}
        for block in (7, 90, None):
            assert {(r.a, r.b) for r in graph.semantic_edges(vectors, "id", "v", threshold, cap=None, block=block).collect()} == want
    packed = graph._packed(vectors.select(F.lit(0).alias("cell"), (F.col("id") % 3).cast("int").alias("blk"), graph._points("id", "v", vectors).alias("p"))).collect()
    assert {len(r.vs) for r in packed} == {30 * 8 * 4} and sorted(i for r in packed for i in r.ids) == list(range(90))
    sizes = spark.range(1).select(*[graph._blocks_of(F.lit(n), None).alias(str(n)) for n in (500, 16_384, 720_000)]).first()
    assert tuple(sizes) == (1, 16, 44)


def test_package(spark, tmp_path):
    rows = spark.createDataFrame([("b", "t2", [0.0, 1.0], {"file": "x"}), ("a", "t1", [1.0, 0.0], {"file": "x"})], "id string, text string, embedding array<double>, meta map<string,string>")
    held = spark.createDataFrame([("x", bytearray(b"one")), ("y", bytearray(b"two"))], "rel string, content binary")
    path = str(tmp_path / "pack")
    manifest = package.export(rows, held, path)
    assert package.verify(manifest, package.manifest(held)).count() == 0
    broken = package.manifest(held.where("rel = 'x'").withColumn("content", F.lit("two").cast("binary")))
    assert {(r.rel, r.problem) for r in package.verify(manifest, broken).collect()} == {("x", "mismatch"), ("y", "missing")}
    assert all(r.same for r in package.same_vectors(rows, package.load(spark, path)).collect())


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    write(source, a_md="one", b_md="two")
    seen = []
    for _ in range(2):
        streams.drain(streams.new_files(spark, str(source)), "t", lambda df, n: seen.extend(r.path.rsplit("/", 1)[1] for r in df.select("path").collect()), str(tmp_path / "state"))
        write(source, c_md="three")
    assert sorted(seen) == ["a.md", "b.md", "c.md"]


class Halves:
    def pages(self, name, content):
        if name == "bad":
            raise ValueError(name)
        return [content.decode()[:3], content.decode()[3:]]


def test_extraction(spark):
    df = spark.createDataFrame([("h1", "ok", bytearray(b"abcdef")), ("h2", "bad", bytearray(b""))], "hash string, rel string, content binary")
    assert {r.hash: r.pages for r in extraction.extract(df, Halves()).collect()} == {"h1": ["abc", "def"], "h2": None}


def test_config():
    options, missing = config.load('// c\n{"default_top_k": 7, "small_to_big": false, "extensions": ["md", "x//y"], /* z */ "bm25_k1": 2,}')
    assert options["default_top_k"] == 7 and options["small_to_big"] is False and options["extensions"] == ["md", "x//y"] and options["bm25_k1"] == 2.0 and "bm25_b" in missing
    assert config.load("not json")[0] == config.DEFAULTS
    assert config.effective({"extensions": ["md", "pdf"]}, {"agent_formats": ["docx", "pdf"]})["agent_formats"] == ["pdf"]


def test_options_of_another_type_fall_back():
    given = '{"small_to_big": "false", "chunk_char_limit": -5, "default_top_k": 3.9, "bm25_k1": "2", "extensions": ["md", 3], "bm25_b": true, "rerank_candidates": 0, "dense_min_candidates": false, "exclude_dirs": "x"}'
    options, _ = config.load(given)
    assert {k: options[k] for k in ("small_to_big", "chunk_char_limit", "default_top_k", "bm25_k1", "bm25_b", "dense_min_candidates")} == {"small_to_big": True, "chunk_char_limit": 600, "default_top_k": 5, "bm25_k1": 1.5, "bm25_b": 0.75, "dense_min_candidates": 200}
    assert options["extensions"] == config.DEFAULTS["extensions"] and options["exclude_dirs"] == config.DEFAULTS["exclude_dirs"] and options["rerank_candidates"] == 0
    assert config.effective(config.DEFAULTS, {"chunk_char_limit": "9"})["chunk_char_limit"] == 600


def test_each_advice(spark):
    """A set of hits for each rule, and the rule that it makes first or second."""
    hit = lambda lib="a", rel="x.md", title="", score=0.6, filled=False: (lib, rel, title, score, filled)
    cases = {
        "all_weak": ([hit(score=0.1), hit(rel="y.md", score=0.2)], {}), "single_strong": ([hit(score=0.9), hit(rel="y.md")], {}), "medium_only": ([hit(), hit(rel="y.md")], {}),
        "same_title": ([hit(score=0.9, title="Fuel"), hit(score=0.8, rel="old/x.md", title="fuel")], {}), "foreign_library": ([hit(score=0.8), hit(rel="y.md", lib="b", score=0.8)], {"defaults": ("a",)}),
        "many_strong": ([hit(rel=f"{i}.md", score=0.8) for i in range(3)], {}), "one_file": ([hit(score=0.8), hit(score=0.8), hit(rel="y.md", score=0.4)], {}),
        "office_files": ([hit(score=0.8, rel="a.PDF"), hit(score=0.8, rel="b.md")], {}), "backfilled": ([hit(score=0.8, filled=True), hit(score=0.8, rel="y.md")], {}),
        "list_mode": ([hit(score=0.8), hit(score=0.8, rel="y.md")], {"mode": "list"}), "few_hits": ([hit(score=0.8)], {}), "keyword_query": ([hit(score=0.8, rel=f"{i}.md") for i in range(2)] + [hit(score=0.4, rel="z.md")], {"query": "fuel pumps"}),
    }
    for name, (hits, options) in cases.items():
        frame = spark.createDataFrame([(*h, i + 1) for i, h in enumerate(hits)], "lib string, rel string, title string, score double, backfilled boolean, delivered int")
        found = delivery.advice(frame, options.pop("query", "how do pumps feed the chamber"), **options).select("advice", delivery.advice_text(F.col("advice")).alias("text")).first()
        assert name in found.advice, (name, found)
        assert len(found.text) == len(found.advice) and all(len(t) > 20 for t in found.text)
    assert set(cases) == set(delivery.ADVICE)


def test_docx():
    import io
    import zipfile

    from corpusloom.sources.docx import Docx

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("T", "Title") + p("text") + f"<w:tbl><w:tr>{cell('a|b')}{cell('c')}</w:tr><w:tr>{cell('')}{cell('')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + p("deep", "h4") + p("")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="h4"><w:name w:val="heading 4"/></w:style></w:styles>')
    assert Docx().pages("x.DOCX", buffer.getvalue()) == ["# T\n\ntext\n\n| a\\|b | c |\n|---|---|\n| 1 | 2 |\n\n### deep"]


def test_control():
    import pytest

    from corpusloom import control

    x = control.Library("l", "/p", options={"exclude_dirs": ["TEMP", "x"]})
    x.choose([("a\\b/", "in"), ("c", "in"), ("c", "out"), ("a/b", "in")])
    assert (x.selection_in, x.selection_out) == (["a/b"], ["c"])
    x.resolve_conflict("TEMP")
    assert x.options["exclude_dirs"] == ["x"] and "TEMP" in x.selection_in
    with pytest.raises(ValueError):
        x.choose([("../x", "in")])
    now, codes = [0.0], []
    gate = control.Gate(codes.append, lambda: now[0])
    number = gate.propose("l", "what")
    with pytest.raises(ValueError):
        gate.confirm("l", number, "no")
    assert gate.confirm("l", number, codes[0]) == "what"
    with pytest.raises(ValueError):
        gate.confirm("l", number, codes[0])
    number = gate.propose("l", "late")
    now[0] = 601
    with pytest.raises(ValueError):
        gate.confirm("l", number, codes[1])
    text = '{\n  // a "k": 1\n  "k": [1, 2], // tail\n  "s": "x,y"\n}'
    assert control.edit_setting(text, "k", [3]) == text.replace("[1, 2]", "[3]") and control.edit_setting(text, "s", "z") == text.replace('"x,y"', '"z"')


def test_settings_and_summaries():
    import pytest

    from corpusloom import control

    text = '{\n  // note\n  "bm25_k1": 2, // last "x": 1\n}'
    filled = control.backfill_settings(text, {"bm25_b": 0.5, "extensions": ["md"]})
    options, missing = config.load(filled)
    assert options["bm25_k1"] == 2.0 and options["bm25_b"] == 0.5 and options["extensions"] == ["md"] and "// note" in filled and not {"bm25_b", "extensions"} & set(missing)
    assert config.load(control.backfill_settings('{"bm25_k1": 2 // x,\n}', {"bm25_b": 0.5}))[0]["bm25_b"] == 0.5 and config.parse(control.backfill_settings("{}", {"a": 1})) == {"a": 1}
    assert control.edit_settings(filled, {"bm25_k1": 3, "bm25_b": 1}).count("3,") == 1
    with pytest.raises(KeyError):
        control.edit_settings(filled, {"bm25_k1": 3, "nothing": 1})
    assert control.read_summary('```\n"About  pumps."\n```') == "About pumps." and len(control.read_summary("word " * 100)) <= 300 and control.read_summary("First part. " * 40).endswith("part.")
    codes = []
    gate = control.Gate(codes.append)
    number = gate.propose("l", "x")
    for _ in range(control.WRONG_CODES):
        with pytest.raises(ValueError):
            gate.confirm("l", number, "wrong")
    with pytest.raises(ValueError, match="no such"):
        gate.confirm("l", number, codes[0])


def test_api(spark, tmp_path):
    from corpusloom.api import Engine

    vault, codes = tmp_path / "vault", []
    write(vault, fuel_md="# Fuel\n" + "Kerosene burns with oxygen. " * 30 + "\n## More\n[[soup]]", sub__soup_md="# Soup\nBoil water.", copy_md="# Soup\nBoil water.", bad_bin=b"%PDF")
    engine = Engine(spark, str(tmp_path / "index"), show_code=codes.append)
    engine.add_library("n", str(vault))
    assert engine.reindex_knowledge("n") == {"added": 4, "emptied": False}
    assert engine.reindex_knowledge("n") == {"same": 4, "emptied": False}
    assert engine.search_knowledge("kerosene oxygen", top_k=1).first().rel == "fuel.md"
    assert engine.note_relations("fuel", "n").first().outlinks == ["sub/soup.md"]
    assert engine.read_document("n", "SOUP").first().rel == "sub/soup.md"
    assert {r.rel for r in engine.find_duplicates("n").collect()} == {"copy.md", "sub/soup.md"}
    assert [(r.rel, r.reason) for r in engine.index_failures("n").collect()] == [("bad.pdf", "extract-failed")]
    assert engine.index_status().first().consistent and engine.get_library_sample("n", 2).count() == 2
    number = engine.propose_selection_changes("n", [("sub", "out")])
    assert engine.apply_selection_changes("n", number, codes[-1])["out"] == ["sub"]
    write(vault, new_md="fresh note", fuel_md="# Fuel\nshort")
    assert engine.reindex_knowledge("n") == {"added": 1, "changed": 1, "removed": 1, "same": 2, "emptied": False}
    assert engine.read_document("n", "soup").count() == 0 and engine.read_document("n", "new").first().text == "fresh note"
    number = engine.propose_library_summary("n", "Notes on fuel.")
    engine.apply_library_summary("n", number, codes[-1])
    assert engine.list_libraries().first().summary == "Notes on fuel."
    number = engine.suggest_library_summary("n", lambda prompt: f"'About {prompt.count('fuel.md')} file of fuel.'")
    engine.apply_library_summary("n", number, codes[-1], "model")
    assert engine.list_libraries().first().summary.endswith("file of fuel.")
    nodes, edges = engine.graph()
    assert nodes.count() == 4 and edges.count() == 0
    import shutil

    shutil.rmtree(vault)
    vault.mkdir()
    assert engine.reindex_knowledge("n")["emptied"] and engine.read_document("n", "new").count() == 1
    assert engine.staleness("n")["emptied"] and engine.staleness("n")["removed"] == 4
    vault.rmdir()
    assert engine.staleness("n") == {"missing": True, "emptied": False, "version_upgrade": False} and not engine.is_stale("n")
    assert engine.reindex_knowledge("n") == {"missing": True, "emptied": False} and engine.read_document("n", "new").count() == 1


def docx_bytes(text):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return buffer.getvalue()


class Pages:
    """Reads any file as pages of lines; broken ones raise."""

    signature = "pages"

    def pages(self, name, content):
        if content.startswith(b"broken"):
            raise ValueError(name)
        return content.decode().split("\f")


def test_extraction_in_the_index(spark, tmp_path):
    from corpusloom.api import Engine

    vault = tmp_path / "vault"
    write(vault, a_md="plain note")
    (vault / "w.docx").write_bytes(docx_bytes("from a word file"))
    (vault / "p.pdf").write_bytes(b"page one\x0cpage two")
    engine = Engine(spark, str(tmp_path / "index"))
    engine.add_library("n", str(vault))
    engine.reindex_knowledge("n")
    assert {r.rel: r.reason for r in engine.index_failures("n").collect()} == {"p.pdf": "extract-failed"}
    assert engine.search_knowledge("word file", top_k=1).first().rel == "w.docx"
    assert {n.rel: n.pipeline.mineru for n in engine.graph()[0].collect()} == {"a.md": "done", "w.docx": "done", "p.pdf": "failed"}
    # another extractor: what failed is tried again, and only that
    able = Engine(spark, str(tmp_path / "index"), extractor=Pages())
    assert able.changes("n").where("status = 'retry'").count() == 1
    assert able.reindex_knowledge("n") == {"retry": 1, "same": 2, "emptied": False}
    assert able.read_document("n", "p.pdf").first().text == "page one\n\npage two"
    assert able.tables.read("extractions").where("route = 'pages'").count() == 1
    assert able.failure_overview().first().asDict() == {"lib": "n", "healthy": 3, "failed": 0}
    assert able.preview(str(vault / "p.pdf"))["text"] == "page one\n\npage two" and able.preview(str(vault / "a.md"))["route"] == "text"


class Service(Pages):
    """A service that takes its time: the first request for a file only queues it."""

    signature = "service"
    queued: set = set()

    def pages(self, name, content):
        import pathlib

        mark = pathlib.Path(content.decode().split("\x0c")[0])
        if not mark.exists():
            mark.touch()
            raise Deferred(name)
        return ["Report 7", "body of the report", "Report 7"]

    def sidecar(self, name, content):
        return '[{"type": "header", "text": " Report 7 "}, {"type": "text", "text": "body of the report"}]'


def test_deferred_files_and_sidecars(spark, tmp_path):
    from corpusloom.api import CHUNKS, Engine

    vault = tmp_path / "vault"
    write(vault, a_md="plain note")
    (vault / "scan.pdf").write_bytes(f"{tmp_path / 'mark'}\x0cx".encode())
    engine = Engine(spark, str(tmp_path / "index"), extractor=Service())
    engine.add_library("n", str(vault))
    assert engine.reindex_knowledge("n") == {"added": 2, "deferred": 1, "emptied": False}
    assert engine.index_failures("n").count() == 0 and engine.tables.read("file_meta").count() == 1
    assert engine.reindex_knowledge("n") == {"added": 1, "same": 1, "emptied": False}
    assert engine.read_document("n", "scan.pdf").first().text.count("Report 7") == 2  # as it was read
    assert [r.body for r in engine.tables.read("chunks", CHUNKS).where("rel = 'scan.pdf'").collect()] == ["\nbody of the report"]  # page furniture is gone
    assert engine.reindex_knowledge("n") == {"same": 2, "emptied": False}


def test_formats_versions_and_healing(spark, tmp_path, monkeypatch):
    from corpusloom.api import CHUNKS, Engine

    vault = tmp_path / "vault"
    write(vault, a_md="one note", b_md="another note")
    (vault / "w.docx").write_bytes(docx_bytes("word"))
    engine = Engine(spark, str(tmp_path / "index"))
    engine.add_library("n", str(vault))
    assert engine.reindex_knowledge("n", approved=()) == {"added": 2, "emptied": False}  # the Word file waits for approval
    assert engine.reindex_knowledge("n", approved=("docx",)) == {"added": 1, "same": 2, "emptied": False}
    (vault / "w.docx").write_bytes(docx_bytes("changed words"))
    assert engine.reindex_knowledge("n", approved=()) == {"same": 2, "emptied": False} and engine.read_document("n", "w.docx").first().text == "word"
    # pieces are lost: the next run builds anew
    broken = engine.tables.read("chunks", CHUNKS, "n").where("rel <> 'a.md'")
    engine.tables.commit({"chunks": {"n": spark.createDataFrame(broken.collect(), broken.schema)}})
    assert not engine.index_status().first().consistent
    assert engine.reindex_knowledge("n")["changed"] == 3 and engine.index_status().first().consistent
    monkeypatch.setattr(ingest, "META_VERSION", ingest.META_VERSION + 1)
    assert engine.is_stale("n") and engine.reindex_knowledge("n")["changed"] == 3 and not engine.is_stale("n")


def test_only_suspects_are_read(spark, tmp_path, monkeypatch):
    from corpusloom.api import Engine

    vault, reads = tmp_path / "vault", []
    write(vault, a_md="one note", b_md="another note")
    engine = Engine(spark, str(tmp_path / "index"))
    engine.add_library("n", str(vault))
    engine.reindex_knowledge("n")
    real = files.read
    monkeypatch.setattr(files, "read", lambda s, root, lib, only=None: (reads.append(only), real(s, root, lib, only))[1])
    write(vault, b_md="another note, changed")
    assert engine.reindex_knowledge("n") == {"changed": 1, "same": 1, "emptied": False}
    assert [[p.rsplit("/", 1)[1] for p in r] for r in reads] == [["b.md"]]
    import os

    os.utime(vault / "a.md", (1, 1))  # touched, not changed: read once, then known by its new time
    assert engine.changes("n").where("status <> 'same'").count() == 0 and engine.is_stale("n")


def test_refresh_garbage_and_import(spark, tmp_path):
    from corpusloom.api import Engine

    vault, other = tmp_path / "vault", tmp_path / "other"
    write(vault, a_md="kerosene pumps")
    write(other, o_md="sea water")
    engine = Engine(spark, str(tmp_path / "index"))
    engine.add_library("n", str(vault))
    engine.add_library("o", str(other))
    engine.reindex_knowledge("o")
    assert engine.search_knowledge("kerosene", libraries=("n",), refresh=True).first().rel == "a.md"  # nothing was there: built at once
    assert engine.ensure_fresh("n") == "fresh"
    write(vault, b_md="oxygen tanks")
    assert engine.ensure_fresh("n") == "started"
    engine._refreshing["n"].join()
    assert engine.ensure_fresh("n") == "fresh" and engine.search_knowledge("oxygen", libraries=("n",)).first().rel == "b.md"
    engine.remove_library("o")
    assert engine.collect_garbage()["parts"] == 8 and engine.tables.read("file_meta").select("lib").distinct().count() == 1
    assert engine.collect_garbage() == {"parts": 0, "extractions": 0}
    # vectors from a package: all or nothing
    vectors = engine.tables.read("vectors", part="n").selectExpr("concat_ws('::', rel, chunk) AS id", "'t' AS text", "transform(vec, x -> double(-x)) AS embedding", "map('a', 'b') AS meta")
    held = spark.createDataFrame([("x", bytearray(b"one"))], "rel string, content binary")
    package.export(vectors, held, str(tmp_path / "pack"))
    assert engine.import_package("n", str(tmp_path / "pack")) == {"expected": 2, "written": 2, "imported": True}
    package.export(vectors.unionByName(vectors.limit(1).withColumn("id", F.lit("gone::0"))), held, str(tmp_path / "worse"))
    assert engine.import_package("n", str(tmp_path / "worse")) == {"expected": 3, "written": 2, "imported": False}
    assert "2 documents compared" in engine.duplicate_report("n")
    assert engine.graph_counts().first().asDict() == {"lib": "n", "nodes": 2, "edges": 0}


def test_page_index(spark, tmp_path):
    from corpusloom.api import Engine

    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "a.pdf").write_bytes(b"pumps\x0ctanks")
    (vault / "b.pdf").write_bytes(b"broken")
    engine = Engine(spark, str(tmp_path / "index"))
    engine.add_library("n", str(vault))
    assert engine.index_pages("n", Pages(), "v1") == {"rendered": 1, "failed": 1, "removed": 0}
    assert engine.index_pages("n", Pages(), "v1") == {"rendered": 0, "failed": 0, "removed": 0}
    assert engine.index_pages("n", Pages(), "v2") == {"rendered": 0, "failed": 1, "removed": 0}
    hit = engine.navigate_knowledge("tanks", top_k=1).first()
    assert (hit.rel, hit.page) == ("a.pdf", 2)
    assert engine.page_status().first().asDict() == {"lib": "n", "files": 1, "pages": 2, "failed": 1}
    (vault / "a.pdf").unlink()
    assert engine.index_pages("n", Pages(), "v2") == {"rendered": 0, "failed": 0, "removed": 1} and engine.tables.read("page_vectors").count() == 0


def test_tables(spark, tmp_path):
    import pytest

    from corpusloom.tables import Tables

    t = Tables(spark, str(tmp_path / "t"), hours=0)
    row = lambda *x: spark.createDataFrame([x], "k string, v int")
    t.commit({"a": {"p": row("p", 1), "q": row("q", 1)}, "b": {"p": row("b", 1)}})
    kept = t.current()["a"]["q"]
    t.commit({"a": {"p": row("p", 2)}})
    assert t.current()["a"]["q"] == kept and sorted(map(tuple, t.read("a").collect())) == [("p", 2), ("q", 1)]
    assert t.read("a", part="q").first().v == 1 and t.read("c", "x int").count() == 0
    with pytest.raises(FileNotFoundError):
        t.read("c")
    for v in (3, 4):
        t.commit({"a": {"p": row("p", v), "q": None}})
    assert len(t.versions()) == 2 and len(list((tmp_path / "t" / "a").iterdir())) == 2 and t.read("b").count() == 1
    (tmp_path / "t" / "manifest" / ".dead").write_text("{}")
    (tmp_path / "t" / "a" / "left-over").mkdir()
    assert t.sweep_drafts() == 0 and t.sweep_drafts(hours=-1) == 2 and t.read("a").count() == 1


def test_small_things(spark, tmp_path):
    from corpusloom.operators import diagnostics
    from corpusloom.sources import files

    (tmp_path / "log").write_text("".join(f"line {i} {'x.md' if i % 3 == 0 else ''}\n" for i in range(5000)))
    assert [r.line for r in files.log_lines(spark, str(tmp_path / "log"), "x.md").collect()] == [f"line {i} x.md" for i in (4992, 4995, 4998)]
    assert diagnostics.progress_text({"running": True, "phase": "embed", "library": "n", "done": 1, "total": 4}) == "running; phase embed; library n; 1 of 4 (25 %)"
    cached = spark.createDataFrame([("h", "local", 1, "t"), ("h", "ocr:mineru-cloud", 1, "better")], "hash string, route string, version int, markdown string")
    wanted = spark.createDataFrame([("h", "p"), ("g", "q")], "hash string, path string")
    assert {r.hash: (r.markdown, r.reason) for r in extraction.read_cached(wanted, cached).collect()} == {"h": ("better", None), "g": (None, "not-cached")}
    jobs = spark.createDataFrame([("p", "h", 7), ("q", "old", 8)], "path string, hash string, job int")
    assert [r.job for r in extraction.resume(jobs, wanted).collect()] == [7] and [r.job for r in ingest.live_jobs(jobs, wanted).collect()] == [7]
    old = spark.sql("SELECT 'a' AS f, timestamp'2024-01-01 00:00:00' AS m UNION ALL SELECT 'b', timestamp'2024-01-02 12:00:00'")
    assert [r.f for r in diagnostics.older_than(old, "m", F.lit("2024-01-03").cast("timestamp")).collect()] == ["a"]
