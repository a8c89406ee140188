"""Packages: export, deletion, import, equal searches; damaged and escaping members."""

import json
import zipfile

import pytest

from corpusloom.api import Engine
from corpusloom.sources import bundle


def test_round_trip(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    for i in range(12):
        (vault / f"n{i}.md").write_text(f"# Note {i}\nword{i} pumps “é” [[n{i + 1}]]\n" + ("salt water. " * 20 * (i % 4)))
    engine = Engine(spark, str(tmp_path / "index"))
    engine.add_library("n", str(vault))
    engine.reindex_knowledge("n")
    found = lambda e, lib: [[tuple(r) for r in e.search_knowledge(q, top_k=6, libraries=(lib,)).select("rel", "hp", "score", "text", "total").collect()] for q in ("pumps word3", "salt")]
    before = found(engine, "n")
    pack = str(tmp_path / "pack")
    counts = engine.export_library("n", pack)
    assert counts["file_meta"] == 12 and counts["chunks"] == counts["vectors"] >= 12
    engine.remove_library("n")
    engine.add_library("keep", str(tmp_path))
    engine.collect_garbage()
    assert engine.tables.read("chunks", "lib string").where("lib = 'n'").isEmpty()
    engine.add_library("m", str(vault))
    done = engine.import_library("m", pack)
    assert done == {"expected": counts, "written": counts, "imported": True} and found(engine, "m") == before
    assert not engine.is_stale("m") and {r.lib for r in engine.tables.read("vectors").select("lib").collect()} == {"m"}
    # equal rows give equal members
    engine.export_library("m", str(tmp_path / "again"))
    digests = lambda p: sorted(m["name"] for x in bundle.manifest(p)["parts"] for m in x["members"])
    assert digests(pack) == digests(str(tmp_path / "again"))
    part = next((tmp_path / "pack").glob("*.zip"))
    whole = part.read_bytes()
    for damaged in (whole[: len(whole) // 2], whole[:200] + bytes([whole[200] ^ 1]) + whole[201:]):
        part.write_bytes(damaged)
        with pytest.raises(Exception):
            engine.import_library("m", pack)
    assert found(engine, "m") == before


def test_escaping_members(tmp_path):
    for name in ("../x.jsonl.gz", "/etc/x", "C:\\x", "a/../../x", ""):
        assert not bundle.is_safe(name)
    assert bundle.is_safe("payload/chunks.jsonl.gz") and bundle.is_safe("a..b/c")
    with zipfile.ZipFile(tmp_path / "part-1.zip", "w") as z:
        z.writestr("../evil.jsonl.gz", b"x")
    member = {"name": "../evil.jsonl.gz", "sha256": "", "size": 1, "rows": 1}
    (tmp_path / "manifest.json").write_text(json.dumps({"format": 1, "parts": [{"part": "part-1.zip", "members": [member]}]}))
    reader = bundle.Reader(str(tmp_path))
    with pytest.raises(bundle.Unsound, match="leaves the folder"):
        list(reader.read(reader.partitions()[0]))
    (tmp_path / "manifest.json").write_text(json.dumps({"format": 1, "parts": [{"part": "../part-1.zip", "members": []}]}))
    with pytest.raises(bundle.Unsound):
        reader.partitions()
