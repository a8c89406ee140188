"""Packages of libraries as a data source: zip files of compressed JSON lines, with digests.

    spark.dataSource.register(Bundle)
    rows.write.format("corpusloom_bundle").mode("append").save(path)      # rows: table, json
    spark.read.format("corpusloom_bundle").load(path)

A task writes a zip file of its own with a member for each table, and counts and digests go to
manifest.json when all are written; so a failed task leaves nothing that a reader sees, and equal rows in
equal partitions give equal bytes. A reader's task reads a zip file: a member whose name leaves the
folder, that the manifest doesn't name, or whose digest differs, fails the read. Files are reached through
pyarrow's file systems, by the path's scheme.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "table string, json string"
MANIFEST = "manifest.json"
_PIECE = 1 << 20


class Unsound(RuntimeError):
    """A package that is damaged, or that would write outside its folder."""


def is_safe(name: str) -> bool:
    """Whether a member's name stays inside the folder (as package.safe_member)."""
    return bool(name) and not re.match(r"[/\\]|[A-Za-z]:", name) and ".." not in name.replace("\\", "/").split("/")


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


class _Hashed(io.RawIOBase):
    """Writes on, and keeps the digest and size of what was written."""

    def __init__(self, out):
        self.out, self.digest, self.size = out, hashlib.sha256(), 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.digest.update(data)
        self.size += len(data)
        return self.out.write(data)


@dataclass
class Written(WriterCommitMessage):
    part: str
    members: list[dict]


@dataclass
class Part(InputPartition):
    name: str
    members: list[dict]


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        """Rows come sorted by table."""
        files, base = _place(self.path)
        files.create_dir(base, recursive=True)
        name, members = f"part-{uuid.uuid4().hex}.zip", []
        with files.open_output_stream(f"{base}/{name}") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as packed:
            table = opened = lines = hashed = None
            rows = 0

            def close() -> None:
                if table is not None:
                    lines.close()
                    opened.close()
                    members.append({"name": f"payload/{table}.jsonl.gz", "sha256": hashed.digest.hexdigest(), "size": hashed.size, "rows": rows})

            for row in iterator:
                if row.table != table:
                    close()
                    table, rows = row.table, 0
                    opened = packed.open(zipfile.ZipInfo(f"payload/{table}.jsonl.gz"), "w", force_zip64=True)
                    hashed = _Hashed(opened)
                    lines = gzip.GzipFile(fileobj=hashed, mode="wb", filename="", mtime=0)
                lines.write(row.json.encode() + b"\n")
                rows += 1
            close()
        return Written(name, members)

    def commit(self, messages) -> None:
        files, base = _place(self.path)
        parts = sorted(({"part": m.part, "members": m.members} for m in messages if m is not None and m.members), key=lambda p: [m["sha256"] for m in p["members"]])
        with files.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps({"format": 1, "parts": parts}, indent=1).encode())

    def abort(self, messages) -> None:
        files, base = _place(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{base}/{m.part}")


def manifest(path: str) -> dict:
    files, base = _place(path)
    with files.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        found = [Part(p["part"], p["members"]) for p in manifest(self.path)["parts"]]
        for p in found:
            if not is_safe(p.name) or "/" in p.name:
                raise Unsound(f"the manifest names {p.name}")
        return found or [Part("", [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.name:
            return
        files, base = _place(self.path)
        known = {m["name"]: m for m in partition.members}
        with files.open_input_file(f"{base}/{partition.name}") as raw, zipfile.ZipFile(raw) as packed:
            names = packed.namelist()
            for name in [*names, *known]:
                if not is_safe(name):
                    raise Unsound(f"{partition.name} has a member {name!r} that leaves the folder")
            if sorted(names) != sorted(known):
                raise Unsound(f"{partition.name} has members {sorted(names)}, the manifest {sorted(known)}")
            for name in names:
                digest, size = hashlib.sha256(), 0
                try:
                    with packed.open(name) as member:
                        while piece := member.read(_PIECE):
                            digest.update(piece)
                            size += len(piece)
                except zipfile.BadZipFile as e:
                    raise Unsound(f"{name} of {partition.name} is damaged") from e
                if (digest.hexdigest(), size) != (known[name]["sha256"], known[name]["size"]):
                    raise Unsound(f"{name} of {partition.name} differs from the manifest")
            for name in names:
                table = name.removeprefix("payload/").removesuffix(".jsonl.gz")
                with packed.open(name) as member, gzip.GzipFile(fileobj=member) as lines:
                    for line in lines:
                        yield table, line.decode().rstrip("\n")


class Bundle(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpusloom_bundle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])
