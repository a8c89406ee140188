"""A service that throttles, fails, and whose worker dies in the middle: no file is submitted twice."""

import os
from pathlib import Path

import pytest

from corpusloom.sources.ledger import Ledger, Refused
from corpusloom.tables import Tables


class Fake:
    """A service in a folder: a file for each job, a line for each submission."""

    name = "ocr"

    def __init__(self, folder):
        self.folder = str(folder)

    def _count(self, name):
        path = Path(self.folder, name)
        n = int(path.read_text()) if path.exists() else 0
        path.write_text(str(n + 1))
        return n

    def submit(self, token, path):
        if path == "busy" and self._count("busy.n") < 1:
            raise Refused("429", 30)
        if path == "broken":
            raise Refused("-60002")
        if path == "flaky":
            raise Refused("500")
        with open(Path(self.folder, f"job-{token}"), "x") as f:  # a second submission would fail
            f.write(path)
        with open(Path(self.folder, "submitted"), "a") as f:
            f.write(path + "\n")
        if path == "dies" and self._count("dies.n") < 1:
            raise SystemError("the worker dies after the service took the job")
        return f"job-{token}"

    def find(self, token):
        return f"job-{token}" if Path(self.folder, f"job-{token}").exists() else None

    def poll(self, job):
        path = Path(self.folder, job).read_text()
        return None if path == "slow" and self._count("slow.n") < 1 else f"text of {path}"


def test_no_file_is_submitted_twice(spark, tmp_path):
    os.makedirs(tmp_path / "service")
    ledger = Ledger(Tables(spark, str(tmp_path / "tables")), Fake(tmp_path / "service"), limit=4, tries=2)
    names = ["a", "b", "broken", "busy", "dies", "flaky", "slow"]
    files = spark.createDataFrame([(n, f"h{n}") for n in names], "path string, hash string").coalesce(1)
    assert ledger.enqueue(files, 0.0) == 7 and ledger.enqueue(files, 1.0) == 0
    first = ledger.step(10.0)  # a, b, broken, busy: what the window admits
    assert first == {"done": 2, "failed": 1, "waiting": 4}
    assert ledger.step(20.0) == first  # the window is full
    with pytest.raises(Exception):
        ledger.step(71.0)  # busy, dies, flaky, slow: the run dies when the service has one of them
    assert {r.path for r in ledger.rows().where("state = 'submitting'").collect()} == {"busy", "dies", "flaky", "slow"}
    again = Ledger(Tables(spark, str(tmp_path / "tables")), Fake(tmp_path / "service"), limit=4, tries=2)
    now = 72.0
    for _ in range(8):
        counts = again.step(now)
        now += 70
    assert counts == {"done": 5, "failed": 2}
    rows = {r.path: r for r in again.rows().collect()}
    assert rows["dies"].text == "text of dies" and rows["slow"].text == "text of slow" and rows["busy"].state == "done"
    assert (rows["broken"].reason, rows["flaky"].reason, rows["flaky"].tries >= 2) == ("-60002", "500", True)
    submitted = (tmp_path / "service" / "submitted").read_text().split()
    assert sorted(submitted) == ["a", "b", "busy", "dies", "slow"]
    changed = spark.createDataFrame([("a", "new"), ("b", "hb")], "path string, hash string")
    assert again.prune(changed) == 6 and again.enqueue(changed, now) == 1
    assert {(r.path, r.hash, r.state) for r in again.rows().collect()} == {("a", "new", "waiting"), ("b", "hb", "done")}
