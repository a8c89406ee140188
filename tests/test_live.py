"""A job that goes silent is stalled without another event; one that ends is forgotten; progress of an index run."""

import json
import threading
import time

from corpusloom.api import Engine
from corpusloom.streaming import live


def test_a_silent_job_stalls(spark, tmp_path):
    source = tmp_path / "reports"
    source.mkdir()
    numbers = iter(range(100))

    def report(*rows):
        path = source / f"r{next(numbers)}.json"
        (tmp_path / "draft").write_text("".join(json.dumps(dict(zip(("job", "done", "total", "running"), r))) + "\n" for r in rows))
        (tmp_path / "draft").rename(path)

    report(("a", 1, 10, True), ("b", 5, 5, False), ("c", 0, 3, True))
    seen = live.states(live.report_files(spark, str(source)), quiet=4)
    run = seen.writeStream.outputMode("update").queryName("live_states").format("memory").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    of = lambda job: [(r.state, r.done) for r in spark.table("live_states").where(f"job = '{job}'").collect()]

    def wait(what):
        until = time.time() + 90
        while not what() and time.time() < until and run.isActive:
            time.sleep(0.5)
        assert what(), (of("a"), of("b"), of("c"), run.exception())

    try:
        wait(lambda: ("stalled", 1) in of("a"))  # nothing has come since
        assert of("a")[0] == ("running", 1) and of("b") == [("done", 5)] and ("stalled", 0) in of("c")
        report(("a", 2, 10, True))
        wait(lambda: ("running", 2) in of("a"))
        report(("a", 2, 10, True))  # it speaks, but doesn't move
        wait(lambda: ("stalled", 2) in of("a"))
        report(("c", 3, 3, False))
        wait(lambda: ("done", 3) in of("c"))
    finally:
        run.stop()


def test_progress_of_an_index_run(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    for i in range(40):
        (vault / f"n{i}.md").write_text(f"# Note {i}\n" + "salt water. " * 50)
    engine = Engine(spark, str(tmp_path / "index"))
    engine.add_library("n", str(vault))
    assert engine.index_progress("n") == {"library": "n", "running": False, "phase": "idle", "done": 0, "total": 0, "tasks": 0, "tasks_total": 0}
    thread = threading.Thread(target=engine.reindex_knowledge, args=("n",))
    thread.start()
    seen = []
    while thread.is_alive():
        seen.append(engine.index_progress("n"))
        time.sleep(0.05)
    phases = list(dict.fromkeys(p["phase"] for p in seen if p["running"]))
    assert {"listing", "chunking", "writing"} <= set(phases) and any(p["total"] == 40 for p in seen)
    assert any(p["tasks_total"] for p in seen) and all(p["done"] <= p["total"] for p in seen)
    done = engine.index_progress("n")
    assert not done["running"] and done["phase"] == "done" and done["done"] == done["total"] == 40
