"""Live states of jobs, from a stream of their reports: running, stalled or done.

A report is (job, done, total, running). For each job a keyed state keeps how far it was and when that last
changed; a timer is set at each advance. A job that reports the same again, or nothing at all, is stalled
when its timer ends, without another event. What ends is forgotten. State and timers are Spark's: they
live in the checkpoint and outlive a restart; a job's own rows never gather.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.diagnostics import STALL_TIMEOUT

REPORT = "job string, done long, total long, running boolean"
STATES = "job string, state string, done long, total long, quiet double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watch(StatefulProcessor):
    """quiet: seconds without an advance after which a job is stalled."""

    def __init__(self, quiet: float):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "done long, total long, moved long")

    def _timer(self, at: int | None) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, running, furthest, total = timerValues.getCurrentProcessingTimeInMs(), True, -1, 0
        for r in rows:  # of one batch; only the furthest is kept
            if (r.done or 0) >= furthest:
                furthest, total = r.done or 0, r.total or 0
            running = running and r.running is not False
        if not running:
            self._timer(None)
            self.seen.clear()
            yield Row(job=key[0], state="done", done=furthest, total=total, quiet=0.0)
            return
        done, _, moved = self.seen.get() if self.seen.exists() else (None, None, now)
        if done is None or furthest > done:
            done, moved = furthest, now
            self._timer(now + int(self.quiet * 1000))
        self.seen.update((done, total, moved))
        quiet = (now - moved) / 1000
        yield Row(job=key[0], state="stalled" if quiet >= self.quiet else "running", done=done, total=total, quiet=quiet)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.seen.exists():
            done, total, moved = self.seen.get()
            yield Row(job=key[0], state="stalled", done=done, total=total, quiet=(timerValues.getCurrentProcessingTimeInMs() - moved) / 1000)

    def close(self) -> None:
        pass


def states(reports: DataFrame, quiet: float = STALL_TIMEOUT) -> DataFrame:
    """A stream of (job, state, done, total, quiet): a row for each job that reports in a batch, and one when
    it stalls. reports: a stream of (job, done, total, running)."""
    reports.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # timers need it
    return reports.groupBy("job").transformWithState(Watch(quiet), STATES, "Update", "ProcessingTime")


def report_files(spark: SparkSession, path: str) -> DataFrame:
    """Reports from a folder of JSON lines, as jobs append them."""
    return spark.readStream.schema(REPORT).json(path)


def task_progress(spark: SparkSession, group: str) -> dict[str, int]:
    """Tasks of the Spark jobs that run under a job group just now: done and total. For a run of this
    application, which needs no reports."""
    tracker, done, total = spark.sparkContext.statusTracker(), 0, 0
    active = set(tracker.getActiveJobsIds())
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job) if job in active else None
        for stage in (tracker.getStageInfo(s) for s in info.stageIds) if info else ():
            if stage:
                done, total = done + stage.numCompletedTasks, total + stage.numTasks
    return {"done": done, "total": total}
