"""A ledger of jobs at a recognition service: each file is submitted once, whatever dies in between.

A file is known by (path, hash); its token is their digest. Before a submission the ledger commits that it is
under way; after it, the job's number. Rows that are found under way at the next step (the run died, or
a task was tried again) are looked up at the service by their token before anything is submitted again.
Submissions are admitted by a sliding window: no more than ``limit`` in the last ``window`` seconds, counted
in the ledger. A service that asks to wait is waited for; other errors are tried again with growing
delays, ``tries`` times, or end the job, by their class; a wrong key ends the step.

Calls run in tasks, rows and states are a table of segments, so a step writes what has moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from ..streaming.ingest import error_class, retry_delay
from ..tables import Change, Tables

TABLE = "jobs"
KEY = ("service", "path", "hash")
ROWS = "service string, path string, hash string, state string, job string, tries int, due double, submitted double, reason string, text string"
WINDOW, LIMIT, TRIES = 60.0, 50, 4


class Refused(Exception):
    """The service's error: its code, and after how many seconds it wants to be asked again (0: not said)."""

    def __init__(self, code: str = "", retry_after: float = 0.0):
        super().__init__(code)
        self.code, self.retry_after = code, retry_after


class Service(Protocol):
    """Pickled to the tasks."""

    name: str

    def submit(self, token: str, path: str) -> str: ...  # the job; may raise Refused

    def find(self, token: str) -> str | None: ...  # the job of a token, if it was submitted

    def poll(self, job: str) -> str | None: ...  # the text, None while it runs; may raise Refused


def token(path: Column, hash: Column) -> Column:
    return F.sha2(F.concat_ws("\n", path, hash), 256)


class Ledger:
    def __init__(self, tables: Tables, service: Service, limit: int = LIMIT, window: float = WINDOW, tries: int = TRIES):
        self.tables, self.service, self.limit, self.window, self.tries = tables, service, limit, window, tries
        tables.keys = {**tables.keys, TABLE: KEY}

    def rows(self) -> DataFrame:
        return self.tables.read(TABLE, ROWS, self.service.name)

    def _commit(self, rows: DataFrame | None, gone: DataFrame) -> None:
        self.tables.commit({TABLE: {self.service.name: Change(rows.select(*(c.split()[0] for c in ROWS.split(", "))) if rows is not None else None, gone.select(*KEY))}})

    def enqueue(self, files: DataFrame, now: float) -> int:
        """files: path, hash. Those that the ledger has in this content are not asked for again."""
        new = files.select("path", "hash").distinct().join(self.rows().select("path", "hash"), ["path", "hash"], "left_anti")
        none = lambda kind: F.lit(None).cast(kind)
        rows = new.select(F.lit(self.service.name).alias("service"), "path", "hash", F.lit("waiting").alias("state"), none("string").alias("job"), F.lit(0).alias("tries"), F.lit(now).alias("due"), none("double").alias("submitted"), none("string").alias("reason"), none("string").alias("text"))
        rows = materialise(rows, "jobs-new")
        if n := rows.count():
            self._commit(rows, rows)
        return n

    def prune(self, files: DataFrame) -> int:
        """Jobs of files that are gone, or have another content, are forgotten."""
        gone = materialise(self.rows().join(files.select("path", "hash"), ["path", "hash"], "left_anti"), "jobs-gone")
        if n := gone.count():
            self._commit(None, gone)
        return n

    def _called(self, rows: DataFrame, call: str) -> DataFrame:
        """rows with job, text, code and after: what the service answered."""
        service = self.service

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    job, text, code, after = r.job, None, None, 0.0
                    try:
                        if call == "submit":
                            job = service.find(r.token) or service.submit(r.token, r.path)
                        elif call == "find":
                            job = service.find(r.token)
                        else:
                            text = service.poll(r.job)
                    except Refused as e:
                        code, after = e.code, e.retry_after
                    out.append((r.path, r.hash, job, text, code, after))
                yield pd.DataFrame(out, columns=["path", "hash", "job", "text", "code", "after"])

        asked = rows.select("path", "hash", "job", token(F.col("path"), F.col("hash")).alias("token"))
        answers = asked.mapInPandas(run, "path string, hash string, job string, text string, code string, after double")
        return rows.drop("job", "text").join(materialise(answers, "jobs-answers"), ["path", "hash"])

    def _after_error(self, now: float) -> tuple[Column, Column]:
        """state and due of a row whose call was refused."""
        ends = (error_class(F.col("code")) != "transient") | ((F.col("after") <= 0) & (F.col("tries") >= self.tries))
        jitter = F.pmod(F.xxhash64("path", "tries"), F.lit(1000)) / 1000
        return F.when(ends, "failed"), F.lit(now) + retry_delay(F.col("tries"), jitter, F.col("after"))

    def step(self, now: float) -> dict[str, int]:
        """Resolves what is under way, submits what the window admits, polls what runs. Numbers of rows by state."""
        unsure = materialise(self.rows().where("state = 'submitting'"), "jobs-unsure")
        if not unsure.isEmpty():
            found = self._called(unsure, "find").withColumn("state", F.when(F.col("job").isNotNull(), "polling").otherwise("waiting"))
            self._commit(materialise(found, "jobs-found"), unsure)
        rows = self.rows()
        recent = rows.where(F.col("submitted") > now - self.window).count()
        ready = rows.where((F.col("state") == "waiting") & (F.col("due") <= now)).orderBy("due", "path", "hash").limit(max(0, self.limit - recent))
        ready = materialise(ready.withColumns({"state": F.lit("submitting"), "submitted": F.lit(now), "tries": F.col("tries") + 1}), "jobs-ready")
        if not ready.isEmpty():
            self._commit(ready, ready)  # from here on a run that dies leaves rows that are looked up first
            ended, due = self._after_error(now)
            answered = self._called(ready, "submit").withColumns({"state": F.when(F.col("code").isNull(), "polling").otherwise(F.coalesce(ended, F.lit("waiting"))), "due": F.when(F.col("code").isNotNull(), due).otherwise(F.col("due")), "reason": F.col("code")})
            self._commit(materialise(answered, "jobs-answered"), ready)
        running = materialise(self.rows().where("state = 'polling'"), "jobs-running")
        if not running.isEmpty():
            ended, _ = self._after_error(now)
            polled = self._called(running, "poll").withColumns({"state": F.when(F.col("text").isNotNull(), "done").when(F.col("code").isNotNull(), F.coalesce(ended, F.lit("polling"))).otherwise("polling"), "reason": F.col("code")})
            moved = materialise(polled.where("state <> 'polling'"), "jobs-moved")
            if not moved.isEmpty():
                self._commit(moved, moved)
        return {r["state"]: r["count"] for r in self.rows().groupBy("state").count().collect()}  # five states
