"""Once per job on a stream, by keyed state: what a micro-batch reads is the state of its own jobs, however long the history is."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glyphflow.settings import QUEUED, Settings


class Submitted(StatefulProcessor):
    """Remembers that a job is known."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "known boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = min(part["ts"].min() for part in rows)
        if not self.known.exists():
            self.known.update((True,))
            yield pd.DataFrame({"job_id": [key[0]], "ts": [first]})

    def close(self) -> None:
        pass


def stream_submitted_once(submissions: DataFrame) -> DataFrame:
    """The first submission (job_id, ts) of each job of a stream, also when it is submitted again after any time.

    State is one flag per job, for good; a job's earliest time counts within its first micro-batch.
    """
    return submissions.select("job_id", "ts").groupBy("job_id").transformWithStateInPandas(Submitted(), "job_id string, ts timestamp", "Append", "None")


class FixedExpiry(StatefulProcessor):
    """Creation of a job and whether its end has been reported; a timer at the end of its life."""

    def __init__(self, ttl_hours: int):
        self.ttl_ms = timedelta(hours=ttl_hours) // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "created_ms long, reported boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = min(int(part["ms"].min()) for part in rows)
        created, reported = self.job.get() if self.job.exists() else (None, False)
        if not reported and (created is None or first < created):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.job.update((first, False))
            self.handle.registerTimer(first + self.ttl_ms)
        yield pd.DataFrame({"job_id": pd.Series(dtype=str), "created_ms": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        created, _ = self.job.get()
        self.job.update((created, True))
        yield pd.DataFrame({"job_id": [key[0]], "created_ms": [created]})

    def close(self) -> None:
        pass


def stream_fixed_expiry(events: DataFrame, settings: Settings, delay: str = "10 minutes") -> DataFrame:
    """Rows (job_id, created_at, expired_at), once for each job whose time to live from creation the watermark has passed.

    Time is that of creations; they count in milliseconds. A job that is
    reported is not reported again.
    """
    queued = events.where(F.col("kind") == QUEUED).select("job_id", "ts", F.unix_millis("ts").alias("ms"))
    ended = queued.withWatermark("ts", delay).groupBy("job_id").transformWithStateInPandas(
        FixedExpiry(settings.job_ttl_hours), "job_id string, created_ms long", "Append", "EventTime")
    created = F.timestamp_millis("created_ms")
    return ended.select("job_id", created.alias("created_at"), (created + F.expr(f"INTERVAL '{settings.job_ttl_hours}' HOUR")).alias("expired_at"))
