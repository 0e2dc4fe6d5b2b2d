"""Job state on a stream with an end: illegal steps are turned away on arrival, and a job's state goes when its time to live is over."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glyphflow.settings import JOB_STATES, LEGAL_TRANSITIONS, Settings

EXPIRED = "expired"
STATE = "status string, created_us long"
OUT = "job_id string, seq long, kind string, status string, accepted boolean"


class Lifecycle(StatefulProcessor):
    """One state per living job: its status and creation time. A timer at the end of its life removes it."""

    def __init__(self, ttl_hours: int):
        self.ttl = timedelta(hours=ttl_hours) // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values("seq")
        status, created = self.state.get() if self.state.exists() else ("", None)
        started_with = created
        out = []
        for seq, us, kind in zip(events["seq"].tolist(), events["us"].tolist(), events["kind"].tolist(), strict=True):
            # Life ends by event time, wherever the input is cut.
            if created is not None and us - created > self.ttl:
                out.append((key[0], None, EXPIRED, EXPIRED, True))
                status, created = "", None
            legal = (status, kind) in LEGAL_TRANSITIONS
            if legal:
                created = us if created is None else created
                status = kind
            out.append((key[0], seq, kind, status, legal))
        if created != started_with:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if created is not None:
                # Timers count in milliseconds; the last one within the life is still alive.
                self.handle.registerTimer((created + self.ttl) // 1000 + 1)
        if created is None:
            self.state.clear()
        else:
            self.state.update((status, created))
        yield pd.DataFrame(out, columns=["job_id", "seq", "kind", "status", "accepted"]).astype({"seq": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"job_id": [key[0]], "seq": pd.array([None], "Int64"), "kind": [EXPIRED], "status": [EXPIRED], "accepted": [True]})

    def close(self) -> None:
        pass


def stream_lifecycle(events: DataFrame, settings: Settings, delay: str = "10 minutes") -> DataFrame:
    """Each status event with whether it was a legal step of its job, and a row of kind expired at the end of each life.

    A job lives for the time to live from its first queued event; what comes
    after is a step of a job that does not exist. `status` is the job's status
    after the event. State is kept for living jobs only.
    """
    steps = events.where(F.col("kind").isin(JOB_STATES)).select("job_id", "seq", "ts", F.unix_micros("ts").alias("us"), "kind")
    return (
        steps.withWatermark("ts", delay)
        .groupBy("job_id")
        .transformWithStateInPandas(Lifecycle(settings.job_ttl_hours), OUT, "Append", "EventTime")
    )
