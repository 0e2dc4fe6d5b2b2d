"""Queue depth on a stream: changes from state by job, a running total carried from micro-batch to micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glyphflow.plans.skew import HOT_ROWS, running_total
from glyphflow.settings import QUEUED, TERMINAL_STATES

DELTAS = "seq long, job_id string, delta int"
DEPTHS = f"{DELTAS}, depth long"


class Pending(StatefulProcessor):
    """Whether a job has been queued, and whether it has ended since."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pending", "ended boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Two numbers are enough of a job's rows, however many there are.
        queued, ends = None, []
        known = self.state.get()[0] if self.state.exists() else None
        for part in rows:
            opening = part["kind"] == QUEUED
            if opening.any():
                first = int(part.loc[opening, "seq"].min())
                queued = first if queued is None else min(queued, first)
            ends.append(part.loc[~opening, "seq"])
        out = []
        if known is None and queued is not None:
            out.append((queued, key[0], 1))
            known = False
        if known is False:
            after = pd.concat(ends)
            after = after[after > queued] if out else after
            if len(after):
                out.append((int(after.min()), key[0], -1))
                known = True
        if known is not None:
            self.state.update((known,))
        if out:
            yield pd.DataFrame(out, columns=["seq", "job_id", "delta"]).astype({"delta": "int32"})

    def close(self) -> None:
        pass


def stream_queue_deltas(events: DataFrame) -> DataFrame:
    """Rows (seq, job_id, delta): +1 when a job is first queued, -1 at its first terminal event after that.

    Events come in order from micro-batch to micro-batch; within one they may be in any order.
    """
    steps = events.where(F.col("kind").isin(QUEUED, *TERMINAL_STATES)).select("job_id", "seq", "kind")
    return steps.groupBy("job_id").transformWithStateInPandas(Pending(), DELTAS, "Append", "None")


def carried_depth(spark: SparkSession, folder: str, *, min_rows: int = HOT_ROWS) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that writes the depth after each change below `folder`.

    The total so far is one row by micro-batch, read from the last one; a
    repeated micro-batch replaces its rows. `min_rows` is as in `queue_depth`.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        totals = f"{folder}/totals"
        if batch_id == 0:
            before = 0
        else:
            before = spark.read.schema("total long").parquet(f"{totals}/batch={batch_id - 1}").first()[0]
        batch.write.mode("overwrite").parquet(f"{folder}/deltas/batch={batch_id}")
        deltas = spark.read.schema(DELTAS).parquet(f"{folder}/deltas/batch={batch_id}")
        depths = running_total(deltas, "seq", "delta", "depth", bucket_rows=min_rows).withColumn("depth", F.col("depth") + before)
        depths.select("seq", "job_id", "delta", "depth").write.mode("overwrite").parquet(f"{folder}/depths/batch={batch_id}")
        total = deltas.agg((F.coalesce(F.sum("delta"), F.lit(0)) + before).alias("total"))
        total.write.mode("overwrite").parquet(f"{totals}/batch={batch_id}")

    return take
