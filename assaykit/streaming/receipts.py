"""Receipts of Spark's own work: what passes through a stage, observed while it runs, and the progress of streams, as rows.

An Observation rides on a query and is there once an action has run it, so counting costs no job of its own. A listener turns
the progress of streaming queries into the same rows: run, stage, started, ended (milliseconds), rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

STAGES = "run string, stage string, started long, ended long, rows long"


def now_ms() -> int:
    return time.time_ns() // 1_000_000


class Receipts:
    """The stages of one run. Use watched() on the DataFrames of a stage and timed() around its action."""

    def __init__(self, spark: SparkSession, run: str):
        self.spark, self.run = spark, run
        self.observed: list[tuple[str, Observation]] = []
        self.times: dict[str, list[tuple[int, int]]] = {}

    def watched(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """df, of which the stage's rows and further aggregates are noted when an action runs it."""
        seen = Observation(f"{self.run}/{stage}/{len(self.observed)}")
        self.observed.append((stage, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in metrics.items()])

    @contextmanager
    def timed(self, stage: str) -> Iterator[None]:
        """Notes the time of a stage; a stage may be entered several times."""
        started = now_ms()
        try:
            yield
        finally:
            self.times.setdefault(stage, []).append((started, now_ms()))

    def metrics(self) -> list[tuple[str, dict]]:
        """(stage, metrics) of what was watched; waits for an action that runs it."""
        return [(stage, seen.get) for stage, seen in self.observed]

    def stages(self) -> DataFrame:
        """A row for each time that a stage was entered, with the rows that passed in its last one; a stage that was only
        watched has no times."""
        rows = {}
        for stage, told in self.metrics():
            rows[stage] = rows.get(stage, 0) + told["rows"]
        out = []
        for stage in {*rows, *self.times}:
            times = self.times.get(stage, [(None, None)])
            out += [(self.run, stage, a, b, rows.get(stage) if (a, b) == times[-1] else None) for a, b in times]
        return self.spark.createDataFrame(sorted(out, key=repr), STAGES)  # as many rows as the run has stages


class ProgressReceipts(StreamingQueryListener):
    """Rows of the progress of a session's streaming queries: one a batch, and one for each part of its work."""

    def __init__(self):
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress
        started = int(datetime.fromisoformat(told.timestamp.replace("Z", "+00:00")).timestamp() * 1000)
        run = told.name or str(told.id)
        self.rows.append((run, f"batch-{told.batchId}", started, started + told.batchDuration, told.numInputRows))
        at = started
        for part, took in told.durationMs.items():
            if part != "triggerExecution":
                self.rows.append((run, part, at, at + took, None))
                at += took

    def onQueryTerminated(self, event) -> None:
        pass

    def stages(self, spark: SparkSession) -> DataFrame:
        """The rows so far. A batch's parts follow one another from its start; their order within it isn't told."""
        return spark.createDataFrame(self.rows, STAGES)


@contextmanager
def listening(spark: SparkSession) -> Iterator[ProgressReceipts]:
    """Listens to the session's streams inside a block; what they told is there once their events have come, at its end."""
    listener = ProgressReceipts()
    spark.streams.addListener(listener)
    try:
        yield listener
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
