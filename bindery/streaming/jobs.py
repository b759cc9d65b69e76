"""Background matching of a library as a stream of book rows: incremental, resumable, with progress.

A job reads new rows of a stream, applies the work to each micro-batch and appends the outcome; the checkpoint folder remembers
what is done, so a job that stops or fails goes on where it was. Each batch's counts are observed as it is written, so that a job tells its
progress without reading its outcomes again. Between batches a job can pause, and it waits while someone searches by hand.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass
class Job:
    query: StreamingQuery
    outcome: str
    stopping: threading.Event = field(default_factory=threading.Event)
    #: completed and failures of each batch, those of earlier runs included
    counts: dict[int, tuple[int, int]] = field(default_factory=dict)

    def progress(self) -> tuple[int, int]:
        """completed and failures so far; no outcome is read."""
        done = list(self.counts.values())
        return sum(c for c, _ in done), sum(f for _, f in done)

    def stop(self) -> None:
        self.stopping.set()
        self.query.stop()

    def join(self) -> None:
        self.query.awaitTermination()

    def status(self) -> str:
        if self.query.exception():
            return "failed"
        return "running" if self.query.isActive else "completed"


def start(rows: DataFrame, work: Callable[[DataFrame], DataFrame], outcome: str, checkpoint: str, interval: str | None = None, delay: float = 0.0, busy: Callable[[], bool] | None = None) -> Job:
    """Run ``work`` on every new batch of the stream ``rows``; it returns the batch's outcome with a boolean ``failed``.

    Without an interval the job ends when all that is there now is done. A batch that is run again after a
    failure overwrites its own outcome, under its own number. A batch begins ``delay`` seconds after the one before it, and not while
    ``busy()`` says that a search by hand is on; a job that is stopped meanwhile leaves the batch for its next run.
    """
    stopping, ended, counts = threading.Event(), [0.0], _counted(rows.sparkSession, outcome)

    def batch(df: DataFrame, number: int) -> None:
        while not stopping.is_set() and (time.monotonic() < ended[0] + delay or busy is not None and busy()):
            stopping.wait(0.05)
        if stopping.is_set():
            raise InterruptedError("stopped before the batch began")
        seen = Observation()
        done = work(df).observe(seen, F.count(F.lit(1)).alias("completed"), F.count_if(F.coalesce("failed", F.lit(False))).alias("failures"))
        done.write.mode("overwrite").parquet(f"{outcome}/batch={number}")
        # a batch that is run again replaces its counts, as it does its outcome
        counts[number] = (seen.get["completed"], seen.get["failures"])
        ended[0] = time.monotonic()

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return Job(writer.start(), outcome, stopping, counts)


def _counted(spark: SparkSession, outcome: str) -> dict[int, tuple[int, int]]:
    """The counts of the batches that earlier runs have written, read once as a job begins."""
    path = spark._jvm.org.apache.hadoop.fs.Path(outcome)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    found = spark.read.schema("failed boolean, batch int").parquet(outcome).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("failed", F.lit(False))).alias("bad"))
    return {r.batch: (r.n, r.bad) for r in found.collect()}


def progress(outcomes: DataFrame, *by: str) -> DataFrame:
    """completed and failures of the outcomes so far."""
    return outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("completed"), F.count_if("failed").alias("failures"))
