"""Counts and times of running jobs, taken beside their main pass."""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

BATCHES = "query string, batch_id long, rows long, trigger_ms long, processing_ms long, rows_per_sec double, observed map<string,bigint>"


def counted(rows: DataFrame, counts: dict[str, Column], name: str = "counts") -> tuple[DataFrame, Observation]:
    """rows, and an observation of these counts of conditions that is there after the first action on them: no second pass."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.sum(c.cast("long")).alias(k) for k, c in counts.items())), seen


def observed(stream: DataFrame, counts: dict[str, Column], name: str = "counts") -> DataFrame:
    """stream, with these counts in each micro-batch's progress."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in counts.items()))


class BatchLog(StreamingQueryListener):
    """Records the micro-batches of the queries of a session: rows, times and observed counts; one row for each batch, so it stays small.

    with BatchLog(spark) as log: run queries; log.table() then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.batches, self.ended = spark, {}, set()
        self.lock = threading.Lock()

    def __enter__(self) -> BatchLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        times, counts = p.get("durationMs", {}), {}
        for metrics in (p.get("observedMetrics") or {}).values():
            counts |= {k: int(v) for k, v in metrics.items() if isinstance(v, (int, float))}
        row = (str(p["runId"]), int(p["batchId"]), int(p["numInputRows"]), int(times.get("triggerExecution", 0)), int(times.get("addBatch", 0)), float(p.get("processedRowsPerSecond") or 0.0), counts)
        with self.lock:
            self.batches[row[0], row[1]] = row

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended.add(str(event.runId))

    def wait_for(self, run_id: str, seconds: float = 30.0) -> None:
        """Until the end of a run has been told: listeners hear of it a little later."""
        until = time.time() + seconds
        while run_id not in self.ended and time.time() < until:
            time.sleep(0.05)

    def table(self) -> DataFrame:
        with self.lock:
            return self.spark.createDataFrame(list(self.batches.values()), BATCHES)


def batch_latency(batches: DataFrame) -> DataFrame:
    """One row: mean, 95th percentile and largest time of a micro-batch with rows, and the mean time for a row, in ms."""
    full = batches.where("rows > 0")
    return full.agg(F.count(F.lit(1)).alias("batches"), F.avg("trigger_ms").alias("mean_ms"), F.percentile("trigger_ms", F.lit(0.95)).alias("p95_ms"), F.max("trigger_ms").alias("max_ms"), (F.sum("trigger_ms") / F.sum("rows")).alias("row_ms"))
