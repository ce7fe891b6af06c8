"""Throughput and delay of streaming queries, as a metrics table and a report."""

from __future__ import annotations

import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidepool.schema import BATCH_METRICS


class BatchMeter(StreamingQueryListener):
    """Collects one small row per finished micro-batch."""

    def __init__(self):
        self._rows, self._lock = [], threading.Lock()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        took = dict(p.durationMs)
        with self._lock:
            self._rows.append((p.batchId, p.numInputRows, int(took.get("addBatch", 0)), int(took.get("triggerExecution", 0))))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """(batch_id, n_rows, processing_ms, total_ms)."""
        with self._lock:
            return spark.createDataFrame(list(self._rows), BATCH_METRICS)


def throughput(metrics: DataFrame, *, steady_rows: int = 0, skip: int = 3) -> DataFrame:
    """One row: records, delays in seconds, records per second overall, at best, at worst and when steady.

    Steady batches hold at least ``steady_rows`` records and come after the first ``skip``
    non-empty ones.
    """
    from pyspark.sql import Window as W

    full = metrics.filter("n_rows > 0")
    rate = F.col("n_rows") / F.greatest(F.col("processing_ms") / 1000.0, F.lit(1e-3))
    ranked = full.withColumn("_r", F.row_number().over(W.orderBy("batch_id")))
    steady = (F.col("_r") > skip) & (F.col("n_rows") >= steady_rows)
    return ranked.agg(
        F.sum("n_rows").alias("records"), F.count("*").alias("batches"),
        (F.sum("processing_ms") / 1000.0).alias("processing_s"), (F.sum("total_ms") / 1000.0).alias("total_s"),
        (F.sum("n_rows") * 1000.0 / F.greatest(F.sum("processing_ms"), F.lit(1))).alias("process_throughput"),
        (F.sum("n_rows") * 1000.0 / F.greatest(F.sum("total_ms"), F.lit(1))).alias("total_throughput"),
        F.max(rate).alias("max_throughput"), F.min(rate).alias("min_throughput"),
        (F.sum(F.when(steady, F.col("n_rows"))) * 1000.0
         / F.greatest(F.sum(F.when(steady, F.col("processing_ms"))), F.lit(1))).alias("steady_throughput"))


class PhaseTimer:
    """Wall-clock seconds per named phase of a job."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str):
        start = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - start
