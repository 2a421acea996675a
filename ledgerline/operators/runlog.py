"""Run log: append-only rows per run event (open, close).

The log lives outside the load's commit, so a failed run is recorded
as failed (its partial tables are never committed).  The latest event
of a run is its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import truncate_text

EVENT_SCHEMA = ("run_id long, event_seq int, run_started_at timestamp_ntz, run_finished_at timestamp_ntz, "
                "rows_inserted long, rows_updated long, status string, error_message string, "
                "batch_id long, payments_inserted long, loans_inserted long, loans_updated long")


class RunLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/_runs"

    def events(self) -> DataFrame:
        from ..sources.store import path_exists
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return self.spark.read.schema(EVENT_SCHEMA).parquet(self.path)

    def next_run_id(self) -> int:
        """After every run so far, failed ones included."""
        return int(self.events().agg(F.max("run_id")).first()[0] or 0) + 1

    def _append(self, row: dict) -> None:
        cols = [f.split(" ")[0] for f in EVENT_SCHEMA.split(", ")]
        self.spark.createDataFrame([tuple(row.get(c) for c in cols)], EVENT_SCHEMA) \
            .coalesce(1).write.mode("append").parquet(self.path)

    def open(self, run_id: int, started_at, batch_id: int | None = None) -> int:
        self._append({"run_id": run_id, "event_seq": 0, "run_started_at": started_at,
                      "status": "running", "batch_id": batch_id})
        return run_id

    def close(self, run_id: int, started_at, finished_at, status: str, metrics: dict | None = None,
              error: str | None = None, batch_id: int | None = None) -> None:
        m = metrics or {}
        self._append({"run_id": run_id, "event_seq": 1, "run_started_at": started_at,
                      "run_finished_at": finished_at, "status": status, "error_message": error,
                      "batch_id": batch_id, **{k: m.get(k) for k in (
                          "rows_inserted", "rows_updated", "payments_inserted", "loans_inserted",
                          "loans_updated")}})

    def runs(self) -> DataFrame:
        return latest_state(self.events())


def latest_state(events: DataFrame) -> DataFrame:
    """One row per run: its latest event (the log is small: one row per event)."""
    w = Window.partitionBy("run_id").orderBy(F.col("event_seq").desc())
    return (events.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "event_seq"))


def run_history(runs: DataFrame, n: int = 10) -> DataFrame:
    """Last ``n`` runs, newest first, error text cut to 80 characters."""
    return (runs.select("run_id", "run_started_at", "run_finished_at", "rows_inserted", "rows_updated",
                        "status", truncate_text("error_message", 80).alias("error"))
            .orderBy(F.col("run_id").desc()).limit(n))

