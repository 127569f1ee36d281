"""Run log: one row per status event, the latest row of a run is its state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.ingest import timestamp
from broadsheet.schemas import RUN_EVENT, RUN_STATES

STATUS_RANK = {"queued": 0, "running": 1, "completed": 2, "failed": 3}


def run_event(
    spark: SparkSession,
    run_id: str,
    status: str,
    at: datetime,
    job_type: str = "scrape",
    result_count: int | None = None,
    error_message: str | None = None,
) -> DataFrame:
    """One row to append to the log."""
    if status not in RUN_STATES:
        raise ValueError(f"unknown status: {status}")
    return spark.createDataFrame(
        [(run_id, at, status, job_type, result_count, error_message)], RUN_EVENT
    )


def run_log(events: DataFrame) -> DataFrame:
    """The log in its order per run, with the times a run started and ended."""
    ended = F.col("status").isin("completed", "failed")
    return events.withColumn("completed_at", F.when(ended, F.col("event_time")))


def run_state(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Current state of every run.

    The latest event decides (``order`` breaks ties); a run started at its first event.
    ``max_by`` aggregates before the shuffle, so a run with very many events is cheap.
    """
    rank = F.struct("event_time", *[F.col(c) for c in (order or [])])
    last = F.max_by(F.struct("status", "job_type", "result_count", "error_message", "event_time"), rank)
    return (
        events.groupBy("id")
        .agg(last.alias("_last"), F.min("event_time").alias("started_at"))
        .select(
            "id",
            "_last.status",
            "_last.job_type",
            "started_at",
            F.when(F.col("_last.status").isin("completed", "failed"), F.col("_last.event_time")).alias(
                "completed_at"
            ),
            "_last.result_count",
            "_last.error_message",
        )
    )


def completed_count(events: DataFrame, run_id: str) -> int | None:
    """The stored articles of a run that has completed, else None."""
    done = events.filter((F.col("id") == run_id) & (F.col("status") == "completed"))
    row = done.agg(F.max("result_count").alias("n")).first()
    return row.n


def stuck_runs(states: DataFrame, as_of: datetime | str | Column, minutes: int) -> DataFrame:
    """Runs that have been running for longer than ``minutes``."""
    oldest = timestamp(as_of) - F.make_dt_interval(mins=F.lit(minutes))
    return states.filter((F.col("status") == "running") & (F.col("started_at") < oldest))


def sweep_stuck_runs(
    states: DataFrame, as_of: datetime | str | Column, minutes: int, apply: bool = False
) -> DataFrame:
    """Run states with stuck runs failed; unchanged unless ``apply`` is set."""
    if not apply:
        return states
    now = timestamp(as_of)
    oldest = now - F.make_dt_interval(mins=F.lit(minutes))
    stuck = (F.col("status") == "running") & (F.col("started_at") < oldest)
    return states.withColumn("_stuck", stuck).withColumns(
        {
            "status": F.when(F.col("_stuck"), F.lit("failed")).otherwise(F.col("status")),
            "completed_at": F.when(F.col("_stuck"), now).otherwise(F.col("completed_at")),
            "error_message": F.when(F.col("_stuck"), F.lit("timeout_cleanup")).otherwise(
                F.col("error_message")
            ),
        }
    ).drop("_stuck")


def sweep_events(states: DataFrame, as_of: datetime | str | Column, minutes: int) -> DataFrame:
    """The events that fail stuck runs, to append to the log; nothing is rewritten."""
    return stuck_runs(states, as_of, minutes).select(
        "id", timestamp(as_of).alias("event_time"), F.lit("failed").alias("status"), "job_type",
        "result_count", F.lit("timeout_cleanup").alias("error_message"),
    )
