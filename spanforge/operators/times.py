"""Log-level times from the root's direct children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_times(spans: DataFrame) -> DataFrame:
    """Start, end, last timed end and duration of each log.

    The end is the last top-level row's exit (its own time when it has none); the execution end is
    the exit of the last top-level row that took time.
    """
    end = F.when(F.coalesce("exit_ns", F.lit(0)) != 0, F.col("exit_ns"))
    timed = end.isNotNull() & (F.col("dur_total") != 0)
    out = (
        spans.filter(F.col("depth") == 0)
        .groupBy("log_id")
        .agg(
            F.min_by("ts_ns", F.when(F.col("ts_ns") != 0, F.col("event_index"))).alias("start_ns"),
            F.max_by(F.coalesce(end, "ts_ns"), "event_index").alias("exit_ns"),
            F.max_by("exit_ns", F.when(timed, F.col("event_index"))).alias("execution_end_ns"),
        )
    )
    start = F.coalesce("start_ns", F.lit(0))
    return out.select(
        "log_id",
        start.alias("start_ns"),
        "exit_ns",
        "execution_end_ns",
        F.when(F.col("exit_ns") != 0, F.col("exit_ns") - start).otherwise(0).alias("duration_ns"),
    )
