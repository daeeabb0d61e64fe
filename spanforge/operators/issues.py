"""Issues of a log: markers, exceptions and structure anomalies, deduplicated, with their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import split_issue
from spanforge.operators.scan import following, slice_of
from spanforge.schema import CHUNK, KEY

# What an issue without a text of its own is told by.
DESCRIPTIONS = {"Unexpected-End": "entry-without-exit", "Unexpected-Exit": "exit-without-entry", "Max-Size-reached": "cut-at-maximum-size"}


def exceptions(events: DataFrame) -> DataFrame:
    """Exceptions and fatal errors in log order."""
    return events.filter(F.col("type").isin("EXCEPTION_THROWN", "FATAL_ERROR"))


def _described() -> Column:
    expr = F.lit("")
    for summary, text in DESCRIPTIONS.items():
        expr = F.when(F.col("summary") == summary, text).otherwise(expr)
    return expr


def collect_issues(tagged: DataFrame, events: DataFrame, structure: DataFrame) -> DataFrame:
    """One issue per log, type and summary: the first one, but the last for a size cut-off that
    was moved by truncated frames."""
    host = events.select(*KEY, F.col("ts_ns").alias("start_ns"))
    marks = (
        tagged.filter(F.col("role").isin("skip", "max_size"))
        .select(*KEY, "line_no", "line", "role")
        .join(host, KEY)
        .select(
            *KEY,
            "start_ns",
            F.when(F.col("role") == "skip", "Skipped-Lines").otherwise("Max-Size-reached").alias("summary"),
            F.when(F.col("role") == "skip", F.col("line"))
            .otherwise(DESCRIPTIONS["Max-Size-reached"])
            .alias("description"),
            F.lit("skip").alias("type"),
            F.struct(F.lit(0).cast("long").alias("late"), F.col("line_no").alias("a"), F.lit(0).cast("long").alias("b")).alias("ord"),
        )
    )
    summary, description = split_issue(F.col("text"))
    thrown = exceptions(events).filter(
        (F.col("type") == "FATAL_ERROR") | F.col("text").contains("System.LimitException")
    )
    raised = thrown.select(
        *KEY,
        F.col("ts_ns").alias("start_ns"),
        summary.alias("summary"),
        description.alias("description"),
        F.when(F.col("type") == "FATAL_ERROR", "fatal").otherwise("error").alias("type"),
        F.struct(F.lit(0).cast("long").alias("late"), F.col("event_index").alias("a"), F.lit(0).cast("long").alias("b")).alias("ord"),
    )
    # Frames close from the inside out; a moved size cut-off counts from the outermost one.
    moved = F.col("summary") == "Max-Size-reached"
    at = F.coalesce("position", F.lit(2**62))
    shaped = structure.select(
        *KEY,
        "start_ns",
        "summary",
        _described().alias("description"),
        F.when(moved, "skip").otherwise("unexpected").alias("type"),
        F.struct(
            F.when(moved, -1).otherwise(0).cast("long").alias("late"),
            F.when(moved, -at).otherwise(at).alias("a"),
            F.when(moved, F.col("event_index")).otherwise(-F.col("event_index")).alias("b"),
        ).alias("ord"),
    )
    every = marks.unionByName(raised).unionByName(shaped)
    return (
        every.groupBy("log_id", "type", "summary")
        .agg(F.min_by(F.struct("event_index", "start_ns", "description"), "ord").alias("i"))
        .select("log_id", "type", "summary", "i.*")
    )


def issue_ends(found: DataFrame, events: DataFrame, logs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Skipped lines end at the next entry event; a size cut-off at the next later event; else the
    end of the log. Other issues are points.

    The next entry is a forward scan. The next later event needs the issue's own time: it joins in per
    slice of the cut-off logs' events, and the slices' first hits are combined.
    """
    ahead = following(
        events.select(*KEY, "ts_ns", "ends"),
        ["log_id"],
        "event_index",
        {"next_entry": ("last", F.when(F.size("ends") > 0, F.col("ts_ns")))},
        size,
    )
    skip = found.filter(F.col("summary") == "Skipped-Lines").select(*KEY).join(ahead, KEY).select(*KEY, "next_entry")
    cut_off = found.filter(F.col("summary") == "Max-Size-reached").select(
        "log_id", F.col("event_index").alias("from_index"), F.col("start_ns").alias("from_ns")
    )
    sliced = events.select(*KEY, "ts_ns").withColumn("slice", slice_of("event_index", size))
    asked = sliced.select("log_id", "slice").distinct().join(cut_off, "log_id")
    later = (
        sliced.join(asked, ["log_id", "slice"])
        .filter((F.col("event_index") > F.col("from_index")) & (F.col("ts_ns") > F.col("from_ns")))
        .groupBy("log_id", "slice")
        .agg(F.min("event_index").alias("at"), F.min_by("ts_ns", "event_index").alias("ts_ns"))
        .groupBy("log_id")
        .agg(F.min_by("ts_ns", "at").alias("next_later"))
    )
    return (
        found.join(skip, KEY, "left")
        .join(later, "log_id", "left")
        .join(logs.select("log_id", F.col("exit_ns").alias("log_end")), "log_id", "left")
        .withColumn(
            "end_ns",
            F.when(F.col("summary") == "Skipped-Lines", F.coalesce("next_entry", "log_end")).when(
                F.col("summary") == "Max-Size-reached", F.coalesce("next_later", "log_end")
            ),
        )
        .drop("next_entry", "next_later", "log_end")
    )


def issue_severity(kind: Column) -> Column:
    """Severity shown for an issue type."""
    return (
        F.when(kind.isin("fatal", "error"), "Error")
        .when(kind == "unexpected", "Warning")
        .otherwise("Info")
    )


def notices(issues: DataFrame, errors: DataFrame) -> DataFrame:
    """Issues with their severity, and parser messages as warnings."""
    return issues.select(
        "log_id", issue_severity(F.col("type")).alias("severity"), "summary", "description", "start_ns"
    ).unionByName(
        errors.select(
            "log_id",
            F.lit("Warning").alias("severity"),
            F.col("message").alias("summary"),
            F.lit("").alias("description"),
            F.lit(None).cast("long").alias("start_ns"),
        )
    )
