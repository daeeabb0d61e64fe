"""Reading trace logs as line tables, and facts that need only the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.operators.scan import slice_of, whole
from spanforge.schema import CHUNK

# Line patterns of the format.
START_LINE = r"^\d{2}:\d{2}:\d{2}.\d{1} \(\d+\)\|EXECUTION_STARTED$"
SETTINGS_LINE = r"^\d+\.\d+\sAPEX_CODE,\w+;APEX_PROFILING,.+$"
TIMED_LINE = r"^\d{2}:\d{2}:\d{2}\.\d+ \((\d+)\)\|"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every file under `path`: (log_id, line_no, line), one log per file.

    Files are read split by split, never whole. Rows of a split are consecutive in the row id, so
    a line's number is its row id minus the split's first one plus the lines of earlier splits;
    only one row per split is shuffled.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("log_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    splits = raw.groupBy("log_id", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("log_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.sum("n").over(before)
    offsets = splits.select("log_id", "block", "first", F.coalesce(earlier, F.lit(0)).alias("offset"))
    numbered = raw.join(offsets, ["log_id", "block"])
    return numbered.select(
        "log_id", (F.col("row") - F.col("first") + F.col("offset") + 1).alias("line_no"), "line"
    )


def body_lines(lines: DataFrame, size: int = CHUNK) -> DataFrame:
    """Lines from the first execution start on (all lines when a log has none), blanks dropped."""
    begun = whole(
        lines,
        ["log_id"],
        slice_of("line_no", size),
        {"__start": ("min", F.when(F.col("line").rlike(START_LINE), F.col("line_no")))},
    )
    return begun.filter(
        (F.col("line") != "") & (F.col("line_no") >= F.coalesce("__start", F.lit(0)))
    ).drop("__start")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return body_lines(read_lines(spark, path))


def debug_levels(lines: DataFrame) -> DataFrame:
    """Debug category -> level of the first settings line of each log."""
    found = lines.filter(F.col("line").rlike(SETTINGS_LINE)).groupBy("log_id").agg(
        F.min_by("line", "line_no").alias("line")
    )
    settings = F.substring("line", F.instr("line", " ") + 1, F.length("line"))
    entry = F.split("e", ",")
    return (
        found.select("log_id", F.posexplode(F.split(settings, ";")).alias("position", "e"))
        .select(
            "log_id",
            "position",
            F.coalesce(F.get(entry, F.lit(0)), F.lit("")).alias("category"),
            F.coalesce(F.get(entry, F.lit(1)), F.lit("")).alias("level"),
        )
    )


def log_user(lines: DataFrame) -> DataFrame:
    """User and time zone, when the first timed line of the log is a user line."""
    timed = lines.filter(F.col("line").rlike(TIMED_LINE))
    first = timed.groupBy("log_id").agg(F.min_by("line", "line_no").alias("line"))
    parts = F.split("line", r"\|")
    named = first.filter(F.get(parts, F.lit(1)) == "USER_INFO").select(
        "log_id",
        F.trim(F.coalesce(F.get(parts, F.lit(4)), F.lit(""))).alias("user"),
        F.trim(F.coalesce(F.get(parts, F.lit(5)), F.lit(""))).alias("timezone"),
    )
    return named.filter(F.col("user") != "")


def log_duration(lines: DataFrame) -> DataFrame:
    """Last timestamp minus that of the execution start, null unless positive."""
    ts = F.when(
        F.col("line").rlike(TIMED_LINE), F.regexp_extract("line", TIMED_LINE, 1).try_cast("long")
    )
    started = F.when(F.col("line").rlike(TIMED_LINE + "EXECUTION_STARTED"), F.col("line_no"))
    out = lines.groupBy("log_id").agg(
        F.min_by(ts, started).alias("a"),
        F.max_by(ts, F.when(ts.isNotNull(), F.col("line_no"))).alias("b"),
    )
    return out.select(
        "log_id", F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).alias("duration_ns")
    )
