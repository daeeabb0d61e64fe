"""One row per log: entry point, levels, namespaces, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions import extract as x
from spanforge.operators.tree import chain_of
from spanforge.schema import KEY


def log_entry_point(spans: DataFrame) -> DataFrame:
    """First code unit at the root or directly under an execution start, with its label."""
    units = spans.filter((F.col("type") == "CODE_UNIT_STARTED") & (F.col("depth") <= 1))
    linked = chain_of(
        units.select(*KEY, "path", "depth", "text", "unit_type"), spans.filter(F.col("depth") == 0), {"a_type": F.col("type")}
    )
    direct = (F.col("depth") == 0) | (F.get("chain.a_type", F.lit(0)) == "EXECUTION_STARTED")
    first = (
        linked.filter(direct)
        .groupBy("log_id")
        .agg(F.min_by(F.struct("text", "unit_type"), "event_index").alias("u"))
        .select("log_id", "u.*")
    )
    tail = F.substring_index("text", "/", -1)
    label = (
        F.when(F.col("text") == "execute_anonymous_apex", "Anonymous Apex")
        .when(F.col("unit_type") == "VF", F.concat(F.lit("VF "), tail))
        .when(
            F.col("unit_type") == "__sfdc_trigger",
            F.concat(
                F.lit("Trigger "),
                F.when(F.col("text").startswith("__sfdc_trigger/"), tail).otherwise(
                    F.substring_index("text", " on ", 1)
                ),
            ),
        )
        .otherwise(F.col("text"))
    )
    return first.select("log_id", label.alias("entry_point"), F.col("text").alias("detail"))


def start_of_day_ms(events: DataFrame) -> DataFrame:
    """Wall clock of the first timed event, in milliseconds since midnight."""
    first = events.filter(F.col("ts_ns") != 0).groupBy("log_id").agg(
        F.min_by(F.struct("line", "ts_ns"), "event_index").alias("f")
    )
    return first.select(
        "log_id", x.wall_clock_ms(F.col("f.line")).alias("start_ms"), F.col("f.ts_ns").alias("first_ts")
    )


def governor_totals(snapshots: DataFrame, spans: DataFrame) -> DataFrame:
    """Per log and metric: the last block of each namespace summed; heap is the highest peak.

    `limit` is that of the namespace reported last.
    """
    last = snapshots.groupBy("log_id", "namespace", "metric").agg(
        F.max_by(F.struct("used", "limit", "event_index"), "event_index").alias("s"),
        F.min("event_index").alias("first_index"),
        F.max("used").alias("peak"),
    )
    summed = last.groupBy("log_id", "metric").agg(
        F.sum("s.used").alias("used"),
        F.max_by("s.limit", "first_index").alias("limit"),
        F.max("peak").alias("peak"),
    )
    live = spans.groupBy("log_id").agg(F.max("heap_peak").alias("live"))
    heap = F.greatest("peak", F.coalesce("live", F.lit(0)))
    return summed.join(live, "log_id", "left").select(
        "log_id",
        "metric",
        F.when(F.col("metric") == "heapSize", heap).otherwise(F.col("used")).alias("used"),
        "limit",
    )


def log_table(tagged: DataFrame, namespaces: DataFrame, times: DataFrame, entry: DataFrame) -> DataFrame:
    """Times, size in characters, namespaces and entry point, one row per log."""
    size = tagged.groupBy("log_id").agg(F.sum(F.length("line") + 1).alias("size"))
    known = namespaces.groupBy("log_id").agg(
        F.sort_array(F.collect_list(F.struct("first_index", "namespace"))).alias("n")
    )
    return (
        times.join(size, "log_id")
        .join(known.select("log_id", F.col("n.namespace").alias("namespaces")), "log_id", "left")
        .join(entry, "log_id", "left")
    )
