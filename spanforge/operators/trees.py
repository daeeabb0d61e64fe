"""Call trees as flat tables keyed by path: top-down, bottom-up, method metrics, governor cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.tree import contains, event_key, stack_key, with_chain
from spanforge.schema import KEY, METRICS


def _links() -> dict[str, Column]:
    return {"key": event_key(), "stack": stack_key()}


# Types kept by the details filter although they take no time.
EXCLUDED_DETAIL_TYPES = [
    "CUMULATIVE_LIMIT_USAGE",
    "LIMIT_USAGE_FOR_NS",
    "CUMULATIVE_PROFILING",
    "CUMULATIVE_PROFILING_BEGIN",
]

# label, counter total, limit metric
COST_METRICS = [
    ("SOQL", "soql_count_total", "soqlQueries"),
    ("DML", "dml_count_total", "dmlStatements"),
    ("SOSL", "sosl_count_total", "soslQueries"),
    ("SOQL Rows", "soql_rows_total", "queryRows"),
    ("DML Rows", "dml_rows_total", "dmlRows"),
    ("Heap", "heap_peak", "heapSize"),
]


def _counters(metrics: Sequence[str]) -> list[str]:
    return [f"{m}_{part}" for m in metrics for part in ("self", "total")]


def _last_of(chain: str, field: str) -> Column:
    return F.try_element_at(F.col(chain), F.lit(-1)).getField(field)


def _averages(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_self", F.col("dur_self") / F.col("calls"))


def time_order(spans: DataFrame) -> DataFrame:
    return spans.orderBy("log_id", "event_index")


def top_down(spans: DataFrame, metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Siblings merged by type, namespace and text at every level.

    A call whose namespace and text equal its direct parent's adds no total time.
    """
    linked = with_chain(spans, _links())
    guarded = F.when(_last_of("chain", "stack") == stack_key(), 0).otherwise(F.col("dur_total"))
    path = F.concat(F.col("chain.key"), F.array(event_key()))
    grouped = linked.groupBy("log_id", path.alias("key_path")).agg(
        F.first("type").alias("type"),
        F.first("namespace").alias("namespace"),
        F.first("text").alias("text"),
        F.count("*").alias("calls"),
        F.sum("dur_self").alias("dur_self"),
        F.sum(guarded).alias("dur_total"),
        *[F.sum(c).alias(c) for c in _counters(metrics)],
        F.max("heap_peak").alias("heap_peak"),
        F.min("event_index").alias("first_index"),
    )
    return _averages(grouped.withColumn("depth", F.size("key_path") - 1))


def bottom_up(
    spans: DataFrame, metrics: Sequence[str] = tuple(METRICS), max_depth: int | None = None
) -> DataFrame:
    """Every frame as a root with its callers below it, totals safe under recursion.

    A span's total is lowered by the totals of the spans whose nearest ancestor with the same
    namespace and text it is. Equal stacks are merged before the callers are unrolled.
    `max_depth` stops unrolling callers at that many levels; the levels kept stay exact.
    """
    linked = with_chain(spans, _links())
    mine = stack_key()
    totals = ["dur_total", *[f"{m}_total" for m in metrics]]
    selfs = ["dur_self", *[f"{m}_self" for m in metrics]]
    nearest = F.try_element_at(
        F.filter("chain", lambda a: a["stack"] == mine), F.lit(-1)
    ).getField("index")
    inner = (
        linked.select("log_id", nearest.alias("event_index"), *totals)
        .filter(F.col("event_index").isNotNull())
        .groupBy("log_id", "event_index")
        .agg(*[F.sum(t).alias(t) for t in totals])
    )
    # Only frames have spans inside them, so the many leaves are not joined with what lowers a total.
    full = F.concat(F.array(event_key()), F.reverse(F.col("chain.key"))).alias("full")
    frames = linked.filter(F.col("last_index") > F.col("event_index")).select(*KEY, full)
    lowered = frames.join(inner, KEY).select("log_id", "full", *[(-F.col(t)).alias(t) for t in totals])
    counted = linked.select("log_id", full, F.lit(1).alias("calls"), *selfs, *totals, "heap_peak")
    stacks = counted.unionByName(lowered, allowMissingColumns=True).groupBy("log_id", "full").agg(
        *[F.sum(c).alias(c) for c in ["calls", *selfs, *totals]],
        F.max("heap_peak").alias("heap_peak"),
    )
    levels = F.size("full") if max_depth is None else F.least(F.size("full"), F.lit(max_depth))
    rows = (
        stacks.withColumn("n", F.explode(F.sequence(F.lit(1), levels)))
        .groupBy("log_id", F.slice("full", F.lit(1), F.col("n")).alias("caller_path"))
        .agg(
            F.sum("calls").alias("calls"),
            *[F.sum(c).alias(c) for c in [*selfs, *totals]],
            F.max("heap_peak").alias("heap_peak"),
        )
    )
    return _averages(rows.withColumn("depth", F.size("caller_path") - 1))


def method_metrics(spans: DataFrame) -> DataFrame:
    """Count, self and total per signature; total counts only calls with no equal frame above."""
    linked = with_chain(spans, _links())
    mine = stack_key()
    nested = F.exists("chain", lambda a: a["stack"] == mine)
    return linked.groupBy("log_id", "type", "namespace", "text").agg(
        F.count("*").alias("calls"),
        F.sum("dur_self").alias("dur_self"),
        F.sum(F.when(nested, 0).otherwise(F.col("dur_total"))).alias("dur_total"),
    )


def log_limits(limits: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per log with a column for the limit of each metric, from rows (log_id, metric, limit)."""
    named = [F.max(F.when(F.col("metric") == m, F.col("limit"))).alias(f"__{m}") for m in metrics]
    return limits.groupBy("log_id").agg(*named)


def governor_cost(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Mean and maximum of the used/limit percentages, and the used ones, largest first.

    `limits` are the logs' own (log_id, metric, limit), as in facts.governor_totals. A metric whose limit
    the log does not report counts neither in the sum nor in the divisor; without any the cost is 0.
    """
    joined = df.join(log_limits(limits, [m for _, _, m in COST_METRICS]), "log_id", "left")
    every = F.array(
        *[
            F.when(
                F.col(f"__{metric}") > 0,
                F.struct(
                    (F.col(used) / F.col(f"__{metric}") * 100).alias("percent"),
                    F.lit(label).alias("label"),
                    F.col(used).cast("long").alias("used"),
                    F.col(f"__{metric}").cast("long").alias("limit"),
                ),
            )
            for label, used, metric in COST_METRICS
        ]
    )
    known = F.array_compact(every)
    percents = F.transform(known, lambda p: p["percent"])
    total = F.aggregate(percents, F.lit(0.0), lambda a, x: a + x)
    return joined.withColumns(
        {
            "governor_cost": F.coalesce(F.try_divide(total, F.size(known)), F.lit(0.0)),
            "governor_cost_max": F.greatest(F.coalesce(F.array_max(percents), F.lit(0.0)), F.lit(0.0)),
            "governor_cost_parts": F.reverse(F.array_sort(F.filter(known, lambda p: p["used"] > 0))),
        }
    ).drop(*[f"__{m}" for _, _, m in COST_METRICS])


def significant(time_ordered: bool = False) -> Column:
    """Own part of the details flag."""
    shown = (F.col("dur_total") > 0) | F.col("type").isin(EXCLUDED_DETAIL_TYPES)
    if time_ordered:
        shown = shown | F.col("is_parent") | F.coalesce("discontinuity", F.lit(False))
    return shown


def has_details_deep(spans: DataFrame, time_ordered: bool = False) -> DataFrame:
    return contains(spans, significant(time_ordered), "has_details_deep")
