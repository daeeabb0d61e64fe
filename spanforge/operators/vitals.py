"""Figures of a selection: sums, averages, shares of the limits, and what its first event tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.trees import log_limits
from spanforge.schema import METRICS, SOSL_ROWS_PER_QUERY

# Counter -> limit metric it is held against.
AGAINST = {
    "soql_count": "soqlQueries",
    "soql_rows": "queryRows",
    "sosl_count": "soslQueries",
    "dml_count": "dmlStatements",
    "dml_rows": "dmlRows",
}


def event_vitals(spans: DataFrame, selected: Column, limits: DataFrame) -> DataFrame:
    """Per log, the sums over the selected events, their averages, and percent of the log's own limits
    (log_id, metric, limit); a limit that is not reported gives null.

    Of the first selected event come type, namespace, that of its caller, line, and if it is a query with a
    plan (column `plan`), the plan and whether it is selective. Rows of a search are held against the limit
    of one search, and only if the first event is one.
    """
    chosen = spans.filter(selected)
    shown = [c for c in ("type", "namespace", "line_number", "parent_index") if c in spans.columns]
    sums = chosen.groupBy("log_id").agg(
        F.count("*").alias("calls"),
        F.sum("dur_self").alias("dur_self"),
        F.sum("dur_total").alias("dur_total"),
        *[F.sum(f"{m}_{p}").alias(f"{m}_{p}") for m in METRICS for p in ("self", "total")],
        F.max("heap_peak").alias("heap_peak"),
        F.min_by(F.struct("event_index", *shown), "event_index").alias("first"),
    )
    first = sums.select("log_id", F.col("first.event_index").alias("first_index"), F.col("first.parent_index").alias("at"))
    caller = spans.select("log_id", F.col("event_index").alias("at"), F.col("namespace").alias("caller_namespace"))
    named = first.join(caller, ["log_id", "at"], "left").select(
        "log_id", "first_index", F.coalesce("caller_namespace", F.lit("default")).alias("caller_namespace")
    )
    if "plan" in spans.columns:
        plans = spans.filter((F.col("type") == "SOQL_EXECUTE_EXPLAIN") & (F.col("event_index") == F.col("parent_index") + 1))
        plans = plans.select("log_id", F.col("parent_index").alias("first_index"), "plan")
        named = named.join(plans, ["log_id", "first_index"], "left").withColumn(
            "is_selective", F.col("plan.relative_cost") <= 1
        )
    joined = sums.join(named.drop("first_index"), "log_id").join(log_limits(limits, list(AGAINST.values())), "log_id", "left")
    share = {
        f"{counter}_percent": F.when(F.col(f"__{m}") > 0, F.col(f"{counter}_total") / F.col(f"__{m}") * 100)
        for counter, m in AGAINST.items()
    }
    search = F.col("first.type") == "SOSL_EXECUTE_BEGIN"
    share["sosl_rows_percent"] = F.when(search, F.col("sosl_rows_total") / F.lit(SOSL_ROWS_PER_QUERY) * 100)
    return joined.withColumns(
        {
            "avg_self": F.col("dur_self") / F.col("calls"),
            "avg_total": F.col("dur_total") / F.col("calls"),
            **share,
            **{c: F.col(f"first.{c}") for c in shown if c != "parent_index"},
        }
    ).drop("first", *[f"__{m}" for m in AGAINST.values()])
