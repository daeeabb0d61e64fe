"""Operations on any grid: deep and strict filters, ranges, facets, grouping, footers, find, views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.scan import running
from spanforge.operators.tree import contains, covered
from spanforge.session import cut

# Types that only show debug output.
DEBUG_TYPES = [
    "USER_DEBUG",
    "DATAWEAVE_USER_DEBUG",
    "USER_DEBUG_FINER",
    "USER_DEBUG_FINEST",
    "USER_DEBUG_FINE",
    "USER_DEBUG_DEBUG",
    "USER_DEBUG_INFO",
    "USER_DEBUG_WARN",
    "USER_DEBUG_ERROR",
]

NS_PER_MS = 1_000_000


def filter_deep(spans: DataFrame, predicate: Column) -> DataFrame:
    """Rows that match or have a match below them."""
    return contains(spans, predicate, "__match").filter("__match").drop("__match")


def filter_visible(spans: DataFrame, predicate: Column) -> DataFrame:
    """Rows that pass together with all their ancestors."""
    fails = ~F.coalesce(predicate, F.lit(False))
    return covered(spans, fails, "__hidden").filter(~F.col("__hidden")).drop("__hidden")


def sum_visible(spans: DataFrame, predicate: Column, value: str) -> DataFrame:
    return filter_visible(spans, predicate).groupBy("log_id").agg(F.sum(value).alias(value))


def _in_range(value: Column, low: float | None, high: float | None) -> Column:
    shown = F.round(value, 3)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (shown >= low)
    if high is not None:
        ok = ok & (shown <= high)
    return ok


def in_ms_range(ns: Column, low: float | None = None, high: float | None = None) -> Column:
    """Duration in milliseconds, rounded to 3 decimals, within an open-ended range."""
    return _in_range(ns / NS_PER_MS, low, high)


def in_count_range(value: Column, low: float | None = None, high: float | None = None) -> Column:
    return _in_range(value.cast("double"), low, high)


def facet_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values of a column per log, sorted."""
    named = df.filter(F.coalesce(column, F.lit("")) != "")
    return named.select("log_id", F.col(column).alias("value")).distinct().orderBy("log_id", "value")


def facet_filter(df: DataFrame, column: str, chosen: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(list(chosen))) if chosen else df


def filter_tree(
    spans: DataFrame,
    namespaces: Sequence[str] = (),
    types: Sequence[str] = (),
    debug_only: bool = False,
    total_ms: tuple[float | None, float | None] = (None, None),
    self_ms: tuple[float | None, float | None] = (None, None),
) -> DataFrame:
    """The call-tree filters: each keeps a row when it or something below it passes.

    A filter works on what the one before left and reads its input twice, so each but the first
    starts from a cut: the scans grow with the number of filters, not as a power of it.
    """
    passes = [
        (bool(namespaces), F.col("namespace").isin(list(namespaces))),
        (bool(types), F.col("type").isin(list(types))),
        (debug_only, F.col("type").isin(DEBUG_TYPES)),
        (total_ms != (None, None), in_ms_range(F.col("dur_total"), *total_ms)),
        (self_ms != (None, None), in_ms_range(F.col("dur_self"), *self_ms)),
    ]
    out = spans
    for n, keep in enumerate(keep for wanted, keep in passes if wanted):
        out = filter_deep(cut(out) if n else out, keep)
    return out


def group_grid(
    df: DataFrame, by: str, totals: Mapping[str, str], sort: str | None = None, descending: bool = True
) -> DataFrame:
    """Groups with per-column totals and row count, ordered by a total, else by count and key.

    totals maps a column to "sum" or "max".
    """
    aggs = [(F.sum if how == "sum" else F.max)(c).alias(c) for c, how in totals.items()]
    groups = df.groupBy("log_id", F.col(by).alias("group")).agg(F.count("*").alias("rows"), *aggs)
    if sort is None:
        return groups.orderBy("log_id", F.desc("rows"), "group")
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return groups.orderBy("log_id", key, "group")


def footer(df: DataFrame, sums: Sequence[str], maxima: Sequence[str] = ()) -> DataFrame:
    """Column totals per log: sums, and maxima for cost-like columns."""
    return df.groupBy("log_id").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])


def find(
    df: DataFrame, text: str, columns: Sequence[str], keys: Sequence[str], order: Sequence[str],
    chunks: Sequence[Column], match_case: bool = False,
) -> DataFrame:
    """Occurrences of a literal text over all columns: per row how many, and the number of the
    first of them in `order` within `keys` (slices as in scan.running)."""
    pattern = ("" if match_case else "(?iu)") + "".join(
        "\\" + ch if ch in "[]*+?{}.()^$|\\-" else ch for ch in text
    )
    counts = [F.regexp_count(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(pattern)) for c in columns]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    counted = df.withColumn("matches", total.cast("long"))
    numbered = running(counted, keys, order, chunks, {"before": ("sum", F.col("matches"))}, inclusive=False)
    return numbered.filter(F.col("matches") > 0).withColumn("first_match", F.col("before") + 1).drop("before")


_TIMES = ["dur_total", "dur_self"]
_COUNTS = ["dml_count_total", "soql_count_total", "sosl_count_total"]
_ROWS = ["dml_rows_total", "soql_rows_total", "sosl_rows_total"]

# Named projections of the call trees and the statement grids.
CALL_TREE_VIEWS = {
    "General": ["namespace", "calls", "dml_count_total", "soql_count_total", "thrown_total", "dml_rows_total",
                "soql_rows_total", *_TIMES],
    "Time": ["namespace", "calls", "avg_self", *_TIMES],
    "Governor Limits": ["namespace", *_COUNTS, *_ROWS, "thrown_total", "heap_peak", "governor_cost", "governor_cost_max"],
    "Database": ["namespace", *_COUNTS, *_ROWS, *_TIMES],
    "Memory": ["namespace", "heap_net_total", "heap_net_self", "heap_gross_total", "heap_gross_self", "heap_peak"],
}
SOQL_VIEWS = {
    "General": ["sobject", "namespace", "rows", "time_ns"],
    "Performance": ["is_selective", "relative_cost", "rows", "time_ns"],
    "Query Plan": ["relative_cost", "leading_op", "plan_object", "cardinality"],
    "Limits": ["sobject", "namespace", "rows", "time_ns"],
}
DML_VIEWS = {
    "General": ["sobject", "caller_namespace", "rows", "time_ns"],
    "Timing": ["rows", "time_ns"],
    "Limits": ["sobject", "caller_namespace", "rows"],
}


def view(df: DataFrame, fields: Sequence[str], lead: Sequence[str] = ("log_id", "text")) -> DataFrame:
    """The lead columns and those columns of a view that the grid has."""
    return df.select(*lead, *[c for c in fields if c in df.columns and c not in lead])


def by_selectivity(df: DataFrame, descending: bool = False) -> DataFrame:
    """Sort by selectivity with the unknown ones last, whichever way."""
    col = F.col("is_selective")
    return df.orderBy(col.desc_nulls_last() if descending else col.asc_nulls_last(), "log_id", "event_index")
