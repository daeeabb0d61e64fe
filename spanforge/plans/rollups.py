"""Structure and rollup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import trees
from spanforge.plans.registry import TRACE, TREE, query
from spanforge.sources.tables import order_tree, user_traces

_COUNTERS = [
    "dml_count", "soql_count", "sosl_count", "dml_rows", "soql_rows", "sosl_rows",
    "heap_net", "heap_gross",
]


@query(
    "r1_subtree_totals",
    TREE
    + "SELECT log_id, event_index, last_index, dur_total, "
    + ", ".join(f"{m}_total" for m in _COUNTERS)
    + " FROM tree",
)
def _(spark, sf):
    return order_tree(spark, sf).select(
        "log_id", "event_index", "last_index", "dur_total", *[f"{m}_total" for m in _COUNTERS]
    )


@query(
    "r3_heap_self_and_peak",
    TREE + "SELECT log_id, event_index, heap_net_self, heap_gross_self, heap_peak FROM tree",
)
def _(spark, sf):
    return order_tree(spark, sf).select(
        "log_id", "event_index", "heap_net_self", "heap_gross_self", "heap_peak"
    )


@query(
    "g1_time_order",
    TREE
    + "SELECT log_id, event_index, parent_index, depth, type, namespace, text, ts_ns, "
    + "ts_ns + dur_total AS exit_ns, dur_self, dur_total FROM tree",
)
def _(spark, sf):
    return trees.time_order(order_tree(spark, sf)).select(
        "log_id", "event_index", "parent_index", "depth", "type", "namespace", "text", "ts_ns",
        "exit_ns", "dur_self", "dur_total",
    )


@query(
    "e1_user_traces",
    TRACE + "SELECT log_id, event_index, type, category, ts_ns, exit_ns, dur_self FROM trace",
)
def _(spark, sf):
    return user_traces(spark, sf).select(
        "log_id", "event_index", "type", "category", "ts_ns", "exit_ns", "dur_self"
    )
