"""The order tree on rows of its own: repeated keys, lines without a number, slices of any size."""

import datetime
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanforge.operators.rollup import rollup, subtree_sums  # noqa: E402
from spanforge.plans.registry import TREE  # noqa: E402
from spanforge.session import cut  # noqa: E402
from spanforge.sources.tables import build_order_tree, order_nodes, order_units, placed_units  # noqa: E402

DAY = datetime.datetime(2024, 1, 1)


def _tables(spark, where, lines):
    def put(name, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{where}/{name}.parquet")

    put("nation", "n_nationkey int, n_name string, n_regionkey int", [(0, "A", 0), (1, "B", 0), (2, "C", 1)])
    customers = [(k, f"c{k}", k % 3, 0.0, ("X", "Y")[k % 2]) for k in range(1, 200, 7)]
    put("customer", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", customers)
    orders = [(9000 * i + 5, customers[i % 11][0], "FOP"[i % 3], 1.0, DAY, f"{i % 5 + 1}-P") for i in range(60)]
    put("orders", "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", orders)
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    put("lineitem", schema, lines(orders))


def _lines(orders):
    return [
        (o[0], (i * 7 + n) % 30, n % 4, n % 3 + 1, float(i % 9 + 1), n + 0.25, 0.0, 0.0, "NAR"[(i + n) % 3], "OF"[n % 2], DAY)
        for i, o in enumerate(orders) for n in range(i % 6)
    ]


@pytest.mark.parametrize("size", [3, 200_000])
def test_tree_equals_sql_with_any_slices(spark, tmp_path, size):
    _tables(spark, tmp_path, _lines)
    units = cut(order_units(spark, str(tmp_path)))
    columns = "log_id, event_index, parent_index, last_index, depth, type, text, ts_ns, dur_self, heap_net_self"
    nodes = order_nodes(spark, str(tmp_path), placed_units(units, size)).select(*[c for c in columns.split(", ") if c != "heap_net_self"])
    con = duckdb.connect()
    for name in ("nation", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"{TREE} SELECT {', '.join(nodes.columns)} FROM tree ORDER BY 1, 2").fetchall()
    assert [tuple(r) for r in nodes.orderBy("log_id", "event_index").collect()] == want
    totals = "log_id, event_index, dur_total, heap_net_self, heap_net_total, heap_gross_total, heap_peak, soql_rows_total"
    want = con.execute(f"{TREE} SELECT {totals} FROM tree ORDER BY 1, 2").fetchall()
    got = build_order_tree(spark, str(tmp_path), max(size, 2)).select(*totals.split(", ")).orderBy("log_id", "event_index")
    assert [tuple(r) for r in got.collect()] == want


def test_repeated_orders_and_lines_without_a_number(spark, tmp_path):
    def lines(orders):
        rows = _lines(orders)
        return rows + [(orders[7][0], 1, 1, None, 3.0, 1.0, 0.0, 0.0, "R", "O", DAY)] * 2

    _tables(spark, tmp_path, lines)
    path = f"{tmp_path}/orders.parquet"
    again = spark.read.parquet(path).filter(F.col("o_orderkey") == 9000 * 7 + 5).collect()
    spark.createDataFrame(again, spark.read.parquet(path).schema).write.mode("append").parquet(path)
    tree = build_order_tree(spark, str(tmp_path), 5).filter(F.col("o_key") == 9000 * 7 + 5).orderBy("event_index").collect()
    # Each line comes once per copy of the order, those without a number before the copies and outside them.
    assert [r.depth for r in tree] == [3] * 4 + [2] * 2 + [3] * 2
    first = tree[0].event_index
    assert [r.event_index for r in tree] == list(range(first, first + 8))
    assert {r.parent_index for r in tree[6:]} == {tree[5].event_index}
    assert all(r.parent_index < first for r in tree[:4])
    times = [r.ts_ns for r in tree]
    assert [b - a for a, b in zip(times, times[1:], strict=False)] == [r.dur_self for r in tree[:-1]]


def test_heap_behind_the_end_of_its_parent(spark):
    rows = [("a", 1, 3, 0, True, 0), ("a", 2, 2, 1, True, 0), ("a", 3, 3, 2, False, 70), ("a", 4, 4, 2, False, 5)]
    spans = spark.createDataFrame(rows, "log_id string, event_index long, last_index long, parent_index long, is_parent boolean, heap_net_self long")
    spans = cut(spans.withColumn("heap_gross_self", F.col("heap_net_self")))
    rolled = rollup(spans, ["heap_net", "heap_gross"], size=2).orderBy("event_index")
    assert [tuple(r) for r in rolled.select("heap_net_self", "heap_gross_self", "heap_net_total", "heap_peak").collect()] == [
        (0, 0, 70, 70), (75, 75, 0, 0), (70, 70, 70, 70), (5, 5, 5, 75)
    ]


def test_leaves_take_no_join_for_their_sums(spark):
    spans = cut(spark.range(1, 9).select(
        F.lit("a").alias("log_id"), F.col("id").alias("event_index"), F.when(F.col("id") == 3, 6).otherwise(F.col("id")).alias("last_index")
    ))
    summed = subtree_sums(spans, {"n": F.lit(1)}, 4)
    assert [r.n for r in summed.orderBy("event_index").collect()] == [1, 1, 4, 1, 1, 1, 1, 1]
    plan = summed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union"), plan
