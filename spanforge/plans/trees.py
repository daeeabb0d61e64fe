"""Call-tree queries over the order tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import highlights, tree, trees, views
from spanforge.plans.registry import TRACE, TREE, query
from spanforge.sources.tables import order_tree, user_traces

_MAIN = ["dml_count", "soql_count", "sosl_count", "dml_rows", "soql_rows", "sosl_rows", "heap_net", "heap_gross"]
_SUMS = ", ".join(
    f"CAST(sum({m}_{p}) AS BIGINT) AS {m}_{p}" for m in _MAIN for p in ("self", "total")
)

KEYED = (
    TREE
    + """, k AS (
  SELECT *, type || '|' || namespace || '|' || text AS key, namespace || '|' || text AS stack FROM tree),
pk AS (
  SELECT t.*, n.key AS nkey, c.key AS ckey, o.key AS okey,
         n.stack AS nstack, c.stack AS cstack, o.stack AS ostack, c.event_index AS ci,
         CASE t.depth WHEN 0 THEN t.key WHEN 1 THEN n.key || ' > ' || t.key
              WHEN 2 THEN n.key || ' > ' || c.key || ' > ' || t.key
              ELSE n.key || ' > ' || c.key || ' > ' || o.key || ' > ' || t.key END AS key_path
  FROM k t JOIN k n ON n.depth = 0 AND n.nk = t.nk
  LEFT JOIN k c ON c.depth = 1 AND c.ck = t.ck AND t.depth >= 2
  LEFT JOIN k o ON o.depth = 2 AND o.ok = t.ok AND t.depth >= 3)
"""
)


@query(
    "g2_top_down",
    KEYED
    + f"""SELECT log_id, key_path, depth, count(*) AS calls, CAST(sum(dur_self) AS BIGINT) AS dur_self,
  CAST(sum(dur_total) AS BIGINT) AS dur_total, round(sum(dur_self) / count(*), 6) AS avg_self,
  max(heap_peak) AS heap_peak, {_SUMS}
FROM pk GROUP BY log_id, key_path, depth""",
)
def _(spark, sf):
    out = trees.top_down(order_tree(spark, sf))
    return out.select(
        "log_id", F.array_join("key_path", " > ").alias("key_path"), "depth", "calls", "dur_self",
        "dur_total", F.round("avg_self", 6).alias("avg_self"), "heap_peak",
        *[f"{m}_{p}" for m in _MAIN for p in ("self", "total")],
    )


_REV = """, net AS (
  SELECT pk.*, pk.dur_total - coalesce(i.inner_total, 0) AS net_total,
         pk.soql_count_total - coalesce(i.inner_soql, 0) AS net_soql
  FROM pk LEFT JOIN (
    SELECT ci AS event_index, log_id, sum(dur_total) AS inner_total, sum(soql_count_total) AS inner_soql
    FROM pk WHERE depth = 3 AND stack = cstack GROUP BY ALL) i
  ON i.log_id = pk.log_id AND i.event_index = pk.event_index),
rev AS (
  SELECT log_id, 0 AS depth, key AS caller_path, dur_self, net_total, net_soql, heap_peak FROM net
  UNION ALL
  SELECT log_id, 1, key || ' > ' || CASE depth WHEN 1 THEN nkey WHEN 2 THEN ckey ELSE okey END,
         dur_self, net_total, net_soql, heap_peak FROM net WHERE depth >= 1
  UNION ALL
  SELECT log_id, 2, key || ' > ' || CASE depth WHEN 2 THEN ckey || ' > ' || nkey ELSE okey || ' > ' || ckey END,
         dur_self, net_total, net_soql, heap_peak FROM net WHERE depth >= 2
  UNION ALL
  SELECT log_id, 3, key || ' > ' || okey || ' > ' || ckey || ' > ' || nkey,
         dur_self, net_total, net_soql, heap_peak FROM net WHERE depth >= 3)
"""


def _bottom_up_sql(where: str) -> str:
    return (
        KEYED
        + _REV
        + f"""SELECT log_id, depth, caller_path, count(*) AS calls, CAST(sum(dur_self) AS BIGINT) AS dur_self,
  CAST(sum(net_total) AS BIGINT) AS dur_total, CAST(sum(net_soql) AS BIGINT) AS soql_count_total,
  max(heap_peak) AS heap_peak
FROM rev {where} GROUP BY log_id, depth, caller_path"""
    )


def _bottom_up(spark, sf, max_depth):
    out = trees.bottom_up(order_tree(spark, sf), max_depth=max_depth)
    return out.select(
        "log_id", "depth", F.array_join("caller_path", " > ").alias("caller_path"), "calls",
        "dur_self", "dur_total", "soql_count_total", "heap_peak",
    )


@query("g3_bottom_up", _bottom_up_sql(""))
def _(spark, sf):
    return _bottom_up(spark, sf, None)


@query("g3_bottom_up_two_levels", _bottom_up_sql("WHERE depth < 2"))
def _(spark, sf):
    return _bottom_up(spark, sf, 2)


@query(
    "g4_event_and_stack_keys",
    KEYED + "SELECT log_id, key, stack, count(*) AS n FROM pk GROUP BY ALL",
)
def _(spark, sf):
    return (
        order_tree(spark, sf)
        .groupBy("log_id", tree.event_key().alias("key"), tree.stack_key().alias("stack"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "g6_method_metrics",
    KEYED
    + """SELECT log_id, type, namespace, text, count(*) AS calls, CAST(sum(dur_self) AS BIGINT) AS dur_self,
  CAST(sum(CASE WHEN depth = 3 AND stack IN (nstack, cstack, ostack) THEN 0 ELSE dur_total END) AS BIGINT) AS dur_total
FROM pk GROUP BY log_id, type, namespace, text""",
)
def _(spark, sf):
    return trees.method_metrics(order_tree(spark, sf))


# The logs' own limits: some are higher in one log than in another, some reported in a few logs only.
LOG_LIMITS = """, lim AS (SELECT CAST(r_regionkey AS VARCHAR) AS log_id,
  CASE WHEN r_regionkey <> 4 THEN 100 + 10 * r_regionkey END AS soql, CASE WHEN r_regionkey IN (0, 1) THEN 150 END AS dml,
  CASE WHEN r_regionkey = 1 THEN 0 WHEN r_regionkey = 2 THEN 20 END AS sosl, CASE WHEN r_regionkey IN (0, 3) THEN 50000 END AS soql_rows,
  CASE WHEN r_regionkey = 0 THEN 10000 END AS dml_rows, CASE WHEN r_regionkey IN (0, 2) THEN 6000000 * (r_regionkey + 1) END AS heap FROM region)
"""


def log_limits(spark, sf):
    key = F.col("r_regionkey")
    limit = {
        "soqlQueries": F.when(key != 4, 100 + 10 * key),
        "dmlStatements": F.when(key.isin(0, 1), 150),
        "soslQueries": F.when(key == 1, 0).when(key == 2, 20),
        "queryRows": F.when(key.isin(0, 3), 50_000),
        "dmlRows": F.when(key == 0, 10_000),
        "heapSize": F.when(key.isin(0, 2), 6_000_000 * (key + 1)),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("long").alias("limit")) for m, v in limit.items()])
    region = spark.read.parquet(f"{sf}/region.parquet")
    return region.select(key.cast("string").alias("log_id"), F.inline(rows)).filter("limit IS NOT NULL")


_PERCENTS = ", ".join(
    f"CASE WHEN {limit} > 0 THEN {used} * 1.0 / {limit} * 100 END"
    for used, limit in [
        ("soql_count_total", "soql"), ("dml_count_total", "dml"), ("sosl_count_total", "sosl"),
        ("soql_rows_total", "soql_rows"), ("dml_rows_total", "dml_rows"), ("heap_peak", "heap"),
    ]
)


@query(
    "g7_governor_cost",
    TREE
    + LOG_LIMITS
    + f"""SELECT log_id, event_index, coalesce(round(list_avg(p), 6), 0.0) AS governor_cost, coalesce(round(list_max(p), 6), 0.0) AS governor_cost_max,
  len(list_filter(p, lambda x: x > 0)) AS parts FROM (SELECT log_id, event_index, [{_PERCENTS}] AS p FROM tree LEFT JOIN lim USING (log_id))""",
)
def _(spark, sf):
    return trees.governor_cost(order_tree(spark, sf), log_limits(spark, sf)).select(
        "log_id",
        "event_index",
        F.round("governor_cost", 6).alias("governor_cost"),
        F.round("governor_cost_max", 6).alias("governor_cost_max"),
        F.size("governor_cost_parts").alias("parts"),
    )


@query(
    "g8_has_details_deep",
    TREE
    + """SELECT a.log_id, a.event_index, a.dur_total > 0 OR a.is_parent OR coalesce(b.n, 0) > 0 AS time_order,
  a.dur_total > 0 OR coalesce(b.timed, 0) > 0 AS grouped
FROM tree a LEFT JOIN (
  SELECT log_id, parent_index, sum(CASE WHEN dur_total > 0 OR is_parent THEN 1 ELSE 0 END) AS n,
         sum(CASE WHEN dur_total > 0 THEN 1 ELSE 0 END) AS timed
  FROM tree GROUP BY log_id, parent_index) b
ON a.log_id = b.log_id AND a.event_index = b.parent_index""",
)
def _(spark, sf):
    spans = order_tree(spark, sf).withColumn("discontinuity", F.lit(False))
    shown = tree.contains(spans, trees.significant(True), "time_order")
    return tree.contains(shown, trees.significant(), "grouped").select(
        "log_id", "event_index", "time_order", "grouped"
    )


# Selection used by the scoped queries: SOQL statements and every tenth customer frame.
PICK = "(type = 'SOQL_EXECUTE_BEGIN' OR (depth = 1 AND event_index % 10 = 0))"


def pick():
    return F.expr(PICK)


_OUTER = (
    TREE
    + f""", sel AS (SELECT * FROM tree WHERE {PICK}),
outer_sel AS (
  SELECT * FROM sel s WHERE NOT EXISTS (
    SELECT 1 FROM sel a WHERE a.log_id = s.log_id AND a.depth = 1 AND s.depth = 2 AND a.ck = s.ck))
"""
)


@query("g9_outermost", _OUTER + "SELECT log_id, event_index FROM outer_sel")
def _(spark, sf):
    return tree.outermost(order_tree(spark, sf), pick()).select("log_id", "event_index")


@query(
    "g10_sum_outermost",
    _OUTER + "SELECT log_id, CAST(sum(dur_total) AS BIGINT) AS dur_total FROM outer_sel GROUP BY log_id",
)
def _(spark, sf):
    return tree.sum_outermost(order_tree(spark, sf), pick())


@query(
    "g16_self_time_by_category",
    TREE
    + """SELECT log_id, CASE category WHEN '' THEN 'Other' ELSE category END AS category,
  CAST(sum(dur_self) AS BIGINT) AS self_ns FROM tree GROUP BY ALL HAVING sum(dur_self) > 0""",
)
def _(spark, sf):
    return views.self_time_by_category(order_tree(spark, sf))


@query(
    "g16_self_time_by_category_traces",
    TRACE
    + """SELECT log_id, CASE category WHEN '' THEN 'Other' ELSE category END AS category,
  CAST(sum(dur_self) AS BIGINT) AS self_ns FROM trace GROUP BY ALL HAVING sum(dur_self) > 0""",
)
def _(spark, sf):
    return views.self_time_by_category(user_traces(spark, sf))


@query(
    "g17_category_legend",
    TREE
    + """SELECT l.log_id, c.position, c.category, CAST(coalesce(sum(t.dur_self), 0) AS BIGINT) AS self_ns
FROM (SELECT DISTINCT log_id FROM tree) l
CROSS JOIN (VALUES (0, 'Apex'), (1, 'Code Unit'), (2, 'System'), (3, 'Automation'), (4, 'DML'),
            (5, 'SOQL'), (6, 'Callout')) c(position, category)
LEFT JOIN tree t ON t.log_id = l.log_id AND t.category = c.category GROUP BY ALL""",
)
def _(spark, sf):
    return views.category_legend(order_tree(spark, sf))


@query(
    "g18_self_time_by_namespace",
    TREE
    + """SELECT log_id, namespace, CAST(sum(dur_self) AS BIGINT) AS self_ns FROM tree
GROUP BY ALL HAVING sum(dur_self) > 0""",
)
def _(spark, sf):
    return views.self_time_by_namespace(order_tree(spark, sf))


@query(
    "g18_self_time_by_namespace_scoped",
    TREE
    + f""", sel AS (SELECT * FROM tree WHERE {PICK})
SELECT log_id, namespace, CAST(sum(dur_self) AS BIGINT) AS self_ns FROM tree t
WHERE EXISTS (SELECT 1 FROM sel s WHERE s.log_id = t.log_id AND s.depth = 1 AND s.ck = t.ck)
   OR EXISTS (SELECT 1 FROM sel s WHERE s.log_id = t.log_id AND s.depth = 2 AND s.ok = t.ok)
GROUP BY ALL HAVING sum(dur_self) > 0""",
)
def _(spark, sf):
    return views.self_time_by_namespace(order_tree(spark, sf), pick())


@query(
    "g19_caller_namespace",
    TREE
    + """SELECT log_id, event_index, CASE depth WHEN 0 THEN 'default' WHEN 1 THEN first_value(namespace) OVER a
  WHEN 2 THEN first_value(namespace) OVER b ELSE first_value(namespace) OVER c END AS caller_namespace FROM tree
WINDOW a AS (PARTITION BY log_id, nk ORDER BY event_index), b AS (PARTITION BY log_id, nk, ck ORDER BY depth, event_index),
  c AS (PARTITION BY log_id, nk, ck, ok ORDER BY depth, event_index)""",
)
def _(spark, sf):
    return tree.caller_namespace(order_tree(spark, sf)).select(
        "log_id", "event_index", "caller_namespace"
    )


_NODES = (
    KEYED
    + """, nodes AS (
  SELECT log_id, key_path, depth, CASE depth WHEN 0 THEN '' WHEN 1 THEN nkey
           WHEN 2 THEN nkey || ' > ' || ckey ELSE nkey || ' > ' || ckey || ' > ' || okey END AS parent_path,
         sum(dur_total) AS total, sum(dur_self) AS self, count(*) AS calls, min(event_index) AS first_index,
         arg_max(event_index, dur_total * 1000000 - event_index) AS event_index,
         arg_max(text, dur_total * 1000000 - event_index) AS text,
         arg_max(category, dur_total * 1000000 - event_index) AS category
  FROM pk GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY log_id, parent_path ORDER BY total DESC, first_index) AS rn FROM nodes),
edges AS (
  SELECT r.* FROM ranked r LEFT JOIN nodes p ON p.log_id = r.log_id AND p.key_path = r.parent_path
  WHERE rn = 1 AND r.total > 0
    AND (r.depth = 0 OR (r.total >= 0.4 * p.total AND p.self <= r.total))),
hot AS (
  SELECT e0.* FROM edges e0 WHERE depth = 0
  UNION ALL SELECT e1.* FROM edges e1 JOIN edges e0 ON e0.depth = 0 AND e1.depth = 1
    AND e0.log_id = e1.log_id AND e1.parent_path = e0.key_path
  UNION ALL SELECT e2.* FROM edges e2 JOIN edges e1 ON e1.depth = 1 AND e2.depth = 2
    AND e2.log_id = e1.log_id AND e2.parent_path = e1.key_path
    JOIN edges e0 ON e0.depth = 0 AND e1.parent_path = e0.key_path AND e0.log_id = e1.log_id
  UNION ALL SELECT e3.* FROM edges e3 JOIN edges e2 ON e2.depth = 2 AND e3.depth = 3
    AND e3.log_id = e2.log_id AND e3.parent_path = e2.key_path
    JOIN edges e1 ON e1.depth = 1 AND e2.log_id = e1.log_id AND e2.parent_path = e1.key_path
    JOIN edges e0 ON e0.depth = 0 AND e1.parent_path = e0.key_path AND e0.log_id = e1.log_id),
tip AS (
  SELECT log_id, arg_max(key_path, depth) AS key_path, max(depth) AS depth, arg_max(total, depth) AS total,
         arg_max(least(greatest(self, 0), total), depth) AS self
  FROM hot GROUP BY log_id),
fans AS (
  SELECT n.*, tip.depth AS tip_depth FROM nodes n JOIN tip ON n.log_id = tip.log_id AND n.parent_path = tip.key_path
  WHERE tip.self < 0.5 * tip.total AND n.total >= 0.05 * tip.total),
shown AS (SELECT 'path' AS kind, depth + 1 AS step, log_id, text, category, event_index, total, self, calls FROM hot
  UNION ALL SELECT 'branch', tip_depth + 2, log_id, text, category, event_index, total, self, calls FROM fans)
"""
)


@query(
    "g21_hot_path",
    _NODES
    + """SELECT s.log_id, s.kind, s.step, s.text, s.category, s.event_index, CAST(s.total AS BIGINT) AS total_ns,
  CAST(least(greatest(s.self, 0), s.total) AS BIGINT) AS self_ns, s.calls,
  CASE WHEN EXISTS (SELECT 1 FROM fans f WHERE f.log_id = s.log_id) THEN 'fan-out' ELSE 'hot-spot' END AS path_end
FROM shown s""",
)
def _(spark, sf):
    return highlights.hot_path(order_tree(spark, sf))


_SPOT = """, seen AS (
  SELECT *, {until} AS until FROM {src}
  WINDOW w AS (PARTITION BY log_id, type, namespace, text ORDER BY event_index
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
spots AS (
  SELECT log_id, type, namespace, text, sum(greatest(dur_self, 0)) AS self_ns,
    sum(CASE WHEN until IS NULL OR ts_ns >= until THEN {total} ELSE 0 END) AS total_ns,
    count(*) AS calls, min(event_index) AS first_index,
    arg_max(event_index, CAST(dur_self AS HUGEINT) * 10000000 - event_index) AS event_index,
    arg_max(category, CAST(dur_self AS HUGEINT) * 10000000 - event_index) AS category
  FROM seen GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY self_ns DESC, first_index) AS rank
           FROM spots WHERE self_ns > 0)
SELECT log_id, rank, type, namespace, text, category, event_index, CAST(self_ns AS BIGINT) AS self_ns,
  CAST(greatest(total_ns, self_ns) AS BIGINT) AS total_ns, calls
FROM ranked WHERE rank <= 5"""


@query("g22_hot_spots", TRACE + _SPOT.format(src="trace", until="max(exit_ns) OVER w", total="dur_self"))
def _(spark, sf):
    return highlights.hot_spots(user_traces(spark, sf))


@query(
    "g22_hot_spots_tree",
    TREE + _SPOT.format(src="tree", until="max(ts_ns + dur_total) OVER w", total="dur_total"),
)
def _(spark, sf):
    return highlights.hot_spots(order_tree(spark, sf))


@query(
    "g23_truncation_regions",
    TREE
    + """, cutoff AS (SELECT *, depth = 2 AND ok % 7 = 0 OR depth = 3 AND ok % 14 = 0 AS is_truncated FROM tree)
SELECT t.log_id, count(*) AS regions, min(t.event_index) AS first_index
FROM cutoff t JOIN cutoff p ON p.log_id = t.log_id AND p.event_index = t.parent_index
WHERE t.is_truncated AND NOT p.is_truncated GROUP BY t.log_id""",
)
def _(spark, sf):
    # Statements of every seventh order are marked cut off; their lines too for every fourteenth.
    spans = order_tree(spark, sf)
    own = (F.col("depth") == 2) & F.col("o_key").isNotNull() & (F.col("o_key") % 7 == 0)
    line = (F.col("depth") == 3) & (F.col("o_key") % 14 == 0)
    return highlights.truncation_regions(
        spans.withColumn("is_truncated", F.coalesce(own | line, F.lit(False)))
    )


_TALLY = """, tally AS (
  SELECT log_id, type, namespace, text, count(*) AS calls, sum(dur_self) AS self_ns, max(dur_self) AS max_ns,
    min(event_index) AS first_index,
    arg_max(event_index, CAST(dur_self AS HUGEINT) * 10000000 - event_index) AS event_index
  FROM {src} WHERE dur_self > 0 GROUP BY ALL)
"""

_SPREAD = (
    _TALLY
    + """, lanes AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY self_ns DESC, first_index) AS rank
    FROM tally WHERE calls > 1 QUALIFY rank <= 5),
v AS (SELECT l.*, t.dur_self AS v, row_number() OVER (PARTITION BY l.log_id, l.type, l.namespace, l.text ORDER BY t.dur_self) AS rn
    FROM lanes l JOIN {src} t USING (log_id, type, namespace, text) WHERE t.dur_self > 0),
s AS (SELECT log_id, type, namespace, text, rank, calls, self_ns, max_ns, event_index,
    max(CASE WHEN rn = CAST(ceil(0.5 * calls) AS BIGINT) THEN v END) AS median_ns,
    max(CASE WHEN rn = CAST(ceil(0.95 * calls) AS BIGINT) THEN v END) AS p95_ns,
    """
    + ", ".join(
        f"count(*) FILTER (WHERE least(CAST(floor(CAST(v AS DOUBLE) / max_ns * 24) AS INT), 23) = {i}) AS b{i}"
        for i in range(24)
    )
    + """ FROM v GROUP BY ALL)
SELECT log_id, type, namespace, text, rank, calls, CAST(self_ns AS BIGINT) AS self_ns, median_ns, p95_ns,
  max_ns, event_index, concat_ws(',', """
    + ", ".join(f"b{i}" for i in range(24))
    + """) AS bins,
  round(CASE WHEN b0 > 0 THEN greatest(b0 / CAST(greatest("""
    + ", ".join(f"b{i}" for i in range(24))
    + """) AS DOUBLE) * 100, 10) ELSE 0 END, 6) AS first_height
FROM s"""
)


def _spread(spans):
    return highlights.self_time_spread(spans).select(
        "log_id", "type", "namespace", "text", "rank", "calls", "self_ns", "median_ns", "p95_ns",
        "max_ns", "event_index",
        F.array_join(F.col("bins").cast("array<string>"), ",").alias("bins"),
        F.round(F.element_at("heights", 1), 6).alias("first_height"),
    )


@query("g24_self_time_spread", TRACE + _SPREAD.replace("{src}", "trace"))
def _(spark, sf):
    return _spread(user_traces(spark, sf))


@query("g24_self_time_spread_tree", TREE + _SPREAD.replace("{src}", "tree"))
def _(spark, sf):
    return _spread(order_tree(spark, sf))


@query(
    "g25_singles",
    TREE
    + _TALLY.format(src="tree")
    + """SELECT log_id, type, namespace, text, row_number() OVER (PARTITION BY log_id ORDER BY self_ns DESC, first_index) AS rank,
  CAST(self_ns AS BIGINT) AS self_ns, event_index FROM tally WHERE calls = 1 QUALIFY rank <= 3""",
)
def _(spark, sf):
    return highlights.singles(order_tree(spark, sf))


_CONC = """, running AS (
  SELECT log_id, count(*) OVER (PARTITION BY log_id) AS total, sum(self_ns) OVER (PARTITION BY log_id) AS whole,
    coalesce(sum(self_ns) OVER (PARTITION BY log_id ORDER BY self_ns DESC, first_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tally)
SELECT log_id, count(*) FILTER (WHERE before < 0.8 * whole) AS signatures, total FROM running GROUP BY log_id, total"""


@query("g26_concentration", TREE + _TALLY.format(src="tree") + _CONC)
def _(spark, sf):
    return highlights.concentration(highlights.tallies(order_tree(spark, sf))).drop("held")


@query("g26_concentration_traces", TRACE + _TALLY.format(src="trace") + _CONC)
def _(spark, sf):
    return highlights.concentration(highlights.tallies(user_traces(spark, sf))).drop("held")


@query(
    "g27_bin_range",
    TREE
    + _TALLY.format(src="tree")
    + """SELECT log_id, type, namespace, text, i AS bin, round(max_ns / 24.0 * i, 6) AS low, round(max_ns / 24.0 * (i + 1), 6) AS high
FROM tally CROSS JOIN range(24) r(i)""",
)
def _(spark, sf):
    bins = highlights.tallies(order_tree(spark, sf)).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(highlights.BINS - 1)))
    )
    low, high = highlights.bin_range(F.col("max_ns"), F.col("bin"))
    return bins.select(
        "log_id", "type", "namespace", "text", "bin",
        F.round(low, 6).alias("low"), F.round(high, 6).alias("high"),
    )


@query(
    "g28_top_n_with_tail",
    TREE
    + """, g AS (SELECT log_id, text, CAST(sum(dur_self) AS BIGINT) AS v FROM tree GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY v DESC, text) AS rank FROM g)
SELECT log_id, rank, text AS label, v AS value FROM r WHERE rank <= 8
UNION ALL
SELECT log_id, 9, CAST(count(*) AS VARCHAR) || ' others', CAST(sum(v) AS BIGINT) FROM r WHERE rank > 8 GROUP BY log_id""",
)
def _(spark, sf):
    by_text = order_tree(spark, sf).groupBy("log_id", "text").agg(F.sum("dur_self").alias("v"))
    return views.top_n_with_tail(by_text, 8, "text", "v")


@query(
    "t6_call_stacks",
    KEYED
    + """, sel AS (SELECT * FROM pk WHERE type = 'SOSL_EXECUTE_BEGIN')
SELECT s.log_id, s.event_index, a.depth AS position, a.event_index AS frame_index, a.type, a.text
FROM sel s JOIN (SELECT * FROM tree WHERE depth = 0) a ON a.nk = s.nk
UNION ALL SELECT s.log_id, s.event_index, a.depth, a.event_index, a.type, a.text
FROM sel s JOIN (SELECT * FROM tree WHERE depth = 1) a ON a.ck = s.ck
UNION ALL SELECT log_id, event_index, depth, event_index, type, text FROM sel""",
)
def _(spark, sf):
    return tree.call_stack(order_tree(spark, sf), F.col("type") == "SOSL_EXECUTE_BEGIN")


@query(
    "t11_event_by_index",
    TREE + "SELECT log_id, event_index, depth, type, text FROM tree WHERE type = 'DML_BEGIN'",
)
def _(spark, sf):
    spans = order_tree(spark, sf)
    wanted = spans.filter(F.col("type") == "DML_BEGIN").select("log_id", "event_index")
    return tree.event_by_index(spans, wanted).select("log_id", "event_index", "depth", "type", "text")
