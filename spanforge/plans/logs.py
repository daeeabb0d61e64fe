"""Queries that start from trace-log text rendered from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import extract as x
from spanforge.operators import facts, issues, scan
from spanforge.operators.events import parse_errors, tag_lines
from spanforge.plans.registry import TRACE, TREE, query
from spanforge.session import cut
from spanforge.sources.logs import body_lines, log_duration
from spanforge.sources.parse import parse_logs
from spanforge.sources.tables import order_logs, table, user_logs

# A small slice, so that even the test tables are parsed in many slices.
SLICE = 5_000
_PARSED: dict = {}


def parsed(spark, sf, name, source):
    """Parse a rendered log set once per session; its tables are files already."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _PARSED:
        raw = cut(source(spark, sf))
        _PARSED[key] = parse_logs(body_lines(raw, SLICE), SLICE, raw)
    return _PARSED[key]


def order_parsed(spark, sf):
    return parsed(spark, sf, "orders", order_logs)


def user_parsed(spark, sf):
    return parsed(spark, sf, "users", user_logs)


def _ranked(spans):
    """Position among the spans of the log, which is the pre-order index of the tree."""
    shown = spans.filter(F.col("type") != "USER_INFO")
    return scan.running(
        shown, ["log_id"], ["event_index"], [scan.slice_of("event_index", SLICE)], {"position": ("sum", F.lit(1))}
    )


_SHARED = ["depth", "type", "namespace", "text", "category", "ts_ns", "dur_self", "dur_total"]
_COUNTERS = ["dml_count_total", "soql_count_total", "sosl_count_total", "dml_rows_total", "soql_rows_total",
             "sosl_rows_total", "heap_net_total", "heap_gross_total", "heap_peak", "heap_net_self"]


@query(
    "t1_spans_from_logs",
    TREE
    + f"SELECT log_id, event_index AS position, {', '.join(_SHARED)}, CASE WHEN is_parent THEN ts_ns + dur_total END AS exit_ns FROM tree",
)
def _(spark, sf):
    return _ranked(order_parsed(spark, sf).spans).select("log_id", "position", *_SHARED, "exit_ns")


@query("t8_totals_from_logs", TREE + f"SELECT log_id, event_index AS position, {', '.join(_COUNTERS)} FROM tree")
def _(spark, sf):
    return _ranked(order_parsed(spark, sf).spans).select("log_id", "position", *_COUNTERS)


@query(
    "s2_events_from_logs",
    TREE
    + """SELECT log_id, type, count(*) AS n FROM (
  SELECT log_id, type FROM tree
  UNION ALL SELECT log_id, CASE type WHEN 'CODE_UNIT_STARTED' THEN 'CODE_UNIT_FINISHED' WHEN 'METHOD_ENTRY' THEN 'METHOD_EXIT'
    WHEN 'SOQL_EXECUTE_BEGIN' THEN 'SOQL_EXECUTE_END' WHEN 'DML_BEGIN' THEN 'DML_END' ELSE 'SOSL_EXECUTE_END' END
  FROM tree WHERE is_parent
  UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 'USER_INFO' FROM region) GROUP BY log_id, type""",
)
def _(spark, sf):
    return order_parsed(spark, sf).events.groupBy("log_id", "type").agg(F.count("*").alias("n"))


@query(
    "s3_debug_levels",
    """SELECT CAST(r_regionkey AS VARCHAR) AS log_id, position, category, level FROM region
CROSS JOIN (VALUES (0, 'APEX_CODE', 'FINE'), (1, 'APEX_PROFILING', 'NONE'), (2, 'DB', 'INFO')) v(position, category, level)""",
)
def _(spark, sf):
    return order_parsed(spark, sf).debug_levels


@query(
    "s4_log_user",
    """SELECT CAST(r_regionkey AS VARCHAR) AS log_id, lower(r_name) || '@example.com' AS "user",
  '(GMT+00:00) GMT' AS timezone FROM region""",
)
def _(spark, sf):
    return order_parsed(spark, sf).users


@query(
    "s5_log_entry_point",
    TREE
    + """SELECT log_id, arg_min(text, event_index) AS entry_point, arg_min(text, event_index) AS detail
FROM tree WHERE depth = 0 GROUP BY log_id""",
)
def _(spark, sf):
    return facts.log_entry_point(order_parsed(spark, sf).spans)


@query(
    "s7_log_duration",
    TRACE
    + """SELECT log_id, CASE WHEN max(ts_ns) > min(ts_ns) THEN max(ts_ns) - min(ts_ns) END AS duration_ns FROM trace GROUP BY log_id""",
)
def _(spark, sf):
    # Every line becomes a start of the log's execution or a statement after it.
    lines = user_logs(spark, sf).join(
        user_traces_ts(spark, sf), ["log_id", "line_no"]
    )
    kind = F.when(F.col("line_no") == 1, "EXECUTION_STARTED").otherwise("STATEMENT_EXECUTE|[1]")
    line = F.concat(F.lit("10:00:00.0 ("), F.col("ts_ns").cast("string"), F.lit(")|"), kind)
    return log_duration(lines.select("log_id", "line_no", line.alias("line")))


def user_traces_ts(spark, sf):
    from spanforge.sources.tables import user_traces

    return user_traces(spark, sf).select("log_id", F.col("event_index").alias("line_no"), "ts_ns")


@query(
    "s1_body_lines",
    TRACE
    + """, l AS (SELECT *, CASE WHEN type = 'view' THEN '' WHEN type = 'purchase' THEN 'start' ELSE 'x' END AS k FROM trace)
SELECT log_id, event_index AS line_no FROM l t WHERE k <> '' AND event_index >= coalesce(
  (SELECT min(event_index) FROM l s WHERE s.log_id = t.log_id AND k = 'start'), 0)""",
)
def _(spark, sf):
    from spanforge.sources.tables import user_traces

    line = (
        F.when(F.col("type") == "view", "")
        .when(F.col("type") == "purchase", "10:00:00.0 (5)|EXECUTION_STARTED")
        .otherwise("10:00:00.0 (5)|STATEMENT_EXECUTE|[1]")
    )
    lines = user_traces(spark, sf).select("log_id", F.col("event_index").alias("line_no"), line.alias("line"))
    return body_lines(lines, 20).select("log_id", "line_no")


_HOSTED = (
    TRACE
    + """, ln AS (SELECT *, NOT type = 'view' AS is_event FROM trace),
ev0 AS (SELECT *, CAST(sum(CAST(is_event AS INT)) OVER (PARTITION BY log_id ORDER BY event_index) AS BIGINT) AS idx FROM ln),
ev AS (SELECT a.*, a.type = 'view' AND a.cents % 2 = 0 AND a.idx > 0 AND h.type = 'error' AS is_text
  FROM ev0 a LEFT JOIN ev0 h ON h.is_event AND h.log_id = a.log_id AND h.idx = a.idx)
"""
)


@query(
    "p33_parse_errors",
    _HOSTED
    + """SELECT log_id, 'Unsupported log event name: NOT_KNOWN_' || CASE WHEN cents % 3 = 0 THEN 'A' ELSE 'B' END AS message,
  min(event_index) AS line_no FROM ev WHERE type = 'view' AND cents % 2 = 1 GROUP BY ALL
UNION ALL SELECT log_id, 'Invalid log line: *** Skipped ' || CAST(cents AS VARCHAR) || ' bytes of detailed log', event_index
FROM ev WHERE type = 'view' AND cents % 2 = 0 AND idx = 0""",
)
def _(spark, sf):
    return user_parsed(spark, sf).parse_errors


@query(
    "p33_invalid_lines_of_documents",
    """SELECT log_id, count(*) AS errors FROM (
  SELECT CAST(doc_id AS VARCHAR) AS log_id, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE line <> '' AND NOT regexp_matches(split_part(line, '|', 2), '^[A-Z_]+$') GROUP BY log_id""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("log_id"), F.posexplode(F.split("text", "\n")).alias("p", "line")
    )
    lines = docs.select("log_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")
    errors = parse_errors(cut(tag_lines(lines.filter(F.col("line") != ""))))
    return (
        errors.filter(F.col("message").startswith("Invalid"))
        .groupBy("log_id")
        .agg(F.count("*").alias("errors"))
    )


@query(
    "t12_t13_issues",
    _HOSTED
    + """, e AS (SELECT log_id, idx, type, cents, ts_ns FROM ev WHERE is_event),
ends AS (SELECT log_id, max(ts_ns) AS last_ts, min(ts_ns) FILTER (WHERE type = 'signup') AS m FROM e GROUP BY log_id),
first_open AS (SELECT log_id, min(idx) AS fo, max(idx) FILTER (WHERE type = 'signup') AS lo FROM e WHERE type = 'signup' GROUP BY log_id),
skips AS (SELECT ev.log_id, min(idx) AS host FROM ev WHERE type = 'view' AND cents % 2 = 0 AND idx > 0 AND NOT is_text GROUP BY ev.log_id)
SELECT s.log_id, 'skip' AS type, 'Skipped-Lines' AS summary, s.host AS event_index, h.ts_ns AS start_ns,
  coalesce((SELECT min(n.ts_ns) FROM e n WHERE n.log_id = s.log_id AND n.type = 'signup' AND n.idx > s.host), x.last_ts) AS end_ns
FROM skips s JOIN e h ON h.log_id = s.log_id AND h.idx = s.host JOIN ends x ON x.log_id = s.log_id
UNION ALL
SELECT log_id, 'error', 'System.LimitException: Too many SOQL queries: ' || CAST(cents % 3 AS VARCHAR), min(idx), min(ts_ns), NULL
FROM e WHERE type = 'error' GROUP BY ALL
UNION ALL
SELECT f.log_id, 'unexpected', 'Unexpected-End', f.lo, x.last_ts, NULL FROM first_open f JOIN ends x USING (log_id)""",
)
def _(spark, sf):
    return user_parsed(spark, sf).issues.select("log_id", "type", "summary", "event_index", "start_ns", "end_ns")


@query(
    "q18_issue_severity",
    _HOSTED
    + """SELECT log_id, severity, count(*) AS n FROM (
  SELECT DISTINCT log_id, 'Error' AS severity, CAST(cents % 3 AS VARCHAR) AS k FROM ev WHERE type = 'error'
  UNION ALL SELECT DISTINCT log_id, 'Warning', 'open' FROM ev WHERE type = 'signup'
  UNION ALL SELECT DISTINCT log_id, 'Info', 'skip' FROM ev WHERE type = 'view' AND cents % 2 = 0 AND idx > 0 AND NOT is_text
  UNION ALL SELECT DISTINCT log_id, 'Warning', 'u' || CAST(cents % 3 = 0 AS VARCHAR) FROM ev WHERE type = 'view' AND cents % 2 = 1
  UNION ALL SELECT log_id, 'Warning', 'i' FROM ev WHERE type = 'view' AND cents % 2 = 0 AND idx = 0)
GROUP BY log_id, severity""",
)
def _(spark, sf):
    p = user_parsed(spark, sf)
    return issues.notices(p.issues, p.parse_errors).groupBy("log_id", "severity").agg(F.count("*").alias("n"))


@query(
    "r7_exceptions",
    _HOSTED
    + """, more AS (SELECT log_id, idx, string_agg(chr(10) || '*** Skipped ' || CAST(cents AS VARCHAR) || ' bytes of detailed log', '' ORDER BY event_index) AS x
  FROM ev WHERE is_text GROUP BY log_id, idx)
SELECT log_id, idx AS event_index, 'System.LimitException: Too many SOQL queries: ' || CAST(cents % 3 AS VARCHAR) || coalesce(x, '') AS text
FROM ev LEFT JOIN more USING (log_id, idx) WHERE type = 'error'""",
)
def _(spark, sf):
    return issues.exceptions(user_parsed(spark, sf).events).select("log_id", "event_index", "text")


@query(
    "r2_heap_seed",
    _HOSTED
    + """, h AS (SELECT log_id, idx AS event_index, CASE type WHEN 'click' THEN cents END AS b FROM ev WHERE is_event)
SELECT log_id, event_index, b AS heap_bytes, CAST(sum(b) OVER (PARTITION BY log_id ORDER BY event_index) AS BIGINT) AS live
FROM h WHERE b IS NOT NULL""",
)
def _(spark, sf):
    from spanforge.operators.rollup import live_heap

    events = user_parsed(spark, sf).events
    leaves = events.filter(F.col("type") == "HEAP_ALLOCATE").select(
        "log_id", "event_index", F.col("bytes").alias("heap_bytes")
    )
    return live_heap(leaves, "heap_bytes", size=10)


@query(
    "p3_p4_wall_clock",
    _HOSTED
    + """, e AS (SELECT log_id, idx, ts_ns FROM ev WHERE is_event),
f AS (SELECT log_id, arg_min(ts_ns, idx) AS first_ts FROM e GROUP BY log_id)
SELECT e.log_id, idx AS event_index, round((first_ts // 1000000000) % 86400 * 1000 + 500 + (ts_ns - first_ts) / 1e6, 3) AS wall_ms
FROM e JOIN f USING (log_id)""",
)
def _(spark, sf):
    events = user_parsed(spark, sf).events
    begun = facts.start_of_day_ms(events)
    rows = events.select("log_id", "event_index", "ts_ns").join(begun, "log_id")
    wall = x.event_wall_ms(F.col("start_ms"), F.col("ts_ns"), F.col("first_ts"))
    return rows.select("log_id", "event_index", F.round(wall, 3).alias("wall_ms"))


@query(
    "p20_coded_limits",
    _HOSTED
    + """SELECT log_id, idx AS event_index, 'soqlQueries' AS metric, cents % 100 AS used, 100 AS "limit" FROM ev WHERE type = 'purchase'""",
)
def _(spark, sf):
    events = user_parsed(spark, sf).events.filter(F.col("limit_obs.metric").isNotNull())
    return events.select("log_id", "event_index", "limit_obs.metric", "limit_obs.used", "limit_obs.limit")


@query(
    "p22_known_namespaces",
    TREE + "SELECT log_id, namespace FROM tree WHERE type IN ('METHOD_ENTRY', 'CODE_UNIT_STARTED') GROUP BY ALL",
)
def _(spark, sf):
    return order_parsed(spark, sf).namespaces.select("log_id", "namespace")


@query(
    "t14_span_lines",
    TREE
    + """, cum AS (SELECT *, CAST(sum(CAST(is_parent AS INT)) OVER (PARTITION BY log_id ORDER BY event_index) AS BIGINT) AS upto FROM tree),
placed AS (SELECT a.*, a.event_index + a.upto - CAST(a.is_parent AS INT) - a.depth + 2 AS entry_line,
    a.last_index + z.upto - a.depth + 2 AS exit_line FROM cum a JOIN cum z ON z.log_id = a.log_id AND z.event_index = a.last_index),
stamps AS (SELECT log_id, ts_ns AS ts, entry_line AS n FROM placed
  UNION ALL SELECT log_id, ts_ns + dur_total, exit_line FROM placed WHERE is_parent
  UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 0, 2 FROM region),
first AS (SELECT log_id, ts, min(n) AS n FROM stamps GROUP BY ALL)
SELECT p.log_id, p.ts_ns, p.ts_ns + p.dur_total AS exit_ns, s.n AS start_line, e.n AS end_line FROM placed p
JOIN first s ON s.log_id = p.log_id AND s.ts = p.ts_ns JOIN first e ON e.log_id = p.log_id AND e.ts = p.ts_ns + p.dur_total
WHERE p.is_parent AND e.n > s.n""",
)
def _(spark, sf):
    from spanforge.operators.ranges import span_lines

    p = order_parsed(spark, sf)
    found = span_lines(p.spans, p.lines, SLICE)
    times = p.spans.select("log_id", "event_index", "ts_ns", "exit_ns")
    return found.join(times, ["log_id", "event_index"]).select("log_id", "ts_ns", "exit_ns", "start_line", "end_line")


@query(
    "r6_governor_totals",
    TREE
    + """, b AS (SELECT log_id, event_index, 'n' || CAST(nk % 2 AS VARCHAR) AS namespace, soql_count_total AS used, heap_peak FROM tree WHERE depth = 0),
last AS (SELECT log_id, namespace, arg_max(used, event_index) AS used, max(used) AS peak FROM b GROUP BY ALL),
live AS (SELECT log_id, max(heap_peak) AS live FROM tree GROUP BY log_id)
SELECT log_id, 'soqlQueries' AS metric, CAST(sum(used) AS BIGINT) AS used, 100 AS "limit" FROM last GROUP BY log_id
UNION ALL SELECT l.log_id, 'heapSize', greatest(max(peak), any_value(live)), 100 FROM last l JOIN live USING (log_id) GROUP BY l.log_id""",
)
def _(spark, sf):
    from spanforge.sources.tables import order_tree

    spans = order_tree(spark, sf)
    n = F.concat(F.lit("n"), (F.regexp_extract("text", r"(\d+)$", 1).cast("int") % 2).cast("string"))
    blocks = spans.filter(F.col("depth") == 0).select(
        "log_id", "event_index", n.alias("namespace"), F.col("soql_count_total").alias("used"),
        F.explode(F.array(F.lit("soqlQueries"), F.lit("heapSize"))).alias("metric"), F.lit(100).cast("long").alias("limit"),
    )
    return facts.governor_totals(blocks, spans)


def supplier_lines(spark, sf, body):
    """One line per supplier, one log per nation; `body` follows the time stamp."""
    s = table(spark, sf, "supplier")
    ts = (F.col("s_suppkey") + 1) * 10
    line = F.concat(F.lit("10:00:00.0 ("), ts.cast("string"), F.lit(")|"), body)
    return s.select(
        F.col("s_nationkey").cast("string").alias("log_id"), (F.col("s_suppkey") + 1).alias("line_no"), line.alias("line")
    )


@query(
    "p9_code_units",
    """SELECT CAST(s_nationkey AS VARCHAR) AS log_id, (s_suppkey + 1) * 10 AS ts_ns,
  CASE s_suppkey % 5 WHEN 0 THEN 'ns0.Cls.run()' WHEN 1 THEN 'T on A trigger event BeforeInsert' WHEN 2 THEN 'Workflow:Account'
    WHEN 3 THEN 'VF: /apex/pk__Page' ELSE 'apex://abc.Ctrl/ACTION$run' END AS text,
  CASE s_suppkey % 5 WHEN 0 THEN 'ns0' WHEN 1 THEN 'nsq' WHEN 2 THEN 'default' WHEN 3 THEN 'pk' ELSE 'abc' END AS namespace,
  CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN '__sfdc_trigger' WHEN 2 THEN 'Workflow' WHEN 3 THEN 'VF' ELSE 'apex' END AS unit_type,
  CASE s_suppkey % 5 WHEN 2 THEN 'custom' ELSE 'method' END AS cpu_type FROM supplier""",
)
def _(spark, sf):
    from spanforge.operators.events import to_fields, with_continuations

    k = F.col("s_suppkey") % 5
    body = F.concat(
        F.lit("CODE_UNIT_STARTED|[EXTERNAL]|"),
        F.when(k == 0, "01p|ns0.Cls.run()")
        .when(k == 1, "01q|T on A trigger event BeforeInsert|__sfdc_trigger/nsq/T")
        .when(k == 2, "Workflow:Account")
        .when(k == 3, "01r|VF: /apex/pk__Page")
        .otherwise("apex://abc.Ctrl/ACTION$run"),
    )
    fields = to_fields(with_continuations(tag_lines(supplier_lines(spark, sf, body))))
    return fields.select("log_id", "ts_ns", "text", F.col("own_ns").alias("namespace"), "unit_type", "cpu_type")


@query(
    "t7_package_runs",
    """WITH l AS (SELECT CAST(s_nationkey AS VARCHAR) AS log_id, (s_suppkey + 1) * 10 AS ts, s_acctbal > 5000 AS ns FROM supplier),
n AS (SELECT *, lead(ts) OVER w AS next_ts, CASE WHEN ns = lag(ns) OVER w THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY log_id ORDER BY ts)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY log_id ORDER BY ts) AS run FROM n),
r AS (SELECT log_id, run, min(ts) AS ts_ns, arg_max(coalesce(next_ts, ts), ts) AS run_end, count(*) AS members FROM i GROUP BY ALL)
SELECT log_id, ts_ns, CASE WHEN max(members) OVER (PARTITION BY log_id) > 1 OR run < max(run) OVER (PARTITION BY log_id)
  THEN run_end - ts_ns ELSE 0 END AS dur_total FROM r""",
)
def _(spark, sf):
    body = F.concat(F.lit("ENTERING_MANAGED_PKG|"), F.when(F.col("s_acctbal") > 5000, "rich").otherwise("poor"))
    spans = parse_logs(body_lines(cut(supplier_lines(spark, sf, body))), SLICE).spans
    return spans.select("log_id", "ts_ns", "dur_total")
