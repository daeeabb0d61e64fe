"""Findings, scoped trees and grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators import database as db
from spanforge.operators import findings as fd
from spanforge.operators import grids, scoped, trees
from spanforge.operators import limits as lim
from spanforge.operators.issues import exceptions
from spanforge.operators.scan import slice_of
from spanforge.operators.times import log_times
from spanforge.plans.database import STATEMENTS
from spanforge.plans.limits import OBSERVED, series_of
from spanforge.plans.logs import _HOSTED, user_parsed
from spanforge.plans.registry import TRACE, TREE, query
from spanforge.plans.trees import KEYED, LOG_LIMITS, PICK, log_limits, pick
from spanforge.sources.sinks import ns_as_ms
from spanforge.sources.tables import order_tree, table, user_traces

_EV = _HOSTED + ", e AS (SELECT log_id, idx, type, cents, ts_ns FROM ev WHERE is_event)\n"


@query(
    "q1_find_truncation",
    _EV
    + """, s AS (SELECT log_id, idx, cents, row_number() OVER (PARTITION BY log_id ORDER BY event_index) AS rn
  FROM ev WHERE type = 'view' AND cents % 2 = 0 AND idx > 0 AND NOT is_text)
SELECT log_id, 1 AS count, idx AS event_index, CASE WHEN cents > 0 THEN CAST(cents AS DOUBLE) END AS used FROM s WHERE rn = 1""",
)
def _(spark, sf):
    return fd.find_truncation(user_parsed(spark, sf).issues).select("log_id", "count", "event_index", "used")


@query(
    "q2_find_limits",
    OBSERVED
    + """, tot AS (SELECT log_id, max(used) AS used FROM series GROUP BY log_id),
thrown AS (SELECT log_id, min(event_index) AS pos FROM trace WHERE type = 'error' AND cents % 2 = 0 GROUP BY log_id)
SELECT log_id, 'dmlRows' AS subject, CASE WHEN pos IS NULL THEN 'Warning' ELSE 'Error' END AS severity,
  coalesce(pos, -1) AS event_index, CASE WHEN coalesce(used, 0) > 0 THEN CAST(used AS DOUBLE) END AS used
FROM tot FULL JOIN thrown USING (log_id) WHERE pos IS NOT NULL OR (used > 0 AND used / 10000.0 >= 0.8)""",
)
def _(spark, sf):
    # Every second error of a user is read as a limit exception that names the metric.
    spans = user_traces(spark, sf).withColumns(
        {
            "text": F.when(
                (F.col("type") == "error") & (F.col("cents") % 2 == 0), "System.LimitException: Too many DML rows: 10001"
            ).otherwise(F.col("text")),
            "type": F.when(F.col("type") == "error", "EXCEPTION_THROWN").otherwise(F.col("type")),
        }
    )
    totals = lim.limit_totals(series_of(spark, sf)).withColumn("has_limits", F.lit(True))
    return fd.find_limits(spans, totals).select("log_id", "subject", "severity", "event_index", "used")


@query(
    "q3_hot_cause",
    TRACE
    + """, t AS (SELECT log_id, text, sum(dur_self) AS s, min(event_index) AS f FROM trace WHERE dur_self > 0 GROUP BY ALL),
r AS (SELECT *, sum(s) OVER (PARTITION BY log_id) AS total, row_number() OVER (PARTITION BY log_id ORDER BY s DESC, f) AS rn FROM t)
SELECT log_id, text AS label, CAST(s AS BIGINT) AS self_ns, round(CAST(s AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share
FROM r WHERE rn = 1 AND CAST(s AS DOUBLE) / CAST(total AS DOUBLE) >= 0.2""",
)
def _(spark, sf):
    return fd.hot_cause(user_traces(spark, sf)).withColumn("share", F.round("share", 6))


@query(
    "q4_find_exceptions",
    TRACE
    + """SELECT log_id, 'Bad value ' || CAST(cents % 4 AS VARCHAR) AS subject,
  greatest(count(*) FILTER (WHERE cents % 5 > 0), 1) AS count, min(event_index) AS event_index,
  CASE WHEN bool_or(cents % 5 = 0) THEN 'unhandled' END AS detail
FROM trace WHERE type = 'error' GROUP BY ALL""",
)
def _(spark, sf):
    spans = user_traces(spark, sf)
    text = F.concat(F.lit("Bad value "), (F.col("cents") % 4).cast("string"), F.lit("\nClass.A.run: line 1"))
    kind = F.when(F.col("cents") % 5 == 0, "FATAL_ERROR").otherwise("EXCEPTION_THROWN")
    thrown = spans.filter(F.col("type") == "error").withColumns({"text": text, "type": kind})
    return fd.find_exceptions(thrown).select("log_id", "subject", "count", "event_index", "detail")


@query(
    "q5_find_anomalies",
    _EV + "SELECT log_id, 'Unexpected-End' AS subject, max(idx) AS event_index FROM e WHERE type = 'signup' GROUP BY log_id",
)
def _(spark, sf):
    return fd.find_anomalies(user_parsed(spark, sf).issues).select("log_id", "subject", "event_index")


_CALLED = (
    STATEMENTS
    + """, called AS (SELECT s.*, c.text AS frame, c.text || '|' || CAST(s.line_number AS VARCHAR) AS site
  FROM st s JOIN tree c ON c.log_id = s.log_id AND c.event_index = s.parent_index WHERE s.kind <> 'SOSL')
"""
)


@query(
    "q6_find_repeats_line",
    _CALLED
    + """SELECT log_id, kind || '|' || site || '|' || text AS subject, count(*) AS count,
  CAST(sum(dur_total) AS BIGINT) AS time_ns, min(event_index) AS event_index
FROM called GROUP BY log_id, kind, site, text HAVING count(*) >= 5""",
)
def _(spark, sf):
    return fd.find_repeats_line(order_tree(spark, sf)).select("log_id", "subject", "count", "time_ns", "event_index")


@query(
    "q7_find_repeats_text",
    _CALLED
    + """SELECT log_id, kind || '|' || text AS subject, count(*) AS count, CAST(sum(dur_total) AS BIGINT) AS time_ns,
  min(event_index) AS event_index, CAST(count(DISTINCT site) AS DOUBLE) AS used
FROM called GROUP BY log_id, kind, text HAVING count(*) >= 5 AND count(DISTINCT site) >= 2""",
)
def _(spark, sf):
    return fd.find_repeats_text(order_tree(spark, sf)).select(
        "log_id", "subject", "count", "time_ns", "event_index", "used"
    )


_ROWS_SQL = """SELECT log_id, shape AS subject, CAST(sum(n) AS BIGINT) AS count, CAST(sum(r) AS DOUBLE) AS used, min(pos) AS event_index
FROM (SELECT log_id, regexp_replace(text, '''(?:[^'']|'''')*''|\\b\\d+\\b', '?', 'g') AS shape, text, count(*) AS n,
    sum(n_rows {cut}) AS r, min(event_index) AS pos FROM st WHERE kind = 'SOQL' GROUP BY ALL)
GROUP BY log_id, shape HAVING sum(n) >= 5 AND count(*) >= 2 AND sum(r) <> 0 AND sum(r) <= sum(n) * 1.5"""


@query("q8_find_row_at_a_time", STATEMENTS + _ROWS_SQL.replace("{cut}", "% 3"))
def _(spark, sf):
    spans = order_tree(spark, sf).withColumn("soql_rows_self", F.col("soql_rows_self") % 3)
    return fd.find_row_at_a_time(spans).select("log_id", "subject", "count", "used", "event_index")


@query(
    "q10_find_debug",
    TRACE
    + """SELECT log_id, count(*) AS count, min(event_index) AS event_index FROM trace WHERE type IN ('view', 'click', 'error')
GROUP BY log_id HAVING count(*) >= 50""",
)
def _(spark, sf):
    kind = F.when(F.col("type").isin("view", "click", "error"), "USER_DEBUG").otherwise(F.col("type"))
    return fd.find_debug(user_traces(spark, sf).withColumn("type", kind)).select("log_id", "count", "event_index")


_LINT = (
    STATEMENTS
    + """, q AS (SELECT log_id, text, count(*) AS n, sum(dur_total) AS t, min(event_index) AS pos FROM st WHERE kind = 'SOQL' GROUP BY log_id, text)
"""
)


@query(
    "q11_find_lint",
    _LINT
    + """SELECT log_id, 'order_without_limit' AS subject, 'Info' AS severity, CAST(sum(n) AS BIGINT) AS count,
  CAST(sum(t) AS BIGINT) AS time_ns, arg_min(pos, -n * 10000000 + pos) AS event_index
FROM q WHERE contains(text, 'ORDER BY') AND NOT contains(text, 'LIMIT') GROUP BY log_id""",
)
def _(spark, sf):
    return fd.find_lint(fd.linted_texts(order_tree(spark, sf))).select(
        "log_id", "subject", "severity", "count", "time_ns", "event_index"
    )


# Query texts with varied clauses, one per part.
_QUERY_SQL = """SELECT p_partkey AS k, 'SELECT Id' || CASE WHEN p_partkey % 2 = 0 THEN ', (SELECT Id FROM Contacts WHERE Name LIKE ''%x'' LIMIT 3)' ELSE '' END
  || ' FROM ' || CASE WHEN p_partkey % 9 = 0 THEN 'A, A.B' ELSE 'Part__c' END
  || CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' WHERE Name LIKE ''%' || p_name || '''' WHEN 2 THEN ' WHERE Size__c != ' || CAST(p_size AS VARCHAR)
     WHEN 3 THEN ' WHERE (Name != ''limit'' OR Id IN (SELECT Id FROM C WHERE X <> 1)) AND Size__c > 3'
     WHEN 4 THEN ' WHERE LastModifiedDate < TODAY' WHEN 5 THEN ' WHERE NOT Name = ''a''' ELSE ' WHERE Size__c IN (1, 2)' END
  || CASE WHEN p_partkey % 3 = 0 THEN ' ORDER BY Name' ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN ' LIMIT ' || CAST(p_size AS VARCHAR) ELSE '' END AS q FROM part"""


def _queries(spark, sf):
    k = F.col("p_partkey")
    m = k % 7
    where = (
        F.when(m == 0, "")
        .when(m == 1, F.concat(F.lit(" WHERE Name LIKE '%"), "p_name", F.lit("'")))
        .when(m == 2, F.concat(F.lit(" WHERE Size__c != "), F.col("p_size").cast("string")))
        .when(m == 3, " WHERE (Name != 'limit' OR Id IN (SELECT Id FROM C WHERE X <> 1)) AND Size__c > 3")
        .when(m == 4, " WHERE LastModifiedDate < TODAY")
        .when(m == 5, " WHERE NOT Name = 'a'")
        .otherwise(" WHERE Size__c IN (1, 2)")
    )
    text = F.concat(
        F.lit("SELECT Id"),
        F.when(k % 2 == 0, ", (SELECT Id FROM Contacts WHERE Name LIKE '%x' LIMIT 3)").otherwise(""),
        F.lit(" FROM "),
        F.when(k % 9 == 0, "A, A.B").otherwise("Part__c"),
        where,
        F.when(k % 3 == 0, " ORDER BY Name").otherwise(""),
        F.when(k % 4 == 0, F.concat(F.lit(" LIMIT "), F.col("p_size").cast("string"))).otherwise(""),
    )
    return table(spark, sf, "part").select(k.alias("k"), text.alias("q"))


@query(
    "q12_lint_columns",
    f"""WITH p AS ({_QUERY_SQL})
SELECT k, k % 7 = 0 AND k % 4 <> 0 AS unbounded, k % 7 = 1 AS leading_wildcard, k % 7 IN (2, 5) AS negative_operator,
  k % 3 = 0 AND k % 4 <> 0 AS order_without_limit, k % 7 = 4 AS last_modified_upper_bound, FALSE AS in_trigger FROM p""",
)
def _(spark, sf):
    columns = tx.lint_columns(F.col("q"), F.lit(False))
    return _queries(spark, sf).select("k", *[c.alias(n) for n, c in columns.items()])


@query(
    "q13_query_traits",
    f"""WITH p AS ({_QUERY_SQL})
SELECT k, k % 2 = 1 AS is_simple_select, TRUE AS is_trivial, k % 3 = 0 AS is_ordered,
  CASE WHEN k % 4 = 0 THEN regexp_extract(q, 'LIMIT (\\d+)$', 1) END AS limit_value,
  CASE WHEN k % 9 <> 0 THEN 'Part__c' END AS from_object FROM p""",
)
def _(spark, sf):
    traits = tx.query_traits(F.col("q"))
    return _queries(spark, sf).select("k", *[c.alias(n) for n, c in traits.items()])


@query(
    "p26_object_behind_subqueries",
    f"WITH p AS ({_QUERY_SQL}) SELECT k, CASE WHEN k % 9 = 0 THEN 'A' ELSE 'Part__c' END AS object FROM p",
)
def _(spark, sf):
    return _queries(spark, sf).select("k", tx.from_object(F.col("q")).alias("object"))


_STATS = (
    _CALLED
    + """, lint AS (SELECT log_id, 'Info' AS severity, 'soql' AS rule FROM (
    SELECT DISTINCT log_id, text FROM st WHERE kind = 'SOQL') WHERE contains(text, 'ORDER BY') AND NOT contains(text, 'LIMIT') GROUP BY log_id),
every AS (
  SELECT * FROM lint
  UNION ALL SELECT log_id, 'Warning', 'repeat-line' FROM called GROUP BY log_id, kind, site, text HAVING count(*) >= 5
  UNION ALL SELECT log_id, 'Warning', 'repeat-text' FROM called GROUP BY log_id, kind, text HAVING count(*) >= 5 AND count(DISTINCT site) >= 2
  UNION ALL SELECT log_id, 'Warning', 'row-at-a-time' FROM ("""
    + _ROWS_SQL.replace("{cut}", "")
    + """))
"""
)


@query("q15_findings_by_rule", _STATS + "SELECT log_id, severity, rule, count(*) AS n FROM every GROUP BY ALL")
def _(spark, sf):
    return fd.find_statistics(order_tree(spark, sf)).groupBy("log_id", "severity", "rule").agg(F.count("*").alias("n"))


@query("q19_findings_by_severity", _STATS + "SELECT log_id, severity, count(*) AS findings FROM every WHERE severity = 'Warning' GROUP BY ALL")
def _(spark, sf):
    return fd.findings_by_severity(fd.find_statistics(order_tree(spark, sf)), ["Warning"])


@query(
    "q16_findings_coverage",
    STATEMENTS
    + """SELECT l.log_id, FALSE AS plans_known, count(DISTINCT text) AS linted, count(DISTINCT text) AS distinct_texts,
  any_value(exit_ns - start_ns) AS log_ns FROM logs l JOIN st USING (log_id) WHERE kind = 'SOQL' GROUP BY l.log_id""",
)
def _(spark, sf):
    spans = order_tree(spark, sf)
    return fd.findings_coverage(spans, log_times(spans))


@query(
    "q17_scope_findings",
    _CALLED
    + """, f AS (SELECT log_id, kind || '|' || text AS subject, min(event_index) AS pos FROM called
  GROUP BY log_id, kind, text HAVING count(*) >= 5 AND count(DISTINCT site) >= 2)
SELECT f.log_id, f.subject FROM f JOIN tree t ON t.log_id = f.log_id AND t.event_index = f.pos
JOIN tree c ON c.log_id = t.log_id AND c.event_index = t.parent_index WHERE c.text = 'Segment.BUILDING()'""",
)
def _(spark, sf):
    spans = order_tree(spark, sf)
    found = fd.find_repeats_text(spans)
    proof = found.select("log_id", "id", "event_index")
    picked = (F.col("depth") == 1) & (F.col("text") == "Segment.BUILDING()")
    return fd.scope_findings(found, proof, spans, picked).select("log_id", "subject")


@query(
    "q14_finding_time",
    STATEMENTS + "SELECT log_id, text, CAST(sum(dur_total) AS BIGINT) AS time_ns FROM st GROUP BY ALL",
)
def _(spark, sf):
    found = db.statements(order_tree(spark, sf))
    return fd.group_time(found, ["log_id", "text"])


@query(
    "p24_p25_exception_texts",
    _EV
    + """SELECT log_id, idx AS event_index, 'System.LimitException: Too many SOQL queries: ' || CAST(cents % 3 AS VARCHAR) AS summary,
  '' AS frame FROM e WHERE type = 'error'""",
)
def _(spark, sf):
    thrown = exceptions(user_parsed(spark, sf).events)
    summary, _ = tx.split_issue(F.col("text"))
    _, frame = tx.split_exception(F.col("text"))
    return thrown.select("log_id", "event_index", summary.alias("summary"), frame.alias("frame"))


@query(
    "p31_skipped_bytes",
    "SELECT event_id, CAST(round(value * 100) AS BIGINT) AS bytes FROM events",
)
def _(spark, sf):
    cents = F.round(F.col("value") * 100).cast("long")
    text = F.concat(F.lit("*** Skipped "), F.format_number(cents, 0), F.lit(" bytes of detailed log"))
    return table(spark, sf, "events").select("event_id", tx.skipped_bytes(text).alias("bytes"))


@query(
    "p29_event_labels",
    TREE
    + """SELECT log_id, type, text || CASE type WHEN 'CODE_UNIT_STARTED' THEN ' (code unit)' ELSE '' END AS label, count(*) AS n
FROM tree GROUP BY ALL""",
)
def _(spark, sf):
    suffix = F.when(F.col("type") == "CODE_UNIT_STARTED", " (code unit)")
    label = tx.event_label(F.col("text"), F.col("type"), suffix)
    return order_tree(spark, sf).groupBy("log_id", "type", label.alias("label")).agg(F.count("*").alias("n"))


# ---- scoped trees ------------------------------------------------------------------------------

_SCOPED = (
    KEYED
    + f""", sel AS (SELECT * FROM pk WHERE {PICK}),
below AS (
  SELECT s.event_index AS root, t.* FROM sel s JOIN pk t ON t.log_id = s.log_id
    AND t.event_index BETWEEN s.event_index AND s.last_index
  WHERE t.dur_total > 0 OR t.event_index = s.event_index OR (t.depth = 2)),
up AS (
  SELECT s.event_index AS root, s.log_id, a.event_index, a.depth, a.key_path, s.dur_total, 0 AS dur_self
  FROM sel s JOIN pk a ON a.log_id = s.log_id AND ((a.depth = 0 AND a.nk = s.nk) OR (a.depth = 1 AND a.ck = s.ck AND s.depth = 2))),
rows_ AS (
  SELECT log_id, event_index, root, depth, key_path, dur_total, dur_self, FALSE AS ancestor FROM below
  WHERE dur_total > 0 OR event_index = root
  UNION ALL SELECT log_id, event_index, root, depth, key_path, dur_total, dur_self, TRUE FROM up)
"""
)


@query("g11_scoped_tree", _SCOPED + "SELECT log_id, event_index, root, depth, dur_total, dur_self, ancestor FROM rows_")
def _(spark, sf):
    return scoped.scoped_tree(order_tree(spark, sf), pick()).select(
        "log_id", "event_index", "root", "depth", "dur_total", "dur_self", "ancestor"
    )


@query(
    "g12_scoped_top_down",
    _SCOPED
    + "SELECT log_id, key_path, CAST(sum(dur_total) AS BIGINT) AS dur_total, CAST(sum(dur_self) AS BIGINT) AS dur_self, count(*) AS calls FROM rows_ GROUP BY ALL",
)
def _(spark, sf):
    return scoped.scoped_top_down(order_tree(spark, sf), pick()).withColumn("key_path", F.array_join("key_path", " > "))


_REVERSED = """, parts AS (SELECT *, string_split(key_path, ' > ') AS p FROM rows_ WHERE dur_self > 0),
lv AS (SELECT *, unnest(range(1, len(p) + 1)) AS n FROM parts)
"""


@query(
    "g13_scoped_bottom_up",
    _SCOPED
    + _REVERSED
    + """SELECT log_id, array_to_string(list_reverse(p)[1:n], ' > ') AS caller_path, CAST(sum(dur_self) AS BIGINT) AS dur_total,
  count(*) AS calls, CAST(sum(CASE WHEN n = 1 THEN dur_self ELSE 0 END) AS BIGINT) AS dur_self FROM lv GROUP BY ALL""",
)
def _(spark, sf):
    return scoped.scoped_bottom_up(order_tree(spark, sf), pick()).withColumn(
        "caller_path", F.array_join("caller_path", " > ")
    )


@query("g14_whole_tree", TREE + "SELECT log_id, event_index FROM tree WHERE dur_total > 0 OR depth = 0")
def _(spark, sf):
    return scoped.whole_tree(order_tree(spark, sf)).select("log_id", "event_index")


@query(
    "g15_rows_by_event",
    _SCOPED
    + "SELECT log_id, event_index, string_agg(DISTINCT key_path, ';') AS rows FROM rows_ GROUP BY log_id, event_index",
)
def _(spark, sf):
    found = scoped.rows_by_event(scoped.row_occurrences(order_tree(spark, sf), pick()))
    return found.withColumn("rows", F.array_join("rows", ";"))


@query(
    "g20_event_vitals",
    TREE
    + LOG_LIMITS
    + f""", vit AS (SELECT log_id, count(*) AS calls, CAST(sum(dur_self) AS BIGINT) AS dur_self, CAST(sum(dur_total) AS BIGINT) AS dur_total,
  CAST(sum(soql_count_total) AS BIGINT) AS soql_count_total, max(heap_peak) AS heap_peak,
  round(CAST(sum(dur_total) AS DOUBLE) / count(*), 3) AS avg_total, min(event_index) AS first_index,
  sum(dml_rows_total) AS dml_rows_total, sum(sosl_rows_total) AS sosl_rows_total FROM tree WHERE {PICK} GROUP BY log_id)
SELECT v.log_id, calls, v.dur_self, v.dur_total, v.soql_count_total, v.heap_peak, avg_total, round(v.soql_count_total * 1.0 / soql * 100, 6) AS soql_percent,
  round(v.dml_rows_total * 1.0 / l.dml_rows * 100, 6) AS dml_rows_percent, f.type, f.namespace, coalesce(p.namespace, 'default') AS caller_namespace,
  CASE WHEN f.type = 'SOSL_EXECUTE_BEGIN' THEN round(v.sosl_rows_total / 2000.0 * 100, 6) END AS sosl_rows_percent
FROM vit v JOIN tree f ON f.log_id = v.log_id AND f.event_index = v.first_index
LEFT JOIN tree p ON p.log_id = f.log_id AND p.event_index = f.parent_index LEFT JOIN lim l ON l.log_id = v.log_id""",
)
def _(spark, sf):
    from spanforge.operators.vitals import event_vitals

    out = event_vitals(order_tree(spark, sf), pick(), log_limits(spark, sf))
    return out.select(
        "log_id", "calls", "dur_self", "dur_total", "soql_count_total", "heap_peak",
        F.round("avg_total", 3).alias("avg_total"), F.round("soql_count_percent", 6).alias("soql_percent"),
        F.round("dml_rows_percent", 6).alias("dml_rows_percent"), "type", "namespace", "caller_namespace",
        F.round("sosl_rows_percent", 6).alias("sosl_rows_percent"),
    )


# ---- grids -------------------------------------------------------------------------------------

_IN_A = "(type = 'METHOD_ENTRY' AND namespace = 'pkg' AND dur_total > 45000)"


@query(
    "f1_filter_deep",
    TREE
    + f""", hit AS (SELECT * FROM tree WHERE {_IN_A})
SELECT log_id, event_index FROM hit
UNION SELECT t.log_id, t.event_index FROM tree t SEMI JOIN hit h ON h.nk = t.nk WHERE t.depth = 0
UNION SELECT t.log_id, t.event_index FROM tree t SEMI JOIN hit h ON h.ck = t.ck WHERE t.depth = 1
UNION SELECT t.log_id, t.event_index FROM tree t SEMI JOIN hit h ON h.ok = t.ok WHERE t.depth = 2""",
)
def _(spark, sf):
    return grids.filter_deep(order_tree(spark, sf), F.expr(_IN_A)).select("log_id", "event_index")


_VISIBLE = (
    TREE
    + """, bad AS (SELECT * FROM tree WHERE dur_total < 50000),
vis AS (SELECT * FROM tree t WHERE dur_total >= 50000
  AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.depth = 2 AND t.depth = 3 AND b.ok = t.ok)
  AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.depth = 1 AND t.depth > 1 AND b.ck = t.ck)
  AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.depth = 0 AND t.depth > 0 AND b.nk = t.nk))
"""
)


@query("f2_filter_visible", _VISIBLE + "SELECT log_id, event_index FROM vis")
def _(spark, sf):
    return grids.filter_visible(order_tree(spark, sf), F.col("dur_total") >= 50000).select("log_id", "event_index")


@query("f2_sum_visible", _VISIBLE + "SELECT log_id, CAST(sum(dur_self) AS BIGINT) AS dur_self FROM vis GROUP BY log_id")
def _(spark, sf):
    return grids.sum_visible(order_tree(spark, sf), F.col("dur_total") >= 50000, "dur_self")


@query(
    "f3_ranges",
    TREE
    + """SELECT log_id, event_index FROM tree WHERE round(dur_total / 1000000.0, 3) BETWEEN 0.05 AND 0.2 AND soql_rows_total >= 3""",
)
def _(spark, sf):
    spans = order_tree(spark, sf)
    keep = grids.in_ms_range(F.col("dur_total"), 0.05, 0.2) & grids.in_count_range(F.col("soql_rows_total"), low=3)
    return spans.filter(keep).select("log_id", "event_index")


@query(
    "f4_facets",
    STATEMENTS + "SELECT log_id, sobject AS value FROM st WHERE sobject IS NOT NULL AND kind = 'SOQL' GROUP BY ALL",
)
def _(spark, sf):
    return grids.facet_values(db.soql_grid(order_tree(spark, sf)), "sobject")


@query(
    "f4_facet_filter",
    STATEMENTS + "SELECT log_id, event_index FROM st WHERE kind = 'SOQL' AND sobject IN ('Order_1__c', 'Order_5__c')",
)
def _(spark, sf):
    grid = db.soql_grid(order_tree(spark, sf))
    return grids.facet_filter(grid, "sobject", ["Order_1__c", "Order_5__c"]).select("log_id", "event_index")


@query(
    "f5_filter_tree",
    TREE
    + """, a AS (SELECT * FROM tree t WHERE namespace = 'pkg' OR EXISTS (SELECT 1 FROM tree h WHERE h.namespace = 'pkg'
  AND ((t.depth = 0 AND h.nk = t.nk) OR (t.depth = 1 AND h.ck = t.ck) OR (t.depth = 2 AND h.ok = t.ok)))),
b AS (SELECT * FROM a t WHERE type = 'METHOD_ENTRY' OR EXISTS (SELECT 1 FROM a h WHERE h.type = 'METHOD_ENTRY'
  AND ((t.depth = 0 AND h.nk = t.nk) OR (t.depth = 2 AND h.ok = t.ok))))
SELECT log_id, event_index FROM b t WHERE round(dur_total / 1000000.0, 3) >= 0.04 OR EXISTS (
  SELECT 1 FROM b h WHERE round(h.dur_total / 1000000.0, 3) >= 0.04
  AND ((t.depth = 0 AND h.nk = t.nk) OR (t.depth = 1 AND h.ck = t.ck) OR (t.depth = 2 AND h.ok = t.ok)))""",
)
def _(spark, sf):
    kept = grids.filter_tree(
        order_tree(spark, sf), namespaces=["pkg"], types=["METHOD_ENTRY"], total_ms=(0.04, None)
    )
    return kept.select("log_id", "event_index")


@query(
    "f6_group_grid",
    STATEMENTS
    + """SELECT log_id, sobject AS "group", count(*) AS rows, CAST(sum(dur_total) AS BIGINT) AS time_ns FROM st WHERE kind = 'SOQL' GROUP BY ALL""",
)
def _(spark, sf):
    grid = db.soql_grid(order_tree(spark, sf)).drop("rows")
    return grids.group_grid(grid, "sobject", {"time_ns": "sum"}, sort="time_ns")


@query(
    "f7_footer",
    TREE
    + """SELECT log_id, CAST(sum(dur_self) AS BIGINT) AS dur_self, CAST(sum(soql_count_self) AS BIGINT) AS soql_count_self,
  max(heap_peak) AS heap_peak FROM tree GROUP BY log_id""",
)
def _(spark, sf):
    return grids.footer(order_tree(spark, sf), ["dur_self", "soql_count_self"], ["heap_peak"])


@query(
    "f8_find_in_documents",
    """WITH m AS (SELECT lang, doc_id, len(regexp_extract_all(lower(text), 're')) + len(regexp_extract_all(lower(source), 're')) AS matches FROM documents)
SELECT lang, doc_id, matches, first_match FROM (
  SELECT *, CAST(coalesce(sum(matches) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_match FROM m)
WHERE matches > 0""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "doc_id", "text", "source")
    found = grids.find(docs, "RE", ["text", "source"], ["lang"], ["doc_id"], [slice_of("doc_id", 1000)])
    return found.select("lang", "doc_id", "matches", "first_match")


@query(
    "f9_column_view",
    KEYED
    + """SELECT log_id, text, namespace, count(*) AS calls, round(sum(dur_self) / count(*), 6) AS avg_self,
  CAST(sum(dur_total) AS BIGINT) AS dur_total, CAST(sum(dur_self) AS BIGINT) AS dur_self
FROM pk GROUP BY log_id, key_path, text, namespace""",
)
def _(spark, sf):
    rows = trees.top_down(order_tree(spark, sf))
    return grids.view(rows, grids.CALL_TREE_VIEWS["Time"]).withColumn("avg_self", F.round("avg_self", 6))


@query(
    "f10_sort_by_selectivity",
    STATEMENTS + "SELECT log_id, event_index, CASE ok % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_selective FROM st WHERE kind = 'SOQL'",
)
def _(spark, sf):
    spans = order_tree(spark, sf).filter(F.col("type") == "SOQL_EXECUTE_BEGIN")
    known = F.when(F.col("o_key") % 3 == 0, True).when(F.col("o_key") % 3 == 1, False)
    return grids.by_selectivity(spans.withColumn("is_selective", known)).select("log_id", "event_index", "is_selective")


@query(
    "s6_csv_columns",
    TREE + "SELECT log_id, event_index, round(dur_total / 1000000.0, 3) AS dur_total, round(dur_self / 1000000.0, 3) AS dur_self FROM tree",
)
def _(spark, sf):
    return ns_as_ms(order_tree(spark, sf).select("log_id", "event_index", "dur_total", "dur_self"))
