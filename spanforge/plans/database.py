"""Database queries over the order tree, whose orders are SOQL, DML and SOSL statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators import database as db
from spanforge.operators.times import log_times
from spanforge.plans.registry import TREE, query
from spanforge.sources.tables import order_tree

STATEMENTS = (
    TREE
    + """, st AS (
  SELECT t.*, CASE type WHEN 'SOQL_EXECUTE_BEGIN' THEN 'SOQL' WHEN 'DML_BEGIN' THEN 'DML' ELSE 'SOSL' END AS kind,
    CASE type WHEN 'DML_BEGIN' THEN 'Update ' || sobject_type ELSE text END AS label,
    CASE type WHEN 'SOQL_EXECUTE_BEGIN' THEN regexp_extract(text, 'FROM ([A-Za-z0-9_]+)', 1) ELSE sobject_type END AS sobject,
    soql_rows_self + dml_rows_self + sosl_rows_self AS n_rows
  FROM tree t WHERE depth = 2),
ranked AS (
  SELECT log_id, kind, label, count(*) AS repeats, CAST(sum(n_rows) AS BIGINT) AS rows, max(n_rows) AS max_rows,
    CAST(sum(dur_self) AS BIGINT) AS self_ns, CAST(sum(dur_total) AS BIGINT) AS net_ns,
    CAST(sum(dur_total) AS BIGINT) AS time_ns, min(event_index) AS first_index,
    arg_min(sobject, event_index) AS sobject,
    arg_max(event_index, CAST(dur_total AS HUGEINT) * 10000000 - event_index) AS slowest_index
  FROM st GROUP BY log_id, kind, label),
logs AS (
  SELECT log_id, min(ts_ns) FILTER (WHERE ts_ns <> 0) AS start_ns, max(ts_ns + dur_total) AS exit_ns
  FROM tree WHERE depth = 0 GROUP BY log_id)
"""
)

_GRID = "log_id, event_index, text, namespace, 'default' AS caller_namespace"


@query("d1_statements", STATEMENTS + "SELECT log_id, event_index, kind, label, sobject, n_rows AS rows FROM st")
def _(spark, sf):
    return db.statements(order_tree(spark, sf)).select(
        "log_id", "event_index", "kind", "label", "sobject", "rows"
    )


@query(
    "d2_soql_grid",
    STATEMENTS
    + f"""SELECT {_GRID}, sobject, n_rows AS rows, dur_total AS time_ns, CAST(NULL AS BOOLEAN) AS is_selective
FROM st WHERE kind = 'SOQL'""",
)
def _(spark, sf):
    return db.soql_grid(order_tree(spark, sf))


@query(
    "d3_dml_grid",
    STATEMENTS + f"SELECT {_GRID}, sobject, n_rows AS rows, dur_total AS time_ns FROM st WHERE kind = 'DML'",
)
def _(spark, sf):
    return db.dml_grid(order_tree(spark, sf))


@query(
    "d4_sosl_grid",
    STATEMENTS + f"SELECT {_GRID}, n_rows AS rows, dur_total AS time_ns FROM st WHERE kind = 'SOSL'",
)
def _(spark, sf):
    return db.sosl_grid(order_tree(spark, sf))


@query(
    "d5_statement_net_time",
    STATEMENTS
    + "SELECT log_id, event_index, CAST(NULL AS BIGINT) AS enclosing, dur_total AS net_ns FROM st",
)
def _(spark, sf):
    return db.statement_net_time(order_tree(spark, sf)).select(
        "log_id", "event_index", "enclosing", "net_ns"
    )


@query(
    "t9_log_times",
    STATEMENTS
    + "SELECT log_id, start_ns, exit_ns, exit_ns AS execution_end_ns, exit_ns - start_ns AS duration_ns FROM logs",
)
def _(spark, sf):
    return log_times(order_tree(spark, sf))


@query(
    "d6_database_time",
    STATEMENTS
    + """SELECT l.log_id, exit_ns - start_ns AS duration_ns, CAST(sum(dur_total) AS BIGINT) AS database_ns,
  CAST(sum(CASE kind WHEN 'SOQL' THEN dur_total ELSE 0 END) AS BIGINT) AS soql_ns,
  CAST(sum(CASE kind WHEN 'DML' THEN dur_total ELSE 0 END) AS BIGINT) AS dml_ns,
  CAST(sum(CASE kind WHEN 'SOSL' THEN dur_total ELSE 0 END) AS BIGINT) AS sosl_ns,
  count(*) FILTER (WHERE kind = 'SOQL') AS soql_statements, count(*) FILTER (WHERE kind = 'DML') AS dml_statements,
  count(*) FILTER (WHERE kind = 'SOSL') AS sosl_statements,
  round(CAST(sum(dur_total) AS DOUBLE) / (exit_ns - start_ns) * 100, 6) AS percent_of_log
FROM st JOIN logs l USING (log_id) GROUP BY l.log_id, exit_ns, start_ns""",
)
def _(spark, sf):
    spans = order_tree(spark, sf)
    return db.database_time(spans, log_times(spans)).withColumn(
        "percent_of_log", F.round("percent_of_log", 6)
    )


@query("d7_ranked_statements", STATEMENTS + "SELECT * FROM ranked")
def _(spark, sf):
    return db.ranked_statements(order_tree(spark, sf))


@query(
    "d7_statement_occurrences",
    STATEMENTS
    + "SELECT log_id, kind, label, event_index, n_rows AS rows, dur_total AS net_ns, dur_total FROM st",
)
def _(spark, sf):
    return db.statement_occurrences(order_tree(spark, sf))


@query(
    "d8_db_concentration",
    STATEMENTS
    + """, run AS (SELECT log_id, net_ns, count(*) OVER (PARTITION BY log_id) AS total,
    sum(net_ns) OVER (PARTITION BY log_id) AS whole,
    coalesce(sum(net_ns) OVER (PARTITION BY log_id ORDER BY net_ns DESC, first_index
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked)
SELECT log_id, count(*) AS signatures, CAST(sum(net_ns) AS BIGINT) AS held, total FROM run
WHERE before < 0.75 * whole GROUP BY log_id, total""",
)
def _(spark, sf):
    return db.db_concentration(order_tree(spark, sf))


@query(
    "d9_database_tree",
    STATEMENTS
    + """, path AS (
  SELECT s.log_id, s.dur_total AS t, s.event_index AS si, 'frame:' || n.text AS n0, n.event_index AS i0, n.dur_self AS s0,
    'frame:' || n.text || ' > frame:' || c.text AS n1, c.event_index AS i1, c.dur_self AS s1,
    'frame:' || n.text || ' > frame:' || c.text || ' > ' || s.kind || ':' || s.label AS n2, s.dur_self AS s2
  FROM st s JOIN tree n ON n.depth = 0 AND n.nk = s.nk JOIN tree c ON c.depth = 1 AND c.ck = s.ck),
steps AS (
  SELECT log_id, n0 AS key_path, i0 AS frame, t, s0 AS s FROM path
  UNION ALL SELECT log_id, n1, i1, t, s1 FROM path UNION ALL SELECT log_id, n2, si, t, s2 FROM path),
per AS (SELECT log_id, key_path, frame, sum(t) AS t, any_value(s) AS s FROM steps GROUP BY ALL)
SELECT log_id, key_path, CAST(sum(t) AS BIGINT) AS time_ns, CAST(sum(s) AS BIGINT) AS self_ns, count(*) AS frames
FROM per GROUP BY log_id, key_path""",
)
def _(spark, sf):
    return db.database_tree(order_tree(spark, sf)).withColumn(
        "key_path", F.array_join("key_path", " > ")
    )


def _attr(source: str) -> str:
    return f"""SELECT log_id, namespace, CAST(sum(t) AS BIGINT) AS time_ns,
  CAST(sum(CASE kind WHEN 'SOQL' THEN t ELSE 0 END) AS BIGINT) AS soql_ns,
  CAST(sum(CASE kind WHEN 'DML' THEN t ELSE 0 END) AS BIGINT) AS dml_ns,
  CAST(sum(CASE kind WHEN 'SOSL' THEN t ELSE 0 END) AS BIGINT) AS sosl_ns,
  CAST(sum(runs) AS BIGINT) AS statements,
  CAST(sum(CASE kind WHEN 'DML' THEN 0 ELSE n_rows END) AS BIGINT) AS rows_read,
  CAST(sum(CASE kind WHEN 'DML' THEN n_rows ELSE 0 END) AS BIGINT) AS rows_written
FROM ({source}) GROUP BY log_id, namespace"""


@query(
    "d10_db_asked_by",
    STATEMENTS + _attr("SELECT log_id, 'default' AS namespace, kind, dur_total AS t, 1 AS runs, n_rows FROM st"),
)
def _(spark, sf):
    return db.db_asked_by(order_tree(spark, sf))


@query(
    "d11_db_burned_in",
    STATEMENTS
    + _attr("""SELECT log_id, 'default' AS namespace, kind, dur_self AS t, 1 AS runs, n_rows FROM st
  UNION ALL SELECT c.log_id, c.namespace, s.kind, c.dur_total, 0, 0 FROM tree c JOIN st s
    ON s.log_id = c.log_id AND s.event_index = c.parent_index WHERE c.is_parent AND c.dur_total > 0"""),
)
def _(spark, sf):
    return db.db_burned_in(order_tree(spark, sf))


@query(
    "d12_row_budget",
    STATEMENTS
    + """SELECT log_id, kind, coalesce(sobject, 'Unknown') AS sobject, CAST(sum(rows) AS BIGINT) AS rows,
  CAST(sum(repeats) AS BIGINT) AS statements
FROM ranked WHERE kind IN ('SOQL', 'DML') AND rows > 0 GROUP BY ALL""",
)
def _(spark, sf):
    return db.row_budget(db.ranked_statements(order_tree(spark, sf)))


@query(
    "d13_statement_budget",
    STATEMENTS
    + """SELECT log_id, kind, count(*) AS used, CASE kind WHEN 'SOQL' THEN 100 WHEN 'DML' THEN 150 ELSE 20 END AS "limit"
FROM st GROUP BY ALL""",
)
def _(spark, sf):
    spans = order_tree(spark, sf)
    return db.statement_budget(spans, log_times(spans))


@query(
    "d14_worst_search",
    STATEMENTS
    + """SELECT log_id, max(max_rows) AS rows, 2000 AS "limit" FROM ranked WHERE kind = 'SOSL'
GROUP BY log_id HAVING max(max_rows) > 0""",
)
def _(spark, sf):
    return db.worst_search(db.ranked_statements(order_tree(spark, sf)))


@query(
    "d15_database_sections",
    STATEMENTS
    + """SELECT log_id, gauge, found, CAST(NULL AS BIGINT) AS used, CASE gauge WHEN 'Search Rows' THEN 40000 ELSE 0 END AS "limit"
FROM (
  SELECT log_id, unnest(['DML', 'SOQL', 'SOSL', 'DML Rows', 'Query Rows', 'Search Rows']) AS gauge,
    unnest([count(*) FILTER (WHERE kind = 'DML'), count(*) FILTER (WHERE kind = 'SOQL'), count(*) FILTER (WHERE kind = 'SOSL'),
      CAST(sum(dml_rows_self) AS BIGINT), CAST(sum(soql_rows_self) AS BIGINT), CAST(sum(sosl_rows_self) AS BIGINT)]) AS found
  FROM st GROUP BY log_id)""",
)
def _(spark, sf):
    spans = order_tree(spark, sf)
    return db.database_sections(spans, log_times(spans))


@query(
    "d17_row_budget_gap",
    STATEMENTS
    + """SELECT log_id, kind, CAST(sum(rows) AS BIGINT) AS observed, CAST(NULL AS BIGINT) AS used,
  CASE kind WHEN 'SOQL' THEN 50000 ELSE 10000 END AS "limit", 0 AS unattributed,
  sum(rows) > CASE kind WHEN 'SOQL' THEN 50000 ELSE 10000 END AS over_limit
FROM ranked WHERE kind IN ('SOQL', 'DML') GROUP BY log_id, kind""",
)
def _(spark, sf):
    spans = order_tree(spark, sf)
    return db.row_budget_gap(spans, log_times(spans))


@query(
    "d16_p26_object_of_statement",
    STATEMENTS
    + "SELECT kind, coalesce(sobject, 'Unknown') AS sobject, count(*) AS n FROM st GROUP BY ALL",
)
def _(spark, sf):
    found = db.statements(order_tree(spark, sf))
    return found.groupBy("kind", F.coalesce("sobject", F.lit(db.UNKNOWN)).alias("sobject")).agg(
        F.count("*").alias("n")
    )


@query(
    "p27_soql_shape",
    STATEMENTS
    + r"""SELECT log_id, regexp_replace(text, '''(?:[^'']|'''')*''|\b\d+\b', '?', 'g') AS shape, count(*) AS runs,
  count(DISTINCT text) AS texts FROM st WHERE kind = 'SOQL' GROUP BY ALL""",
)
def _(spark, sf):
    found = db.statements(order_tree(spark, sf)).filter(F.col("kind") == "SOQL")
    return found.groupBy("log_id", tx.soql_shape(F.col("text")).alias("shape")).agg(
        F.count("*").alias("runs"), F.count_distinct("text").alias("texts")
    )
