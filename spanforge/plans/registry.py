"""Named queries over the shared tables, each with an equal ANSI SQL text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# The order tree of sources/tables.py in plain SQL: windows over natural keys instead of scans.
TREE = """
WITH place AS (
  SELECT n_nationkey AS nk, CAST(n_regionkey AS VARCHAR) AS log_id, n_name FROM nation),
cust AS (
  SELECT p.log_id, p.nk, c_custkey AS ck, 'Segment.' || c_mktsegment || '()' AS segment
  FROM customer JOIN place p ON c_nationkey = p.nk),
ord AS (
  SELECT c.*, o_orderkey AS ok, o_orderstatus AS st, o_orderpriority AS pr,
         'Order_' || substr(o_orderpriority, 1, 1) || '__c' AS obj
  FROM orders JOIN cust c ON o_custkey = c.ck),
item AS (
  SELECT o.log_id, o.nk, o.ck, o.ok, o.segment, CAST(l_linenumber AS BIGINT) AS ln,
         l_partkey AS lp, l_suppkey AS ls, CAST(l_quantity AS BIGINT) AS qty,
         l_returnflag AS rf, l_linestatus AS lst,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS lx,
         CASE WHEN l_returnflag = 'N'
              THEN CAST(l_quantity AS BIGINT) * CASE WHEN l_linenumber % 3 = 0 THEN -10 ELSE 10 END
         END AS hb
  FROM lineitem JOIN ord o ON l_orderkey = o.ok),
node AS (
  SELECT log_id, nk, -1 AS ck, -1 AS ok, -1 AS ln, -1 AS lp, -1 AS ls, -1 AS lx, 0 AS depth,
         'CODE_UNIT_STARTED' AS type, 'default' AS namespace, n_name AS text,
         'Code Unit' AS category, TRUE AS is_parent, 0 AS line_number,
         CAST(NULL AS VARCHAR) AS sobject_type, 0 AS dur_self,
         0 AS dml_count_self, 0 AS soql_count_self, 0 AS sosl_count_self, 0 AS dml_rows_self,
         0 AS soql_rows_self, 0 AS sosl_rows_self, CAST(NULL AS BIGINT) AS hb
  FROM place
  UNION ALL
  SELECT log_id, nk, ck, -1, -1, -1, -1, -1, 1, 'METHOD_ENTRY', 'default', segment, 'Apex', TRUE, 0,
         NULL, 10, 0, 0, 0, 0, 0, 0, NULL
  FROM cust
  UNION ALL
  SELECT log_id, nk, ck, ok, -1, -1, -1, -1, 2,
         CASE st WHEN 'F' THEN 'SOQL_EXECUTE_BEGIN' WHEN 'O' THEN 'DML_BEGIN'
                 ELSE 'SOSL_EXECUTE_BEGIN' END,
         'default',
         CASE st WHEN 'F' THEN 'SELECT Id FROM ' || obj || ' WHERE Key__c = '''
                   || CAST(ok % 11 AS VARCHAR) || ''''
                   || CASE WHEN ok % 3 = 0 THEN ' ORDER BY Name' ELSE '' END
                   || CASE WHEN ok % 4 = 0 THEN ' LIMIT 10' ELSE '' END
                 WHEN 'O' THEN 'DML Op:Update Type:' || obj
                 ELSE 'SOSL: FIND ''' || pr || '''' END,
         CASE st WHEN 'O' THEN 'DML' ELSE 'SOQL' END, TRUE, ok % 4 + 1,
         CASE st WHEN 'O' THEN obj END, ok % 97 + 1,
         CASE st WHEN 'O' THEN 1 ELSE 0 END, CASE st WHEN 'F' THEN 1 ELSE 0 END,
         CASE st WHEN 'P' THEN 1 ELSE 0 END, CASE st WHEN 'O' THEN ok % 9 ELSE 0 END,
         CASE st WHEN 'F' THEN ok % 13 ELSE 0 END, CASE st WHEN 'P' THEN ok % 5 ELSE 0 END, NULL
  FROM ord
  UNION ALL
  SELECT log_id, nk, ck, ok, ln, lp, ls, lx, 3,
         CASE rf WHEN 'N' THEN 'HEAP_ALLOCATE' ELSE 'METHOD_ENTRY' END,
         CASE rf WHEN 'A' THEN 'pkg' ELSE 'default' END,
         CASE rf WHEN 'N' THEN 'Bytes:' || CAST(hb AS VARCHAR)
                 WHEN 'A' THEN 'pkg.Outer.Inner.step' || lst || '()' ELSE segment END,
         CASE rf WHEN 'N' THEN '' ELSE 'Apex' END, rf <> 'N', ln, NULL,
         CASE rf WHEN 'N' THEN 0 ELSE qty * 1000 END, 0, 0, 0, 0, 0, 0, hb
  FROM item),
numbered AS (
  SELECT *, row_number() OVER w AS event_index,
         CAST(sum(dur_self) OVER w AS BIGINT) - dur_self AS ts_ns,
         CASE WHEN hb IS NULL THEN 0
              ELSE greatest(CAST(sum(coalesce(hb, 0)) OVER w AS BIGINT), 0) END AS heap_seed,
         coalesce(hb, 0) AS hn, greatest(coalesce(hb, 0), 0) AS hg
  FROM node
  WINDOW w AS (PARTITION BY log_id ORDER BY nk, ck, ok, ln, lp, ls, lx)),
tree AS MATERIALIZED (
  SELECT log_id, event_index, depth, type, namespace, text, category, is_parent, line_number,
         sobject_type, nk, ck, ok, dur_self, ts_ns,
         dml_count_self, soql_count_self, sosl_count_self, dml_rows_self, soql_rows_self,
         sosl_rows_self, {sums},
         CASE depth WHEN 0 THEN 0 WHEN 1 THEN min(event_index) OVER a
                    WHEN 2 THEN min(event_index) OVER b ELSE min(event_index) OVER c END AS parent_index,
         CASE depth WHEN 0 THEN max(event_index) OVER a WHEN 1 THEN max(event_index) OVER b
                    WHEN 2 THEN max(event_index) OVER c ELSE event_index END AS last_index,
         CASE depth WHEN 0 THEN max(heap_seed) OVER a WHEN 1 THEN max(heap_seed) OVER b
                    WHEN 2 THEN max(heap_seed) OVER c ELSE heap_seed END AS heap_peak,
         CAST(CASE WHEN depth = 2 THEN sum(hn) OVER c WHEN depth = 3 THEN hn ELSE 0 END AS BIGINT) AS heap_net_self,
         CAST(CASE WHEN depth = 2 THEN sum(hg) OVER c WHEN depth = 3 THEN hg ELSE 0 END AS BIGINT) AS heap_gross_self
  FROM numbered
  WINDOW a AS (PARTITION BY nk), b AS (PARTITION BY nk, ck), c AS (PARTITION BY nk, ck, ok))
""".format(
    sums=",\n         ".join(
        f"CAST(CASE depth WHEN 0 THEN sum({src}) OVER a WHEN 1 THEN sum({src}) OVER b "
        f"WHEN 2 THEN sum({src}) OVER c ELSE {src} END AS BIGINT) AS {out}_total"
        for out, src in [
            ("dur", "dur_self"),
            ("dml_count", "dml_count_self"),
            ("soql_count", "soql_count_self"),
            ("sosl_count", "sosl_count_self"),
            ("dml_rows", "dml_rows_self"),
            ("soql_rows", "soql_rows_self"),
            ("sosl_rows", "sosl_rows_self"),
            ("heap_net", "hn"),
            ("heap_gross", "hg"),
        ]
    )
)

# The user traces of sources/tables.py.
TRACE = """
WITH trace AS (
  SELECT CAST(user_id AS VARCHAR) AS log_id,
         row_number() OVER w AS event_index, event_type AS type, event_type AS text,
         'default' AS namespace,
         CASE event_type WHEN 'purchase' THEN 'DML' WHEN 'view' THEN 'SOQL' WHEN 'error' THEN ''
              ELSE 'Apex' END AS category,
         epoch_us(ts) * 1000 AS ts_ns,
         coalesce(lead(epoch_us(ts)) OVER w, epoch_us(ts)) * 1000 AS exit_ns,
         (coalesce(lead(epoch_us(ts)) OVER w, epoch_us(ts)) - epoch_us(ts)) * 1000 AS dur_self,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
"""
