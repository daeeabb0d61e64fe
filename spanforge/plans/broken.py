"""Mixed-up and cut-off logs rendered from the shared tables, against a walk over stack states in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.plans.logs import SLICE
from spanforge.plans.registry import query
from spanforge.session import cut
from spanforge.sources.logs import body_lines
from spanforge.sources.parse import parse_logs
from spanforge.sources.tables import table

LOG = 32  # lines of a log, at most
_PARSED: dict = {}

# What the last two of the 13 kinds of line are in each set of logs.
LAST_KINDS = {
    "unwound": ("FATAL_ERROR", "USER_DEBUG"),
    "next_line": ("WF_FORMULA", "WF_RULE_INVOCATION"),
    "cut_off": ("WF_FORMULA", "EXCEPTION_THROWN"),
}


def messy_logs(spark, sf, name):
    """A log of each run of parts; what a line is follows from the part's size. Entries, exits that fit or do not, exceptions, repeated times."""
    at = F.col("p_partkey") % LOG
    kind, third = F.col("p_size") % 13, F.floor(F.col("p_size") / 13) % 3
    ts = F.lit(1000) + at * 2 - F.when(at % 5 == 3, 2).otherwise(0)
    number = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    tail = {"FATAL_ERROR": "FATAL_ERROR|E: y", "USER_DEBUG": "USER_DEBUG|[1]|DEBUG|x", "WF_FORMULA": "WF_FORMULA|a|b", "WF_RULE_INVOCATION": "WF_RULE_INVOCATION|a", "EXCEPTION_THROWN": "EXCEPTION_THROWN|[1]|E: x"}
    body = (
        F.when(kind < 4, F.concat(F.lit("METHOD_ENTRY|"), number(F.col("p_size") % 3), F.lit("|01p|A.b()")))
        .when(kind < 7, F.concat(F.lit("METHOD_EXIT|"), number(third), F.lit("|01p|A.b()")))
        .when(kind == 7, "CODE_UNIT_STARTED|[EXTERNAL]|01p|ns0.Cls.run()")
        .when(kind == 8, "CODE_UNIT_FINISHED|ns0.Cls.run()")
        .when(kind == 9, tail["EXCEPTION_THROWN"])
        .when(kind == 10, tail["USER_DEBUG"])
        .when(kind == 11, tail[LAST_KINDS[name][0]])
        .otherwise(tail[LAST_KINDS[name][1]])
    )
    parts = table(spark, sf, "part").select(
        F.floor(F.col("p_partkey") / LOG).cast("string").alias("log_id"), (at * 2 + 1).alias("line_no"),
        F.concat(F.lit("10:00:00.0 ("), ts.cast("string"), F.lit(")|"), body).alias("line"), at.alias("at"), kind.alias("k"), "p_size",
    )
    lines = parts.select("log_id", "line_no", "line")
    if name == "cut_off":
        mark = (F.col("k") < 9) & (F.col("at") >= 4) & (F.col("p_size") % 5 == 0)
        lines = lines.unionByName(parts.filter(mark).select("log_id", (F.col("line_no") + 1).alias("line_no"), F.lit("*** MAXIMUM DEBUG LOG SIZE REACHED ***").alias("line")))
    return lines


def messy(spark, sf, name):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _PARSED:
        # Slices of a few events, so that frames cross them.
        _PARSED[key] = parse_logs(body_lines(cut(messy_logs(spark, sf, name)), SLICE), 8)
    return _PARSED[key]


def walk(name: str) -> str:
    """SQL of all stack states: s is the stack, u whether it unwinds, mx the time of the size marker, last the last time in the tree."""
    opens = {"WF_FORMULA", "WF_RULE_INVOCATION"}
    last_opens = [k for k, t in zip((11, 12), LAST_KINDS[name], strict=True) if t in opens]
    thrown = [9] + [k for k, t in zip((11, 12), LAST_KINDS[name], strict=True) if t in ("FATAL_ERROR", "EXCEPTION_THROWN")]
    marker = "k < 9 AND pos >= 4 AND p_size % 5 = 0" if name == "cut_off" else "FALSE"
    listed = lambda ks: ", ".join(map(str, ks)) or "-1"
    return f"""
WITH RECURSIVE part_line AS (SELECT p_partkey // {LOG} AS lg, p_partkey % {LOG} AS pos, p_size, p_size % 13 AS k FROM part),
ev AS (SELECT CAST(lg AS VARCHAR) AS log_id, CAST(row_number() OVER (PARTITION BY lg ORDER BY pos) AS BIGINT) AS i, k,
  CAST(1000 + pos * 2 - CASE WHEN pos % 5 = 3 THEN 2 ELSE 0 END AS BIGINT) AS ts,
  CASE WHEN k < 4 THEN p_size % 3 WHEN k < 7 THEN (p_size // 13) % 3 WHEN k = 7 THEN -1 ELSE 0 END AS line,
  k BETWEEN 4 AND 6 OR k = 8 AS leaves, k < 4 OR k = 7 OR k IN ({listed(last_opens)}) AS opens, k IN ({listed(last_opens)}) AS nxt,
  CASE WHEN k < 7 THEN 'M' WHEN k < 9 THEN 'C' ELSE 'N' END AS fam, k IN ({listed(thrown)}) AS thrown, {marker} AS mark FROM part_line),
run AS (
  SELECT DISTINCT log_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(i BIGINT, fam VARCHAR, line BIGINT, nxt BOOLEAN)[]) AS s, FALSE AS u, CAST(NULL AS BIGINT) AS mx,
    CAST(NULL AS BIGINT) AS last, CAST([] AS STRUCT(i BIGINT, ts BIGINT, cut BOOLEAN)[]) AS closed, FALSE AS gone, CAST([] AS BIGINT[]) AS path FROM ev
  UNION ALL
  SELECT log_id, i, CASE WHEN opens THEN list_append(s3, {{'i': i, 'fam': fam, 'line': CAST(line AS BIGINT), 'nxt': nxt}}) ELSE s3 END,
    u3, CASE WHEN mark THEN ts WHEN len(cut) > 0 THEN last ELSE mx END, CASE WHEN NOT gone AND (len(s3) > 0 OR opens) THEN ts ELSE last END,
    list_concat(list_transform(ended, lambda f: {{'i': f.i, 'ts': ts, 'cut': FALSE}}), list_transform(cut, lambda f: {{'i': f.i, 'ts': last, 'cut': TRUE}})),
    gone, list_transform(s3, lambda f: f.i)
  FROM (
    SELECT *, CASE WHEN leaves AND j IS NOT NULL THEN s1[1:j - 1] WHEN leaves AND u1 THEN s1[1:0] ELSE s1[1:len(s1) - len(cut)] END AS s3,
      list_concat(popped, CASE WHEN leaves AND j IS NOT NULL THEN s1[j:] WHEN leaves AND u1 THEN s1 ELSE s1[1:0] END) AS ended,
      leaves AND j IS NOT NULL AS gone, u1 AND NOT (leaves AND j IS NOT NULL) AS u3
    FROM (
      SELECT *, list_max(list_filter(range(1, len(s1) + 1), lambda x: s1[x].fam = fam AND (s1[x].line = line OR line = 0 OR s1[x].line = 0))) AS j,
        CASE WHEN leaves OR NOT u1 OR mx IS NULL OR ts <= mx OR len(s1) = 0 THEN s1[1:0] WHEN ts > last THEN s1 ELSE s1[len(s1):] END AS cut
      FROM (
        SELECT ev.*, s, mx, last, u OR (thrown AND len(s) > 0) AS u1,
          CASE WHEN (leaves OR opens) AND len(s) > 0 AND s[len(s)].nxt THEN s[len(s):] ELSE s[1:0] END AS popped,
          CASE WHEN (leaves OR opens) AND len(s) > 0 AND s[len(s)].nxt THEN s[1:len(s) - 1] ELSE s END AS s1
        FROM run JOIN ev ON ev.log_id = run.log_id AND ev.i = run.i + 1)))),
final AS (SELECT log_id, arg_max(s, i) AS s, arg_max(last, i) AS last FROM run GROUP BY log_id),
ends AS (SELECT log_id, c.i, c.ts, c.cut FROM (SELECT log_id, unnest(closed) AS c FROM run)
  UNION ALL SELECT log_id, f.i, last, TRUE FROM (SELECT log_id, unnest(s) AS f, last FROM final))
"""


def spans_sql(name: str) -> str:
    return walk(name) + """SELECT run.log_id, run.i AS event_index, coalesce(run.path[len(run.path)], 0) AS parent_index, CAST(len(run.path) AS INT) AS depth, ends.ts AS exit_ns,
  coalesce(ends.cut, FALSE) AS is_truncated FROM run LEFT JOIN ends ON ends.log_id = run.log_id AND ends.i = run.i WHERE run.i > 0 AND NOT run.gone"""


def placed(spark, sf, name):
    return messy(spark, sf, name).spans.select("log_id", "event_index", "parent_index", "depth", "exit_ns", "is_truncated")


@query("t3_unwound_spans", spans_sql("unwound"))
def _(spark, sf):
    return placed(spark, sf, "unwound")


@query("t4_next_line_ends", spans_sql("next_line"))
def _(spark, sf):
    return placed(spark, sf, "next_line")


@query("t5_cut_off_logs", spans_sql("cut_off"))
def _(spark, sf):
    return placed(spark, sf, "cut_off")


@query(
    "t3_unexpected_exits",
    walk("unwound")
    + """SELECT run.log_id, min(run.i) AS event_index, arg_min(ev.ts, run.i) AS start_ns FROM run JOIN ev ON ev.log_id = run.log_id AND ev.i = run.i
JOIN run before ON before.log_id = run.log_id AND before.i = run.i - 1 WHERE ev.leaves AND NOT run.gone AND len(run.closed) = 0 AND len(before.s) > 0 GROUP BY run.log_id""",
)
def _(spark, sf):
    found = messy(spark, sf, "unwound").issues.filter(F.col("summary") == "Unexpected-Exit")
    return found.select("log_id", "event_index", "start_ns")


@query(
    "t5_max_size_issues",
    walk("cut_off")
    + """, hits AS (SELECT run.log_id, c.i, c.ts, c.cut, TRUE AS sized FROM (SELECT log_id, unnest(closed) AS c FROM run) run WHERE c.cut)
SELECT log_id, count(*) AS cut_off, min(i) AS first_index, max(ts) AS last_ns FROM hits GROUP BY log_id""",
)
def _(spark, sf):
    spans = messy(spark, sf, "cut_off").spans.select("log_id", "event_index", "exit_ns", "is_truncated", "last_index")
    ends = spans.groupBy("log_id").agg(F.max("event_index").alias("end"))
    # Frames that are open at the end of the log are cut off there, not by its size.
    by_size = spans.filter("is_truncated").join(ends, "log_id").filter(F.col("last_index") < F.col("end"))
    return by_size.groupBy("log_id").agg(F.count("*").alias("cut_off"), F.min("event_index").alias("first_index"), F.max("exit_ns").alias("last_ns"))
