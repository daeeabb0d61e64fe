"""Logs of flows, query plans, limit blocks and looked-up namespaces, one per supplier, and a line of every type.

What each log says follows from the supplier's key k; the SQL states the answer from the same k.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import event_types
from spanforge.operators import findings
from spanforge.operators.events import tag_lines, to_fields, with_continuations
from spanforge.plans.logs import SLICE
from spanforge.plans.registry import query
from spanforge.schema import LIMIT_METRICS
from spanforge.session import cut
from spanforge.sources.logs import body_lines
from spanforge.sources.parse import parse_logs
from spanforge.sources.tables import table

_PARSED: dict = {}


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def automation_logs(spark, sf):
    k = F.col("s_suppkey")
    no_lines = F.array().cast("array<string>")
    some = lambda cond, *lines: F.when(cond, F.array(*lines)).otherwise(no_lines)
    text = lambda *lines: F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    soql = text("SOQL_EXECUTE_BEGIN|[1]|Aggregations:0|SELECT Id FROM A", "SOQL_EXECUTE_END|[1]|Rows:2")
    times = lambda n: F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i < n, soql).otherwise(no_lines)))
    usage = lambda name, d, total: _cat(f"{name}|", d, " SOQL queries, total ", total, " out of 100")
    d3, d2, d1, e1 = k % 4, F.floor(k / 3) % 7, k % 5, F.floor(k / 7) % 4
    second = d1 + 10 + e1 + F.when(k % 4 == 0, 0).when(k % 4 == 1, -1).otherwise(2)
    known = F.when(k % 2 == 0, "nsZ").otherwise("nsY")

    def plan(q):
        obj = _cat("Obj", (k + q) % 3)
        explain = lambda op, cost: _cat("SOQL_EXECUTE_EXPLAIN|[7]|", op, " on ", obj, " : [], cardinality: 5, sobjectCardinality: 200, relativeCost ", cost)
        first = explain(F.when((k + q) % 2 == 0, "TableScan").otherwise("Index"), F.col("s_suppkey").cast("long") * 3 % 8 * 0.5 + q * 0.25)
        return F.concat(
            F.array(_cat("SOQL_EXECUTE_BEGIN|[7]|Aggregations:0|SELECT Id FROM ", obj, " WHERE N = ", q), first),
            some(q % 2 == 1, explain(F.lit("Other"), F.lit(1.5))), F.array(F.lit("SOQL_EXECUTE_END|[7]|Rows:1")),
        )

    lines = F.concat(
        text("EXECUTION_STARTED"),
        some(k % 3 == 0, F.lit("CODE_UNIT_STARTED|[EXTERNAL]|Flow:Account")),
        some(k % 3 == 1, F.lit("CODE_UNIT_STARTED|[EXTERNAL]|01p|ns0.Cls.run()")),
        text("METHOD_ENTRY|[2]|id|nsZ.A.B.run()", "METHOD_EXIT|[2]|id|nsZ.A.B.run()"),
        text(_cat("CONSTRUCTOR_ENTRY|[1]|id|<init>()|", known, ".Thing"), _cat("CONSTRUCTOR_EXIT|[1]|id|<init>()|", known, ".Thing")),
        text("METHOD_ENTRY|[3]|id|Foo.bar()", _cat("METHOD_EXIT|[3]|pk", k % 2, ".Cls")),
        text("FLOW_START_INTERVIEWS_BEGIN|1", _cat("FLOW_START_INTERVIEW_BEGIN|id|Flow A", k % 7), "FLOW_ELEMENT_BEGIN|id|FlowRecordLookup|outer"),
        times(k % 3),
        text("FLOW_START_INTERVIEWS_BEGIN|1", "FLOW_START_INTERVIEW_BEGIN|id|Flow B", "FLOW_ELEMENT_BEGIN|id|FlowRecordLookup|middle"),
        times(k % 2),
        text("FLOW_BULK_ELEMENT_BEGIN|FlowX|inner", usage("FLOW_BULK_ELEMENT_LIMIT_USAGE", d3, d3 + 3), "FLOW_BULK_ELEMENT_END|FlowX|inner"),
        text(usage("FLOW_ELEMENT_LIMIT_USAGE", d2, d2 + 5), "FLOW_ELEMENT_END|id|FlowRecordLookup|middle"),
        text("FLOW_START_INTERVIEW_END|id|Flow B", "FLOW_START_INTERVIEWS_END|1"),
        text(usage("FLOW_ELEMENT_LIMIT_USAGE", d1, d1 + 10), usage("FLOW_ELEMENT_LIMIT_USAGE", e1, second), "FLOW_ELEMENT_END|id|FlowRecordLookup|outer"),
        text("FLOW_START_INTERVIEW_END|id|Flow A", "FLOW_START_INTERVIEWS_END|1"),
        some(k % 3 < 2, F.lit("CODE_UNIT_FINISHED|x")),
        F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), (k % 4).cast("long")), plan)),
        text("CUMULATIVE_LIMIT_USAGE", "LIMIT_USAGE_FOR_NS|(default)|"),
    )
    more = [
        _cat("  Number of SOQL queries: ", k, " out of 100"), _cat("  Maximum heap size: ", k * 10, " out of 6000000 ******* CLOSE TO LIMIT"),
        _cat("  Number of DML rows: ", k % 11, "/10000"), F.lit("  Number of oddities: 3 out of 4"), F.lit(""),
    ]
    stamped = lambda xs, first: F.transform(xs, lambda x, i: _cat("10:00:00.0 (", (i + first) * 10, ")|", x))
    head = stamped(lines, 10)
    tail = stamped(text(_cat("LIMIT_USAGE_FOR_NS|ns", k % 2, "|"), ), 500)
    end = stamped(text("CUMULATIVE_LIMIT_USAGE_END", "EXECUTION_FINISHED"), 510)
    every = F.concat(head, F.array(*more), tail, F.array(_cat("  Number of query rows: ", k % 13, " out of 50000"), _cat("  Number of query rows: ", k % 17, " out of 50000")), end)
    rows = table(spark, sf, "supplier").select(k.cast("string").alias("log_id"), F.posexplode(every).alias("at", "line"))
    return rows.select("log_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def automation(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PARSED:
        _PARSED[key] = parse_logs(body_lines(cut(automation_logs(spark, sf)), SLICE), 16)
    return _PARSED[key]


K = "WITH l AS (SELECT CAST(s_suppkey AS VARCHAR) AS log_id, s_suppkey AS k FROM supplier)"


@query(
    "r5_flow_residuals",
    K
    + """, d AS (SELECT *, k % 3 AS a, k % 2 AS b, k % 4 AS d3, (k // 3) % 7 AS d2, least(k % 5 + (k // 7) % 4,
  k % 5 + (k // 7) % 4 + CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE 2 END) AS d1 FROM l),
r AS (SELECT *, greatest(d2 - b - d3, 0) AS r2, greatest(d1 - a - b - d3 - greatest(d2 - b - d3, 0), 0) AS r1 FROM d)
SELECT log_id, 'FlowRecordLookup outer' AS text, r1 AS soql_count_self, a + b + r1 + r2 + d3 AS soql_count_total FROM r
UNION ALL SELECT log_id, 'FlowRecordLookup middle', r2, b + r2 + d3 FROM r
UNION ALL SELECT log_id, 'FlowX - inner', d3, d3 FROM r""",
)
def _(spark, sf):
    spans = automation(spark, sf).spans.filter(F.col("type").isin("FLOW_ELEMENT_BEGIN", "FLOW_BULK_ELEMENT_BEGIN"))
    return spans.select("log_id", "text", "soql_count_self", "soql_count_total")


@query(
    "p30_flow_names",
    K
    + """SELECT log_id, 'FLOW_START_INTERVIEWS : Flow A' || (k % 7) AS text, CASE k % 3 WHEN 0 THEN ' (Flow)' WHEN 1 THEN ' (Process Builder)' ELSE ' ()' END AS suffix FROM l
UNION ALL SELECT log_id, 'FLOW_START_INTERVIEWS : Flow B', ' (Flow)' FROM l""",
)
def _(spark, sf):
    return automation(spark, sf).spans.filter(F.col("type") == "FLOW_START_INTERVIEWS_BEGIN").select("log_id", "text", "suffix")


@query(
    "q9_find_plans",
    K
    + """, q AS (SELECT log_id, k, unnest(range(0, k % 4 + 1)) AS q FROM l),
e AS (SELECT *, 'Obj' || ((k + q) % 3) AS obj, 'SELECT Id FROM Obj' || ((k + q) % 3) || ' WHERE N = ' || q AS text, 20 + 10 * (q % 2) AS dur FROM q),
x AS (SELECT log_id, q, 0 AS n, obj, text, dur, CASE WHEN (k + q) % 2 = 0 THEN 'TableScan' ELSE 'Index' END AS op, CAST(k * 3 % 8 * 0.5 + q * 0.25 AS DOUBLE) AS cost FROM e
  UNION ALL SELECT log_id, q, 1, obj, text, dur, 'Other', 1.5 FROM e WHERE q % 2 = 1)
SELECT log_id, 'plan-cost' AS rule, 'Error' AS severity, obj AS subject, count(*) AS count, CAST(sum(dur) AS BIGINT) AS time_ns, max(cost) AS used,
  arg_max(text, (cost, -q, -n)) AS detail FROM x WHERE cost > 1 GROUP BY log_id, obj
UNION ALL SELECT log_id, 'plan-scan', 'Warning', obj, count(*), CAST(sum(dur) AS BIGINT), NULL, arg_min(text, q) FROM x WHERE op = 'TableScan' GROUP BY log_id, obj""",
)
def _(spark, sf):
    found = findings.find_plans(automation(spark, sf).spans)
    return found.select("log_id", "rule", "severity", "subject", "count", "time_ns", "used", "detail")


_METRICS = ", ".join(f"('{m}')" for m in LIMIT_METRICS)


@query(
    "p21_limit_blocks",
    K
    + f""", m(metric) AS (VALUES {_METRICS})
SELECT log_id, 'default' AS namespace, metric, CASE metric WHEN 'soqlQueries' THEN k WHEN 'heapSize' THEN k * 10 WHEN 'dmlRows' THEN k % 11 ELSE 0 END AS used,
  CASE metric WHEN 'soqlQueries' THEN 100 WHEN 'heapSize' THEN 6000000 WHEN 'dmlRows' THEN 10000 ELSE 0 END AS "limit" FROM l, m
UNION ALL SELECT log_id, 'ns' || (k % 2), metric, CASE metric WHEN 'queryRows' THEN k % 17 ELSE 0 END, CASE metric WHEN 'queryRows' THEN 50000 ELSE 0 END FROM l, m""",
)
def _(spark, sf):
    return automation(spark, sf).limit_snapshots.select("log_id", "namespace", "metric", "used", "limit")


@query(
    "p11_known_constructors",
    K
    + """SELECT log_id, CASE WHEN k % 2 = 0 THEN 'nsZ.Thing()' ELSE 'nsY.Thing()' END AS text,
  CASE WHEN k % 2 = 0 THEN 'nsZ' WHEN k % 3 = 1 THEN 'ns0' ELSE 'default' END AS namespace FROM l""",
)
def _(spark, sf):
    return automation(spark, sf).spans.filter(F.col("type") == "CONSTRUCTOR_ENTRY").select("log_id", "text", "namespace")


@query(
    "p12_exit_references",
    K
    + """SELECT log_id, 'Foo.bar()' AS text, 'pk' || (k % 2) AS namespace FROM l
UNION ALL SELECT log_id, 'nsZ.A.B.run()', 'nsZ' FROM l""",
)
def _(spark, sf):
    return automation(spark, sf).spans.filter(F.col("type") == "METHOD_ENTRY").select("log_id", "text", "namespace")


# ---- a line of every type ----------------------------------------------------------------------

TYPES = event_types.rows()
FIELDS = 8


def _field(n: int) -> str:
    """SQL of field n of a line (1 is the type), null where the line is shorter."""
    if n == 1:
        return "type"
    value = f"CASE WHEN has_line THEN CASE WHEN p_size % 5 = 0 THEN '[EXTERNAL]' ELSE '[' || p_size || ']' END ELSE 'v2_' || p_size END" if n == 2 else f"'v{n}_' || (p_size % 10)"
    return f"(CASE WHEN m >= {n - 1} THEN {value} END)"


def _template(template: str) -> str:
    """SQL of the text that a template stands for."""
    if template in ("{2}", "{3}", "{4}"):
        return f"coalesce({_field(int(template[1]))}, '')"
    out = []
    for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
        if piece == "{line}":
            out.append("CASE WHEN m >= 1 AND p_size % 5 = 0 THEN 'EXTERNAL' WHEN m >= 1 THEN CAST(p_size AS VARCHAR) ELSE '0' END")
        elif piece.endswith("*}"):
            rest = ", ".join(_field(n) for n in range(int(piece[1:-2]), FIELDS + 2))
            out.append(f"concat_ws(' | ', {rest})")
        elif piece.startswith("{"):
            out.append(f"coalesce({_field(int(piece[1:-1]))}, 'undefined')")
        elif piece:
            out.append("'" + piece + "'")
    return " || ".join(out)


_OWN = {
    "METHOD_ENTRY": f"coalesce({_field(4)}, type)",
    "METHOD_EXIT": f"coalesce({_field(4)}, {_field(3)}, type)",
    "CONSTRUCTOR_ENTRY": f"coalesce({_field(5)}, 'undefined') || coalesce(right({_field(4)}, 1), '')",
    "CODE_UNIT_STARTED": f"coalesce({_field(4)}, {_field(3)}, '')",
    "VF_APEX_CALL_START": f"coalesce({_field(5)}, {_field(3)}, '') || coalesce('.' || {_field(4)}, '')",
    "ENTERING_MANAGED_PKG": f"coalesce({_field(2)}, '')",
    "CUMULATIVE_PROFILING": f"coalesce({_field(2)}, 'undefined') || ' ' || coalesce({_field(3)}, '')",
    "FLOW_START_INTERVIEWS_BEGIN": "'FLOW_START_INTERVIEWS : '",
    "VALIDATION_FORMULA": f"coalesce({_field(2)}, 'undefined') || coalesce(' ' || {_field(3)}, '')",
    "WF_FLOW_ACTION_DETAIL": f"coalesce({_field(2)}, 'undefined') || ' : ' || coalesce({_field(3)}, 'undefined') || coalesce(' : ' || {_field(4)} || ' :' || coalesce({_field(5)}, 'undefined'), '')",
}
_BY_TYPE = {t: template for template, names in event_types.TEXTS.items() for t in names.split()}
_CASES = " ".join(f"WHEN type = '{t}' THEN {sql}" for t, sql in _OWN.items()) + " " + " ".join(
    "WHEN type IN ({}) THEN {}".format(", ".join(f"'{t}'" for t in names.split() if t not in _OWN), _template(template))
    for template, names in event_types.TEXTS.items()
    if any(t not in _OWN for t in names.split())
)
_VALUES = ", ".join(f"({i}, '{r[0]}', {r[8]})" for i, r in enumerate(TYPES))


@query(
    "p28_display_texts",
    f"""WITH types(i, type, has_line) AS (VALUES {_VALUES}),
l AS (SELECT p_partkey, p_size, type, has_line, (p_partkey // {len(TYPES)} + p_size) % {FIELDS + 1} AS m FROM part JOIN types ON i = p_partkey % {len(TYPES)})
SELECT p_partkey AS ts_ns, type, CASE {_CASES} ELSE type END AS text FROM l""",
)
def _(spark, sf):
    """A line per part, its type and number of fields by the part's key: every text rule is met, with missing fields too."""
    dim = spark.createDataFrame([(i, r[0], r[8]) for i, r in enumerate(TYPES)], "i long, type string, has_line boolean")
    parts = table(spark, sf, "part").join(F.broadcast(dim), F.col("p_partkey") % len(TYPES) == F.col("i"))
    size = F.col("p_size")
    at = F.when(F.col("has_line"), F.when(size % 5 == 0, "[EXTERNAL]").otherwise(_cat("[", size, "]"))).otherwise(_cat("v2_", size))
    fields = F.slice(F.array(at, *[_cat(f"v{n}_", size % 10) for n in range(3, FIELDS + 2)]), F.lit(1), ((F.floor(F.col("p_partkey") / len(TYPES)) + size) % (FIELDS + 1)).cast("int"))
    line = F.array_join(F.concat(F.array(_cat("10:00:00.0 (", F.col("p_partkey"), ")"), F.col("type")), fields), "|")
    lines = parts.select((F.col("p_partkey") % 7).cast("string").alias("log_id"), F.col("p_partkey").alias("line_no"), line.alias("line"))
    return to_fields(with_continuations(cut(tag_lines(lines)))).select("ts_ns", "type", "text")
