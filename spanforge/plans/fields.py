"""Field extraction over texts rendered from the shared tables, with values that vary by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions import extract as x
from spanforge.plans.registry import query
from spanforge.sources.tables import table

def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(*cases: Column | str) -> Column:
    out = F.lit(cases[-1]) if isinstance(cases[-1], str) else cases[-1]
    for k, case in list(enumerate(cases[:-1]))[::-1]:
        out = F.when(F.col("p_partkey") % 4 == k, F.lit(case) if isinstance(case, str) else case).otherwise(out)
    return out


@query(
    "p2_line_numbers",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_size ELSE 0 END AS line, p_partkey % 4 = 2 AS is_external FROM part""",
)
def _(spark, sf):
    field = _pick(_cat("[", F.col("p_size"), "]"), _cat("[", F.col("p_size"), "]"), "[EXTERNAL]", "")
    return table(spark, sf, "part").select("p_partkey", x.line_number(field).alias("line"), x.is_external(field).alias("is_external"))


@query(
    "p7_object_namespaces",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ns' || p_size WHEN 1 THEN 'default' WHEN 2 THEN '' ELSE 'a' || p_size END AS namespace
FROM part""",
)
def _(spark, sf):
    text = _pick(_cat("ns", F.col("p_size"), "__Obj__c"), "Account", "", _cat("a", F.col("p_size"), "__x"))
    return table(spark, sf, "part").select("p_partkey", x.object_namespace(text).alias("namespace"))


@query(
    "p11_constructor_namespaces",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'ns' || p_size WHEN p_partkey % 4 = 3 THEN 'n' || p_size END AS candidate,
  CASE p_partkey % 4 WHEN 0 THEN 'ns' || p_size END AS shaped FROM part""",
)
def _(spark, sf):
    n = F.col("p_size")
    parts = x.ctor_parts(_pick(_cat("ns", n, ".Outer.Inner"), _cat("ns", n, ".Outer"), "Outer", _cat("n", n, ".a.b.c")))
    return table(spark, sf, "part").select("p_partkey", *[c.alias(k) for k, c in parts.items()])


@query(
    "p12_class_reference_namespaces",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ns' || p_size WHEN 3 THEN 'q' || p_size END AS namespace FROM part",
)
def _(spark, sf):
    text = _pick(_cat("ns", F.col("p_size"), ".Cls"), "Cls", "ns.Cls.run()", _cat("q", F.col("p_size"), ".A.B"))
    return table(spark, sf, "part").select("p_partkey", x.class_reference_ns(text).alias("namespace"))


@query(
    "p17_query_plans",
    """SELECT p_partkey, CASE WHEN k < 2 THEN 'Index' WHEN k = 2 THEN 'TableScan' END AS leading_op,
  CASE WHEN k < 3 THEN 'Obj' || p_size END AS sobject, CASE k WHEN 0 THEN 'Id,Name' WHEN 1 THEN 'Key__c' WHEN 2 THEN '' END AS fields,
  CASE WHEN k < 3 THEN CAST(p_size AS BIGINT) END AS cardinality, CASE WHEN k < 3 THEN p_partkey END AS sobject_cardinality,
  CASE WHEN k < 3 THEN p_size + 0.25 END AS relative_cost FROM (SELECT *, p_partkey % 4 AS k FROM part)""",
)
def _(spark, sf):
    n, key = F.col("p_size"), F.col("p_partkey")
    tail = _cat("], cardinality: ", n, ", sobjectCardinality: ", key, ", relativeCost ", n, ".25")
    text = _pick(
        _cat("Index on Obj", n, " : [Id, Name", tail), _cat("Index on Obj", n, " : [Key__c", tail), _cat("TableScan on Obj", n, " : [", tail), "no plan"
    )
    plan = table(spark, sf, "part").select("p_partkey", x.plan_fields(text).alias("p")).select("p_partkey", "p.*")
    return plan.withColumn("fields", F.array_join("fields", ","))


_LIMIT = """SELECT p_partkey, CASE k WHEN 0 THEN 'soqlQueries' WHEN 1 THEN 'cpuTime' WHEN 2 THEN 'dmlRows' END AS metric,
  CASE WHEN k < 3 THEN CAST(p_size AS BIGINT) END AS used, CASE WHEN k < 3 THEN p_partkey + 100 END AS "limit", {delta} AS delta
FROM (SELECT *, p_partkey % 4 AS k FROM part)"""


@query("p18_labelled_limits", _LIMIT.format(delta="CAST(NULL AS BIGINT)"))
def _(spark, sf):
    n, most = F.col("p_size"), F.col("p_partkey") + 100
    body = _pick(
        _cat("  Number of SOQL queries: ", n, " out of ", most), _cat("Maximum CPU time: ", n, "/", most),
        _cat("Number of DML rows: ", n, " out of ", most, " CLOSE TO LIMIT"), _cat("Number of moons: ", n, " out of ", most),
    )
    return table(spark, sf, "part").select("p_partkey", *[c.alias(k) for k, c in x.labelled_limit(body).items()])


@query("p19_running_limits", _LIMIT.format(delta="CASE WHEN k = 0 THEN CAST(p_size % 7 AS BIGINT) WHEN k < 3 THEN 0 END"))
def _(spark, sf):
    n, most = F.col("p_size"), F.col("p_partkey") + 100
    total = _cat(", total ", n, " out of ", most)
    body = _pick(
        _cat(n % 7, " Number of SOQL queries", total), _cat("Maximum CPU time", total), _cat(" Number of DML rows", total), _cat("3 moons", total)
    )
    return table(spark, sf, "part").select("p_partkey", *[c.alias(k) for k, c in x.running_limit(body).items()])


@query(
    "p32_page_calls",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Ctrl' || p_size || '.save' || p_partkey || '()' WHEN 1 THEN 'Ctrl' || p_size || '()'
  WHEN 2 THEN 'Ctrl' || p_size ELSE 'Big Ctrl' || p_size END AS text, p_partkey % 4 = 2 AS endless FROM part""",
)
def _(spark, sf):
    n = F.col("p_size")
    cls = _pick(_cat("Ctrl", n), _cat("Ctrl", n), _cat("Ctrl", n), _cat("Big Ctrl", n))
    method = _pick(_cat("invoke(save", F.col("p_partkey"), ")"), "<init>", "", "")
    parts = F.array(F.lit("t"), F.lit("VF_APEX_CALL_START"), F.lit("[1]"), F.lit("01p"), method, cls)
    call = x.page_call()
    rows = table(spark, sf, "part").select("p_partkey", parts.alias("parts"))
    return rows.select("p_partkey", call["text"].alias("text"), call["endless"].alias("endless"))
