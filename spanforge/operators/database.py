"""Database cost: statement lists, net time, ranked statements, call paths, attribution, budgets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import dml_operation, from_object
from spanforge.operators.highlights import concentration
from spanforge.operators.tree import caller_namespace, chain_of
from spanforge.schema import DEFAULT_LIMITS, KEY, SOSL_ROWS_PER_QUERY, STATEMENT_TYPES
from spanforge.session import cut

KINDS = ("SOQL", "DML", "SOSL")
UNKNOWN = "Unknown"

# kind, statement-count metric, row metric
KIND_LIMITS = [
    ("SOQL", "soqlQueries", "queryRows"),
    ("DML", "dmlStatements", "dmlRows"),
    ("SOSL", "soslQueries", None),
]


def kind_of(type_col: str = "type") -> Column:
    expr = F.lit(None).cast("string")
    for name, kind in STATEMENT_TYPES.items():
        expr = F.when(F.col(type_col) == name, kind).otherwise(expr)
    return expr


def statements(spans: DataFrame) -> DataFrame:
    """Database statements with kind, label, object and rows.

    The plan line, when there is one, is the query's first child: the next event of the log.
    """
    found = spans.filter(F.col("type").isin(list(STATEMENT_TYPES)))
    kind = kind_of()
    if "plan" in spans.columns:
        plans = spans.filter(
            (F.col("type") == "SOQL_EXECUTE_EXPLAIN")
            & (F.col("event_index") == F.col("parent_index") + 1)
        ).select("log_id", F.col("parent_index").alias("event_index"), F.col("plan").alias("__plan"))
        found = found.drop("plan").join(plans, KEY, "left").withColumnRenamed("__plan", "plan")
        planned = F.col("plan.sobject")
    else:
        planned = F.lit(None).cast("string")
    target = F.when(kind == "SOQL", F.coalesce(planned, from_object(F.col("text")))).when(
        kind == "DML", F.col("sobject_type")
    )
    rows = (
        F.when(kind == "SOQL", F.col("soql_rows_self"))
        .when(kind == "DML", F.col("dml_rows_self"))
        .otherwise(F.col("sosl_rows_self"))
    )
    label = F.when(
        kind == "DML",
        F.concat_ws(" ", dml_operation(F.col("text")), F.coalesce("sobject_type", F.lit(UNKNOWN))),
    ).otherwise(F.col("text"))
    return found.withColumns({"kind": kind, "label": label, "sobject": target, "rows": rows})


def soql_grid(spans: DataFrame) -> DataFrame:
    """One row per query; selective when the plan's relative cost is at most 1."""
    found = statements(spans).filter(F.col("kind") == "SOQL")
    if "plan" in found.columns:
        cost = F.col("plan.relative_cost")
        plan = [
            F.when(F.coalesce(cost, F.lit(0.0)) != 0, cost <= 1).alias("is_selective"),
            cost.alias("relative_cost"),
            F.col("plan.leading_op").alias("leading_op"),
            F.col("plan.sobject").alias("plan_object"),
            F.col("plan.cardinality").alias("cardinality"),
            F.col("plan.sobject_cardinality").alias("sobject_cardinality"),
            F.array_join("plan.fields", ", ").alias("plan_fields"),
        ]
    else:
        plan = [F.lit(None).cast("boolean").alias("is_selective")]
    extra = [F.col("aggregations")] if "aggregations" in found.columns else []
    return caller_namespace_of(found, spans).select(
        *KEY, "text", "namespace", "caller_namespace", "sobject", "rows",
        F.col("dur_total").alias("time_ns"), *extra, *plan,
    )


def dml_grid(spans: DataFrame) -> DataFrame:
    found = statements(spans).filter(F.col("kind") == "DML")
    return caller_namespace_of(found, spans).select(
        *KEY, "text", "namespace", "caller_namespace", "sobject", "rows",
        F.col("dur_total").alias("time_ns"),
    )


def sosl_grid(spans: DataFrame) -> DataFrame:
    found = statements(spans).filter(F.col("kind") == "SOSL")
    return caller_namespace_of(found, spans).select(
        *KEY, "text", "namespace", "caller_namespace", "rows", F.col("dur_total").alias("time_ns")
    )


def caller_namespace_of(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Caller namespace for a subset of rows: their direct parent's, else `default`."""
    linked = caller_namespace(
        spans.select(*KEY, "parent_index", "last_index", "namespace", "type")
    ).filter(F.col("type").isin(list(STATEMENT_TYPES)))
    return rows.join(linked.select(*KEY, "caller_namespace"), KEY)


def with_enclosing(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Add `enclosing`, the nearest statement above, and `net_ns`, time without nested statements."""
    frames = spans.filter(F.col("type").isin(list(STATEMENT_TYPES)))
    linked = chain_of(found, frames, {"f_type": F.col("type")})
    above = linked.withColumn("enclosing", F.try_element_at("chain", F.lit(-1)).getField("index")).drop("chain")
    nested = (
        above.filter(F.col("enclosing").isNotNull())
        .groupBy("log_id", F.col("enclosing").alias("event_index"))
        .agg(F.sum("dur_total").alias("__nested"))
    )
    net = F.greatest(F.lit(0), F.col("dur_total") - F.coalesce("__nested", F.lit(0)))
    return above.join(nested, KEY, "left").withColumn("net_ns", net).drop("__nested")


def statement_net_time(spans: DataFrame) -> DataFrame:
    return with_enclosing(statements(spans), spans)


def database_time(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Net time, count and count per kind, and the database share of each log."""
    net = _by_kind(statement_net_time(spans))
    return logs.select("log_id", "duration_ns").join(net, "log_id").withColumn(
        "percent_of_log",
        F.when(F.col("duration_ns") > 0, F.col("database_ns") / F.col("duration_ns") * 100).otherwise(0.0),
    )


def _by_kind(net: DataFrame) -> DataFrame:
    return net.groupBy("log_id").agg(
        F.sum("net_ns").alias("database_ns"),
        *[
            F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("net_ns"))), F.lit(0)).alias(f"{k.lower()}_ns")
            for k in KINDS
        ],
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"{k.lower()}_statements") for k in KINDS],
    )


def ranked_statements(spans: DataFrame) -> DataFrame:
    """Distinct statements with repeats, rows, times and the slowest run."""
    return (
        statement_net_time(spans)
        .groupBy("log_id", "kind", "label")
        .agg(
            F.count("*").alias("repeats"),
            F.sum("rows").alias("rows"),
            F.max("rows").alias("max_rows"),
            F.sum("dur_self").alias("self_ns"),
            F.sum("net_ns").alias("net_ns"),
            F.sum("dur_total").alias("time_ns"),
            F.min("event_index").alias("first_index"),
            F.min_by("sobject", "event_index").alias("sobject"),
            F.max_by("event_index", F.struct("net_ns", (-F.col("event_index")).alias("o"))).alias("slowest_index"),
        )
    )


def statement_occurrences(spans: DataFrame) -> DataFrame:
    """Every run behind a ranked statement, one row each."""
    return statement_net_time(spans).select(
        "log_id", "kind", "label", "event_index", "rows", "net_ns", "dur_total"
    )


def db_concentration(spans: DataFrame, share: float = 0.75) -> DataFrame:
    """How many distinct statements hold `share` of the database time, and what they hold."""
    return concentration(ranked_statements(spans), "net_ns", share)


def database_tree(spans: DataFrame) -> DataFrame:
    """Call paths that end in statements.

    Time counts below an enclosing statement only once; self time counts once per frame, however
    many statements run under it.
    """
    found = statement_net_time(spans)
    fields = {
        "a_type": F.col("type"),
        "a_text": F.col("text"),
        "a_self": F.col("dur_self"),
        "a_object": F.col("sobject_type"),
    }
    linked = chain_of(found, spans, fields)
    own = F.struct(
        F.size("path").alias("at"),
        F.col("event_index").alias("index"),
        F.col("type").alias("a_type"),
        F.col("text").alias("a_text"),
        F.col("dur_self").alias("a_self"),
        F.col("sobject_type").alias("a_object"),
    )
    shown = F.filter("chain", lambda a: a["a_text"] != a["a_type"])
    stacks = linked.select(
        "log_id", "event_index", "dur_total", "enclosing", F.concat(shown, F.array(own)).alias("frames")
    )

    def name(f: Column) -> Column:
        kind = F.lit(None).cast("string")
        for t, k in STATEMENT_TYPES.items():
            kind = F.when(f["a_type"] == t, k).otherwise(kind)
        label = F.when(
            kind == "DML",
            F.concat_ws(" ", dml_operation(f["a_text"]), F.coalesce(f["a_object"], F.lit(UNKNOWN))),
        ).otherwise(f["a_text"])
        return F.concat(F.coalesce(kind, F.lit("frame")), F.lit(":"), label)

    steps = stacks.withColumn("names", F.transform("frames", name)).select(
        "log_id", "dur_total", "enclosing", "names", F.posexplode("frames").alias("at", "f")
    )
    per_frame = steps.groupBy(
        "log_id",
        F.slice("names", F.lit(1), F.col("at") + 1).alias("key_path"),
        F.col("f.index").alias("frame"),
    ).agg(
        F.sum(
            F.when(
                F.col("enclosing").isNull() | (F.col("f.index") > F.col("enclosing")), F.col("dur_total")
            ).otherwise(0)
        ).alias("time_ns"),
        F.first("f.a_self").alias("self_ns"),
    )
    return per_frame.groupBy("log_id", "key_path").agg(
        F.sum("time_ns").alias("time_ns"),
        F.sum("self_ns").alias("self_ns"),
        F.count("*").alias("frames"),
    )


def _attribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("log_id", "namespace").agg(
        F.sum("time_ns").alias("time_ns"),
        *[
            F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("time_ns"))), F.lit(0)).alias(f"{k.lower()}_ns")
            for k in KINDS
        ],
        F.sum("runs").alias("statements"),
        F.sum("rows_read").alias("rows_read"),
        F.sum("rows_written").alias("rows_written"),
    )


def _asked(spans: DataFrame) -> DataFrame:
    outer = statement_net_time(spans).filter(F.col("enclosing").isNull())
    read = F.when(F.col("kind") == "DML", 0).otherwise(F.col("rows"))
    return caller_namespace_of(outer, spans).select(
        *KEY,
        "kind",
        F.col("caller_namespace").alias("namespace"),
        F.col("dur_total").alias("time_ns"),
        F.lit(1).alias("runs"),
        read.alias("rows_read"),
        (F.col("rows") - read).alias("rows_written"),
    )


def db_asked_by(spans: DataFrame) -> DataFrame:
    """Outermost statements charged to the namespace that issued them."""
    return _attribution(_asked(spans))


def db_burned_in(spans: DataFrame) -> DataFrame:
    """Timed direct children charged to their own namespace, the remainder to the caller."""
    asked = cut(_asked(spans))
    child_ns = F.when(F.col("namespace") != "", F.col("namespace")).otherwise("default")
    inside = (
        spans.filter(F.col("is_parent") & (F.col("dur_total") > 0) & (F.col("parent_index") > 0))
        .groupBy("log_id", F.col("parent_index").alias("event_index"), child_ns.alias("child_ns"))
        .agg(F.sum("dur_total").alias("child_time"))
        .join(asked.select(*KEY, "kind"), KEY)
    )
    inside = cut(inside)
    spent = inside.groupBy(*KEY).agg(F.sum("child_time").alias("spent"))
    rest = asked.join(spent, KEY, "left").withColumn(
        "time_ns", F.greatest(F.lit(0), F.col("time_ns") - F.coalesce("spent", F.lit(0)))
    )
    zero = F.lit(0)
    children = inside.select(
        "log_id", "kind", F.col("child_ns").alias("namespace"), F.col("child_time").alias("time_ns"),
        zero.alias("runs"), zero.cast("long").alias("rows_read"), zero.cast("long").alias("rows_written"),
    )
    return _attribution(rest.select(*children.columns).unionByName(children))


def row_budget(ranked: DataFrame) -> DataFrame:
    """Rows and runs by object for SOQL and DML."""
    return (
        ranked.filter(F.col("kind").isin("SOQL", "DML") & (F.col("rows") > 0))
        .groupBy("log_id", "kind", F.coalesce("sobject", F.lit(UNKNOWN)).alias("sobject"))
        .agg(F.sum("rows").alias("rows"), F.sum("repeats").alias("statements"))
    )


def worst_search(ranked: DataFrame) -> DataFrame:
    """Largest single search against the per-search row cap."""
    return (
        ranked.filter(F.col("kind") == "SOSL")
        .groupBy("log_id")
        .agg(F.max("max_rows").alias("rows"))
        .filter(F.col("rows") > 0)
        .withColumn("limit", F.lit(SOSL_ROWS_PER_QUERY).cast("long"))
    )


def _limit(totals: DataFrame | None, logs: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """One row per log with used_/limit_ per wanted metric and whether the log reported limits."""
    if totals is None:
        return logs.select(
            "log_id",
            F.lit(False).alias("has_limits"),
            *[F.lit(0).cast("long").alias(f"used_{n}") for n in metrics],
            *[F.lit(DEFAULT_LIMITS[m]).cast("long").alias(f"limit_{n}") for n, m in metrics.items()],
        )
    picked = totals.groupBy("log_id").agg(
        F.max("has_limits").alias("has_limits"),
        *[F.max(F.when(F.col("metric") == m, F.col("used"))).alias(f"used_{n}") for n, m in metrics.items()],
        *[F.max(F.when(F.col("metric") == m, F.col("limit"))).alias(f"limit_{n}") for n, m in metrics.items()],
    )
    return logs.select("log_id").join(picked, "log_id", "left").select(
        "log_id",
        F.coalesce("has_limits", F.lit(False)).alias("has_limits"),
        *[F.coalesce(f"{p}_{n}", F.lit(0)).alias(f"{p}_{n}") for p in ("used", "limit") for n in metrics],
    )


_BUDGET_METRICS = {
    "soql": "soqlQueries",
    "soql_rows": "queryRows",
    "dml": "dmlStatements",
    "dml_rows": "dmlRows",
    "sosl": "soslQueries",
}


def database_sections(spans: DataFrame, logs: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per log and gauge: figure found in the log, governor figure and limit where reported.

    `totals` is limits.limit_totals (log_id, metric, used, limit, has_limits).
    """
    found = statements(spans).groupBy("log_id").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(k.lower()) for k in KINDS],
        *[
            F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rows"))), F.lit(0)).alias(f"{k.lower()}_rows")
            for k in KINDS
        ],
    )
    joined = _limit(totals, logs, _BUDGET_METRICS).join(found, "log_id", "left")
    known = F.col("has_limits")

    def gauge(label: str, n: str) -> Column:
        return F.struct(
            F.lit(label).alias("gauge"),
            F.coalesce(F.col(n), F.lit(0)).cast("long").alias("found"),
            F.when(known, F.col(f"used_{n}")).cast("long").alias("used"),
            F.when(known, F.col(f"limit_{n}")).otherwise(0).cast("long").alias("limit"),
        )

    search_rows = F.coalesce("sosl_rows", F.lit(0)).cast("long")
    gauges = F.array(
        gauge("DML", "dml"),
        gauge("SOQL", "soql"),
        gauge("SOSL", "sosl"),
        gauge("DML Rows", "dml_rows"),
        gauge("Query Rows", "soql_rows"),
        F.struct(
            F.lit("Search Rows").alias("gauge"),
            search_rows.alias("found"),
            F.when(known, search_rows).alias("used"),
            (F.col("limit_sosl") * SOSL_ROWS_PER_QUERY).cast("long").alias("limit"),
        ),
    )
    return joined.select("log_id", F.explode(gauges).alias("g")).select("log_id", "g.*")


def statement_budget(spans: DataFrame, logs: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Statement counts: the governor's figure when the log reported limits, else the observed."""
    counts = _by_kind(statement_net_time(spans))
    joined = _limit(totals, logs, _BUDGET_METRICS).join(counts, "log_id", "left")
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"),
                F.when(F.col("has_limits"), F.col(f"used_{k.lower()}"))
                .otherwise(F.coalesce(f"{k.lower()}_statements", F.lit(0)))
                .cast("long")
                .alias("used"),
                F.col(f"limit_{k.lower()}").cast("long").alias("limit"),
            )
            for k in KINDS
        ]
    )
    return joined.select("log_id", F.explode(rows).alias("r")).select("log_id", "r.*")


def row_budget_gap(spans: DataFrame, logs: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Rows counted by the governor that no statement holds, and whether a budget is passed."""
    held = (
        row_budget(ranked_statements(spans))
        .groupBy("log_id")
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rows"))), F.lit(0)).alias(f"held_{k}")
                for k in ("SOQL", "DML")
            ]
        )
    )
    joined = _limit(totals, logs, _BUDGET_METRICS).join(held, "log_id", "left")

    def row(kind: str, n: str) -> Column:
        observed = F.coalesce(f"held_{kind}", F.lit(0))
        used = F.when(F.col("has_limits"), F.col(f"used_{n}"))
        shown = F.coalesce(used, observed)
        limit = F.col(f"limit_{n}")
        return F.struct(
            F.lit(kind).alias("kind"),
            observed.cast("long").alias("observed"),
            used.cast("long").alias("used"),
            limit.cast("long").alias("limit"),
            F.greatest(F.lit(0), shown - observed).cast("long").alias("unattributed"),
            ((limit > 0) & (F.greatest(observed, F.coalesce(used, F.lit(0))) > limit)).alias("over_limit"),
        )

    return joined.select(
        "log_id", F.explode(F.array(row("SOQL", "soql_rows"), row("DML", "dml_rows"))).alias("r")
    ).select("log_id", "r.*")
