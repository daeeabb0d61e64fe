"""Findings: ranked observations about a log, in one schema, with evidence rows beside them.

A finding is (log_id, id, rule, severity, tier, subject, count, time_ns, event_index, used, limit,
detail). Figures are columns; there is no prose. Evidence is a table of its own, one row per line,
so no list grows with the log.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators.database import statements
from spanforge.operators.highlights import tallies
from spanforge.operators.issues import exceptions as exception_events
from spanforge.operators.rollup import lookup
from spanforge.operators.scan import running, slice_of
from spanforge.operators.tree import chain_of, covered
from spanforge.schema import CHUNK, KEY

REPEATS = 5
DEBUG_LINES = 50
NEAR_LIMIT = 0.8
HOT_SHARE = 0.2
ROWS_PER_QUERY = 1.5
TRUNCATION, LIMIT, OTHER = 0, 1, 2
SEVERITIES = ["Error", "Warning", "Info"]

# Phrase of a limit exception -> metric, first match wins.
LIMIT_PHRASES = [
    ("apex cpu time", "cpuTime"),
    ("apex heap size", "heapSize"),
    ("too many soql queries", "soqlQueries"),
    ("too many query rows", "queryRows"),
    ("too many dml statements", "dmlStatements"),
    ("too many dml rows", "dmlRows"),
    ("too many sosl queries", "soslQueries"),
    ("too many callouts", "callouts"),
    ("too many email invocations", "emailInvocations"),
    ("too many future calls", "futureCalls"),
    ("too many queueable jobs", "queueableJobsAddedToQueue"),
]

_COLUMNS = ["id", "rule", "severity", "tier", "subject", "count", "time_ns", "event_index", "used", "limit", "detail"]


def _shape(df: DataFrame, rule: str, severity: Column | str, subject: Column, tier: int = OTHER, **cols: Column) -> DataFrame:
    given: Mapping[str, Column] = {
        "id": F.concat_ws("|", F.lit(rule), subject),
        "rule": F.lit(rule),
        "severity": F.lit(severity) if isinstance(severity, str) else severity,
        "tier": F.lit(tier),
        "subject": subject,
        "count": F.lit(1),
        "time_ns": F.lit(None),
        "event_index": F.lit(-1),
        "used": F.lit(None),
        "limit": F.lit(None),
        "detail": F.lit(None),
    } | cols
    kinds = {"count": "long", "time_ns": "long", "event_index": "long", "used": "double", "limit": "double", "detail": "string", "subject": "string"}
    return df.select("log_id", *[(given[c].cast(kinds[c]) if c in kinds else given[c]).alias(c) for c in _COLUMNS])


def group_time(rows: DataFrame, keys: Sequence[str], size: int = CHUNK) -> DataFrame:
    """Per group, the time of its rows that are not inside another row of the group."""
    seen = running(
        rows, keys, ["event_index"], [slice_of("event_index", size)], {"__far": ("max", F.col("last_index"))}, inclusive=False
    )
    outer = F.col("__far").isNull() | (F.col("__far") < F.col("event_index"))
    return seen.groupBy(*keys).agg(F.sum(F.when(outer, F.col("dur_total")).otherwise(0)).alias("time_ns"))


def find_truncation(issues: DataFrame) -> DataFrame:
    skips = issues.filter(F.col("type") == "skip").groupBy("log_id").agg(
        F.count("*").alias("n"),
        F.sum(tx.skipped_bytes(F.col("description"))).alias("bytes"),
        F.min_by("event_index", F.struct("start_ns", "event_index")).alias("at"),
    )
    return _shape(
        skips, "truncated", "Error", F.lit(None), TRUNCATION,
        count=F.col("n"), event_index=F.col("at"), used=F.when(F.col("bytes") > 0, F.col("bytes")),
    )


def hot_cause(spans: DataFrame) -> DataFrame:
    """The signature with the most self time, when it holds at least a fifth of it."""
    top = tallies(spans).groupBy("log_id").agg(
        F.sum("self_ns").alias("all_ns"),
        F.max_by(F.struct("text", "self_ns"), F.struct("self_ns", (-F.col("first_index")).alias("o"))).alias("t"),
    )
    share = F.col("t.self_ns") / F.col("all_ns")
    return top.filter(share >= HOT_SHARE).select(
        "log_id",
        F.substring_index("t.text", "|", -1).alias("label"),
        F.col("t.self_ns").alias("self_ns"),
        share.alias("share"),
    )


def _thrown(spans: DataFrame) -> DataFrame:
    """Exceptions with head, innermost frame and the enclosing method (or themselves)."""
    head, frame = tx.split_exception(F.col("text"))
    return exception_events(spans).select(
        *KEY, "type", "text", head.alias("head"), F.when(frame != "", frame).alias("frame"),
        F.coalesce(F.try_element_at("path", F.lit(-1)), "event_index").alias("within"),
    )


def _exception_findings(thrown: DataFrame) -> DataFrame:
    groups = thrown.groupBy("log_id", "head").agg(
        F.count(F.when(F.col("type") == "EXCEPTION_THROWN", 1)).alias("n"),
        F.max(F.col("type") == "FATAL_ERROR").alias("fatal"),
        F.min_by("within", "event_index").alias("at"),
    )
    return _shape(
        groups, "exception", "Error", F.col("head"),
        count=F.greatest("n", F.lit(1)), event_index=F.col("at"), detail=F.when(F.col("fatal"), "unhandled"),
    )


def _is_limit() -> Column:
    return F.col("text").contains("System.LimitException")


def _phrase_metric() -> Column:
    lower = F.lower("head")
    expr = F.lit(None).cast("string")
    for phrase, metric in reversed(LIMIT_PHRASES):
        expr = F.when(lower.contains(phrase), metric).otherwise(expr)
    return expr


def find_exceptions(spans: DataFrame) -> DataFrame:
    """Exceptions grouped by head; limit exceptions only when they name no known limit."""
    thrown = _thrown(spans)
    return _exception_findings(thrown.filter(~_is_limit() | _phrase_metric().isNull()))


def find_limits(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """Limits named by an exception, and reported limits used to at least 80 %.

    `totals` is limits.limit_totals.
    """
    breaches = (
        _thrown(spans)
        .filter(_is_limit())
        .withColumn("metric", _phrase_metric())
        .filter(F.col("metric").isNotNull())
        .groupBy("log_id", "metric")
        .agg(F.min_by("within", "event_index").alias("at"))
    )
    known = (F.col("used") > 0) & (F.col("limit") > 0)
    near = F.col("has_limits") & known & (F.col("used") / F.col("limit") >= NEAR_LIMIT)
    joined = (
        totals.select("log_id", "metric", "used", "limit", "has_limits")
        .join(breaches, ["log_id", "metric"], "full")
        .filter(F.col("at").isNotNull() | near)
        .join(hot_cause(spans).select("log_id", "label"), "log_id", "left")
    )
    return _shape(
        joined, "limit", F.when(F.col("at").isNotNull(), "Error").otherwise("Warning"), F.col("metric"), LIMIT,
        event_index=F.coalesce("at", F.lit(-1)),
        used=F.when(known, F.col("used")),
        limit=F.when(known, F.col("limit")),
        detail=F.when(F.col("metric") == "cpuTime", F.col("label")),
    )


def find_anomalies(issues: DataFrame) -> DataFrame:
    odd = issues.filter(F.col("type") == "unexpected")
    return _shape(odd, "issue", "Warning", F.col("summary"), event_index=F.coalesce("event_index", F.lit(-1)))


def _called(spans: DataFrame) -> DataFrame:
    """SOQL and DML statements with the call site: enclosing frame's text and the line."""
    found = statements(spans).filter(F.col("kind").isin("SOQL", "DML"))
    linked = lookup(found, "parent_index", spans, {"frame": F.col("text")})
    external = F.col("is_external") if "is_external" in spans.columns else F.lit(False)
    site = F.concat_ws("|", F.coalesce("frame", F.lit("")), F.col("line_number").cast("string"))
    return linked.withColumn("site", F.when(~external, site))


def find_repeats_line(spans: DataFrame) -> DataFrame:
    """One statement run at least five times from one place."""
    keys = ["log_id", "kind", "site", "text"]
    rows = _called(spans).filter(F.col("site").isNotNull()).select(*keys, "event_index", "last_index", "dur_total")
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("event_index").alias("at"))
    many = groups.filter(F.col("n") >= REPEATS)
    timed = many.join(group_time(rows, keys), keys)
    return _shape(
        timed, "repeat-line", "Warning", F.concat_ws("|", "kind", "site", "text"),
        count=F.col("n"), time_ns=F.col("time_ns"), event_index=F.col("at"), detail=F.col("text"),
    )


def find_repeats_text(spans: DataFrame) -> DataFrame:
    """One statement run at least five times from two or more places; unknown places count as one."""
    keys = ["log_id", "kind", "text"]
    rows = _called(spans).select(*keys, "site", "event_index", "last_index", "dur_total")
    # Sites are merged first, so a popular statement shuffles its sites, not its runs.
    per_site = rows.groupBy(*keys, "site").agg(F.count("*").alias("n"), F.min("event_index").alias("at"))
    groups = per_site.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count("*").alias("sites"), F.min("at").alias("at")
    )
    many = groups.filter((F.col("n") >= REPEATS) & (F.col("sites") >= 2))
    timed = many.join(group_time(rows, keys), keys)
    return _shape(
        timed, "repeat-text", "Warning", F.concat_ws("|", "kind", "text"),
        count=F.col("n"), time_ns=F.col("time_ns"), event_index=F.col("at"), used=F.col("sites"), detail=F.col("text"),
    )


def _shapes(spans: DataFrame) -> DataFrame:
    found = statements(spans).filter((F.col("kind") == "SOQL") & F.col("sobject").isNotNull())
    per_text = found.groupBy("log_id", tx.soql_shape(F.col("text")).alias("shape"), "text").agg(
        F.count("*").alias("n"),
        F.sum("rows").alias("rows"),
        F.sum("dur_total").alias("time_ns"),
        F.min("event_index").alias("at"),
        F.min_by("sobject", "event_index").alias("sobject"),
    )
    return per_text


def find_row_at_a_time(spans: DataFrame) -> DataFrame:
    """Queries that differ only in literals and return about a row each."""
    groups = _shapes(spans).groupBy("log_id", "shape").agg(
        F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.sum("time_ns").alias("time_ns"),
        F.count("*").alias("texts"), F.min("at").alias("at"), F.min_by("sobject", "at").alias("sobject"),
    )
    slow = groups.filter(
        (F.col("n") >= REPEATS) & (F.col("texts") >= 2) & (F.col("rows") != 0) & (F.col("rows") <= F.col("n") * ROWS_PER_QUERY)
    )
    return _shape(
        slow, "row-at-a-time", "Warning", F.col("shape"),
        count=F.col("n"), time_ns=F.col("time_ns"), event_index=F.col("at"), used=F.col("rows"), detail=F.col("sobject"),
    )


def find_plans(spans: DataFrame) -> DataFrame:
    """Query plans that cost more than 1, and table scans, by object."""
    explained = spans.filter(F.col("type") == "SOQL_EXECUTE_EXPLAIN").select(
        "log_id", F.col("parent_index").alias("event_index"), F.col("event_index").alias("seq"),
        F.coalesce("plan.sobject", F.lit("the queried object")).alias("object"),
        F.col("plan.relative_cost").alias("cost"), F.col("plan.leading_op").alias("op"),
    )
    queries = spans.filter(F.col("type") == "SOQL_EXECUTE_BEGIN").select(*KEY, "text", "dur_total")
    both = explained.join(queries, KEY)
    worst = F.struct("cost", (-F.col("seq")).alias("o"))
    costly = both.filter(F.col("cost") > 1).groupBy("log_id", "object").agg(
        F.count("*").alias("n"), F.sum("dur_total").alias("time_ns"), F.max("cost").alias("cost"),
        F.max_by("event_index", worst).alias("at"), F.max_by("text", worst).alias("text"),
    )
    scans = both.filter(F.col("op") == "TableScan").groupBy("log_id", "object").agg(
        F.count("*").alias("n"), F.sum("dur_total").alias("time_ns"),
        F.min_by("event_index", "seq").alias("at"), F.min_by("text", "seq").alias("text"),
    )
    return _shape(
        costly, "plan-cost", "Error", F.col("object"), count=F.col("n"), time_ns=F.col("time_ns"),
        event_index=F.col("at"), used=F.col("cost"), detail=F.col("text"),
    ).unionByName(
        _shape(
            scans, "plan-scan", "Warning", F.col("object"), count=F.col("n"), time_ns=F.col("time_ns"),
            event_index=F.col("at"), detail=F.col("text"),
        )
    )


def find_debug(spans: DataFrame) -> DataFrame:
    lines = spans.filter(F.col("type") == "USER_DEBUG").groupBy("log_id").agg(
        F.count("*").alias("n"), F.min("event_index").alias("at")
    )
    return _shape(
        lines.filter(F.col("n") >= DEBUG_LINES), "debug-statements", "Info", F.lit(None),
        count=F.col("n"), event_index=F.col("at"),
    )


def linted_texts(spans: DataFrame) -> DataFrame:
    """Distinct query texts with one boolean per lint rule. In-trigger is judged at the first run."""
    rows = spans.filter(F.col("type") == "SOQL_EXECUTE_BEGIN")
    keys = ["log_id", "text"]
    texts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("event_index").alias("event_index"))
    timed = texts.join(group_time(rows.select(*keys, "event_index", "last_index", "dur_total"), keys), keys)
    located = timed.join(rows.select(*KEY, "path"), KEY)
    linked = chain_of(located, spans, {"a_text": F.col("text")})
    triggered = F.exists("chain", lambda a: a["a_text"].contains(" trigger event "))
    return linked.withColumns(tx.lint_columns(F.col("text"), triggered)).drop("chain", "path")


def _broken(texts: DataFrame) -> DataFrame:
    rules = F.array(
        *[F.when(F.col(name), F.struct(F.lit(name).alias("rule"), F.lit(sev).alias("sev"))) for name, sev in tx.LINT_RULES]
    )
    return texts.select(*KEY, "text", "n", "time_ns", F.explode(F.array_compact(rules)).alias("r"))


def find_lint(texts: DataFrame) -> DataFrame:
    """Lint rules broken by any checked text (see linted_texts)."""
    groups = _broken(texts).groupBy("log_id", "r.rule", "r.sev").agg(
        F.sum("n").alias("n"), F.sum("time_ns").alias("time_ns"),
        F.min_by("event_index", F.struct((-F.col("n")).alias("o"), "event_index")).alias("at"),
    )
    return _shape(
        groups, "soql", F.col("sev"), F.col("rule"), count=F.col("n"), time_ns=F.col("time_ns"), event_index=F.col("at")
    )


def find_statistics(spans: DataFrame) -> DataFrame:
    """Findings that need nothing but spans."""
    parts = [
        find_exceptions(spans),
        find_lint(linted_texts(spans)),
        find_repeats_line(spans),
        find_repeats_text(spans),
        find_row_at_a_time(spans),
        find_debug(spans),
    ]
    if "plan" in spans.columns:
        parts.append(find_plans(spans))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def findings(spans: DataFrame, issues: DataFrame, totals: DataFrame) -> DataFrame:
    """All findings of all logs."""
    return (
        find_truncation(issues)
        .unionByName(find_limits(spans, totals))
        .unionByName(find_anomalies(issues))
        .unionByName(find_statistics(spans))
    )


def _severity_rank() -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        rank = F.when(F.col("severity") == s, i).otherwise(rank)
    return rank


def ranked(found: DataFrame) -> DataFrame:
    """Findings in report order within each log: severity, tier, count."""
    return found.orderBy("log_id", _severity_rank(), "tier", F.desc("count"), "id")


def evidence(spans: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Lines behind the findings, keyed by finding id: (log_id, id, text, event_index, count)."""
    slow = find_row_at_a_time(spans).select("log_id", "id", F.col("subject").alias("shape"))
    rows = _shapes(spans).join(slow, ["log_id", "shape"]).select(
        "log_id", "id", "text", F.col("at").alias("event_index"), F.col("n").alias("count")
    )
    if texts is not None:
        rows = rows.unionByName(
            _broken(texts).select(
                "log_id", F.concat(F.lit("soql|"), "r.rule").alias("id"), "text", "event_index", F.col("n").alias("count")
            )
        )
    one = F.lit(1).cast("long")
    frames = _thrown(spans).filter(~_is_limit() | _phrase_metric().isNull()).filter(F.col("frame").isNotNull())
    first = frames.groupBy("log_id", "head").agg(F.min_by("frame", "event_index").alias("text"))
    owners = find_exceptions(spans).select("log_id", "id", F.col("subject").alias("head"), "event_index")
    shown = first.join(owners, ["log_id", "head"]).select("log_id", "id", "text", "event_index", one.alias("count"))
    repeats = find_repeats_line(spans).unionByName(find_repeats_text(spans))
    lines = repeats.select("log_id", "id", F.col("detail").alias("text"), "event_index", one.alias("count"))
    return rows.unionByName(shown).unionByName(lines)


def scope_findings(found: DataFrame, proof: DataFrame, spans: DataFrame, selected: Column) -> DataFrame:
    """Findings whose own event or any evidence lies in a selected subtree."""
    inside = covered(spans, selected, "__in").filter("__in").select(*KEY)
    direct = found.join(inside, KEY, "left_semi").select("log_id", "id")
    by_proof = proof.join(inside, KEY, "left_semi").select("log_id", "id")
    return found.join(direct.unionByName(by_proof).distinct(), ["log_id", "id"], "left_semi")


def findings_coverage(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Whether plans were logged, linted of distinct query texts, and the log time."""
    queries = spans.filter(F.col("type") == "SOQL_EXECUTE_BEGIN")
    distinct = queries.groupBy("log_id", "text").agg(F.lit(1).alias("one"))
    texts = distinct.groupBy("log_id").agg(F.count("*").alias("distinct_texts"))
    plans = (
        spans.filter(F.col("type") == "SOQL_EXECUTE_EXPLAIN")
        .select("log_id", F.col("parent_index").alias("event_index"))
        .join(queries.select(*KEY), KEY, "left_semi")
        .groupBy("log_id")
        .agg(F.lit(True).alias("plans"))
    )
    n = F.coalesce("distinct_texts", F.lit(0))
    return logs.join(texts, "log_id", "left").join(plans, "log_id", "left").select(
        "log_id",
        F.coalesce("plans", F.lit(False)).alias("plans_known"),
        n.alias("linted"),
        n.alias("distinct_texts"),
        F.col("duration_ns").alias("log_ns"),
    )


def findings_by_severity(found: DataFrame, severities: Sequence[str] | None = None) -> DataFrame:
    """Findings per severity; bands without any are absent."""
    kept = found if severities is None else found.filter(F.col("severity").isin(list(severities)))
    return kept.groupBy("log_id", "severity").agg(F.count("*").alias("findings"))
