"""Literal logs through the whole parser."""

import pytest
from pyspark.sql import functions as F


def line(ts, *parts):
    return f"09:18:22.6 ({ts})|" + "|".join(parts)


def log(*lines):
    return "\n".join(lines) + "\n"


PSEUDO = log(
    line(100, "EXECUTION_STARTED"),
    line(200, "WF_FORMULA", "a", "b"),
    line(210, "WF_RULE_FILTER", "x"),
    line(250, "WF_FORMULA", "c", "d"),
    line(300, "METHOD_ENTRY", "[1]", "id", "A.b()"),
    line(400, "METHOD_EXIT", "[1]", "id", "A.b()"),
    line(500, "EXECUTION_FINISHED"),
)
UNWIND = log(
    line(100, "EXECUTION_STARTED"),
    line(110, "METHOD_ENTRY", "[1]", "id", "A.a()"),
    line(120, "METHOD_ENTRY", "[2]", "id", "A.b()"),
    line(130, "EXCEPTION_THROWN", "[3]", "System.LimitException: Too many SOQL queries: 101"),
    "Class.A.b: line 3",
    line(140, "METHOD_EXIT", "[1]", "id", "A.a()"),
    line(150, "EXECUTION_FINISHED"),
)
TRUNCATED = log(
    line(100, "EXECUTION_STARTED"),
    line(110, "METHOD_ENTRY", "[1]", "id", "A.a()"),
    "*** Skipped 1,024 bytes of detailed log",
    line(120, "HEAP_ALLOCATE", "[2]", "Bytes:10"),
    line(130, "METHOD_ENTRY", "[3]", "id", "A.c()"),
)
FLOW = log(
    line(100, "EXECUTION_STARTED"),
    line(110, "FLOW_START_INTERVIEWS_BEGIN", "1"),
    line(115, "FLOW_START_INTERVIEW_BEGIN", "id", "My Flow"),
    line(120, "FLOW_ELEMENT_BEGIN", "id", "FlowRecordLookup", "get"),
    line(125, "SOQL_EXECUTE_BEGIN", "[1]", "Aggregations:0", "SELECT Id FROM A"),
    line(130, "SOQL_EXECUTE_END", "[1]", "Rows:2"),
    line(135, "FLOW_ELEMENT_LIMIT_USAGE", "3 SOQL queries, total 5 out of 100"),
    line(136, "FLOW_ELEMENT_LIMIT_USAGE", "10 ms CPU time, total 10 out of 15000"),
    line(140, "FLOW_ELEMENT_END", "id", "FlowRecordLookup", "get"),
    line(150, "FLOW_START_INTERVIEW_END", "id", "My Flow"),
    line(160, "FLOW_START_INTERVIEWS_END", "1"),
    line(200, "EXECUTION_FINISHED"),
)
LIMITS = log(
    line(100, "EXECUTION_STARTED"),
    line(110, "CUMULATIVE_LIMIT_USAGE"),
    line(111, "LIMIT_USAGE_FOR_NS", "(default)", ""),
    "  Number of SOQL queries: 8 out of 100",
    "  Maximum heap size: 700 out of 6000000 ******* CLOSE TO LIMIT",
    line(120, "LIMIT_USAGE_FOR_NS", "abc", ""),
    "  Number of SOQL queries: 2 out of 100",
    line(130, "CUMULATIVE_LIMIT_USAGE_END"),
    line(140, "EXECUTION_FINISHED"),
)
PLAN = log(
    line(100, "EXECUTION_STARTED"),
    line(110, "CODE_UNIT_STARTED", "[EXTERNAL]", "01q", "T on Account trigger event BeforeInsert", "__sfdc_trigger/ns/T"),
    line(120, "SOQL_EXECUTE_BEGIN", "[7]", "Aggregations:1", "SELECT Id, (SELECT Id FROM Contacts) FROM Account"),
    line(121, "SOQL_EXECUTE_EXPLAIN", "[7]", "TableScan on Account : [], cardinality: 5, sobjectCardinality: 200, relativeCost 2.5"),
    line(130, "SOQL_EXECUTE_END", "[7]", "Rows:5"),
    line(140, "CODE_UNIT_FINISHED", "T on Account trigger event BeforeInsert"),
    line(150, "EXECUTION_FINISHED"),
)
HEAP = log(
    line(100, "EXECUTION_STARTED"),
    line(110, "METHOD_ENTRY", "[1]", "id", "Stats.a()"),
    line(111, "HEAP_ALLOCATE", "[1]", "Bytes:500000"),
    line(112, "HEAP_ALLOCATE", "[1]", "Bytes:-500000"),
    line(120, "METHOD_EXIT", "[1]", "id", "Stats.a()"),
    line(130, "METHOD_ENTRY", "[2]", "id", "Data.b()"),
    line(131, "HEAP_ALLOCATE", "[2]", "Bytes:5000000"),
    line(140, "METHOD_EXIT", "[2]", "id", "Data.b()"),
    line(150, "METHOD_ENTRY", "[3]", "id", "View.c()"),
    line(151, "HEAP_ALLOCATE", "[3]", "Bytes:-5000000"),
    line(160, "METHOD_EXIT", "[3]", "id", "View.c()"),
    line(200, "EXECUTION_FINISHED"),
)
NAMES = log(
    line(100, "EXECUTION_STARTED"),
    line(110, "METHOD_ENTRY", "[1]", "id", "ns1.Outer.run()"),
    line(120, "METHOD_EXIT", "[1]", "ns1.Outer"),
    line(130, "METHOD_ENTRY", "[2]", "id", "ns1.Outer.run()"),
    line(140, "METHOD_EXIT", "[2]", "id", "ns1.Outer.run()"),
    line(150, "CONSTRUCTOR_ENTRY", "[3]", "id", "<init>(String)", "ns2.A.B"),
    line(160, "CONSTRUCTOR_EXIT", "[3]", "id", "<init>(String)", "ns2.A.B"),
    line(170, "EXECUTION_FINISHED"),
)
LOGS = {
    "pseudo": PSEUDO, "unwind": UNWIND, "truncated": TRUNCATED, "flow": FLOW, "limits": LIMITS,
    "plan": PLAN, "heap": HEAP, "names": NAMES,
}


@pytest.fixture(scope="module", params=[200_000, 3])
def parsed(request, parse):
    return parse(LOGS, request.param)


@pytest.fixture(scope="module")
def spans(parsed):
    rows = parsed.spans.collect()
    return {k: {r.event_index: r for r in rows if r.log_id == k} for k in LOGS}


def test_next_line_ends(spans):
    s = spans["pseudo"]
    assert (s[2].exit_ns, s[4].exit_ns) == (250, 300)
    assert s[3].path == [1, 2] and s[4].path == [1] and s[5].path == [1]
    assert (s[1].dur_total, s[1].dur_self) == (400, 400 - 50 - 50 - 100)


def test_unwinding(spans, parsed):
    s = spans["unwind"]
    assert (s[3].exit_ns, s[2].exit_ns, s[1].exit_ns) == (140, 140, 150)
    assert s[4].text.endswith("101\nClass.A.b: line 3") and s[1].thrown_total == 1
    found = [r for r in parsed.issues.collect() if r.log_id == "unwind"]
    assert [(r.type, r.summary) for r in found] == [("error", "System.LimitException: Too many SOQL queries: 101")]
    assert found[0].description == "Class.A.b: line 3"


def test_truncation(spans, parsed):
    s = spans["truncated"]
    assert all(s[i].is_truncated and s[i].exit_ns == 130 for i in (1, 2, 4))
    found = {r.summary: r for r in parsed.issues.collect() if r.log_id == "truncated"}
    assert (found["Skipped-Lines"].start_ns, found["Skipped-Lines"].end_ns) == (110, 130)
    assert found["Unexpected-End"].event_index == 4 and found["Unexpected-End"].end_ns is None


def test_flow_residuals_and_names(spans):
    s = spans["flow"]
    # three reported, one logged below the element
    assert (s[4].soql_count_self, s[4].soql_count_total) == (2, 3)
    assert s[1].soql_count_total == 3 and s[5].soql_count_total == 1 and s[5].soql_rows_self == 2
    assert s[2].text == "FLOW_START_INTERVIEWS : My Flow"


def test_limit_blocks(parsed, spark):
    from spanforge.operators.facts import governor_totals

    rows = {(r.namespace, r.metric): r for r in parsed.limit_snapshots.collect()}
    assert len(rows) == 26
    assert rows["default", "soqlQueries"].used == 8 and rows["default", "heapSize"].limit == 6000000
    assert rows["abc", "dmlRows"].used == 0
    totals = governor_totals(parsed.limit_snapshots, parsed.spans).collect()
    by_metric = {r.metric: r for r in totals if r.log_id == "limits"}
    assert by_metric["soqlQueries"].used == 10 and by_metric["heapSize"].used == 700


def test_plan_and_lint(spans, parsed):
    from spanforge.operators import database, findings

    s = spans["plan"]
    assert s[2].namespace == "ns" and s[3].namespace == "ns" and s[3].aggregations == 1
    grid = [r for r in database.soql_grid(parsed.spans).collect() if r.log_id == "plan"][0]
    assert (grid.is_selective, grid.relative_cost, grid.sobject, grid.rows) == (False, 2.5, "Account", 5)
    plans = {r.rule: r for r in findings.find_plans(parsed.spans).collect() if r.log_id == "plan"}
    assert plans["plan-cost"].used == 2.5 and plans["plan-scan"].subject == "Account"
    lint = {r.subject for r in findings.find_lint(findings.linted_texts(parsed.spans)).collect() if r.log_id == "plan"}
    assert lint == {"unbounded", "in_trigger"}
    entry = [r for r in parsed.logs.collect() if r.log_id == "plan"][0]
    assert entry.entry_point == "Trigger T" and entry.duration_ns == 50


def test_heap(spans):
    s = spans["heap"]
    root = s[1]
    assert (root.heap_net_total, root.heap_gross_total, root.heap_peak) == (0, 5500000, 5000000)
    assert (s[2].heap_net_self, s[2].heap_gross_self) == (0, 500000) and root.heap_net_self == 0


def test_namespaces(spans):
    s = spans["names"]
    # the class reference names the namespace, so the later call is resolved by lookup
    assert s[2].namespace == "ns1" and s[4].namespace == "ns1"
    assert s[6].namespace == "ns2" and s[6].text == "ns2.A.B(String)"


def test_findings_run_over_all_logs(parsed):
    from spanforge.operators import findings, limits

    series = limits.limit_series(limits.limit_observations(parsed.spans, parsed.limit_snapshots))
    totals = limits.limit_totals(series, parsed.limit_snapshots)
    found = findings.findings(parsed.spans, parsed.issues, totals)
    rules = {(r.log_id, r.rule) for r in found.collect()}
    assert {("unwind", "limit"), ("truncated", "truncated"), ("truncated", "issue"), ("plan", "plan-cost")} <= rules
    used = {r.metric: r for r in totals.filter(F.col("log_id") == "limits").collect()}
    assert used["soqlQueries"].used == 10


def test_package_runs(parse):
    text = log(
        line(100, "EXECUTION_STARTED"),
        line(110, "ENTERING_MANAGED_PKG", "a"),
        line(120, "ENTERING_MANAGED_PKG", "x.a"),
        line(130, "USER_DEBUG", "[1]", "DEBUG", "note"),
        line(140, "ENTERING_MANAGED_PKG", "a"),
        line(150, "METHOD_ENTRY", "[1]", "id", "A.b()"),
        line(160, "METHOD_EXIT", "[1]", "id", "A.b()"),
        line(170, "ENTERING_MANAGED_PKG", "a"),
        line(200, "EXECUTION_FINISHED"),
    )
    rows = parse({"p": text}, 4).spans.filter(F.col("type") == "ENTERING_MANAGED_PKG").orderBy("event_index").collect()
    # debug lines do not break a run, a timed method does; the last run counts as the parent merged
    assert [(r.event_index, r.exit_ns, r.dur_total) for r in rows] == [(2, 150, 40), (8, 200, 30)]


def test_read_files_in_splits(spark, tmp_path):
    from spanforge.sources.logs import read_lines

    text = "\r\n".join(f"line {i}" if i % 7 else "" for i in range(1, 4001))
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in ("a.log", "b.log"):
        lines = {r.line_no: r.line for r in rows if r.log_id.endswith(name)}
        assert lines == {i: (f"line {i}" if i % 7 else "") for i in range(1, 4001)}


def test_write_csv(spark, tmp_path):
    from spanforge.sources.sinks import write_csv, write_spans

    df = spark.createDataFrame([("a", 1, 1_234_567, [1, 2])], "log_id string, event_index long, dur_total long, path array<long>")
    write_csv(df, str(tmp_path / "out"))
    row = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert (row.dur_total, row.path) == ("1.235", "[1,2]")
    write_spans(df, str(tmp_path / "spans"), 4)
    assert spark.read.parquet(str(tmp_path / "spans")).count() == 1


def test_levels_of_a_cut_off_log(spark):
    """The stack in slices and groups of slices, with a size marker in the middle, against one slice."""
    import random

    from test_stack_slices import calls

    from spanforge.operators.events import events_of, tag_lines
    from spanforge.operators.spans import pair
    from spanforge.session import cut

    fields = {"METHOD_ENTRY": "[1]|id|A.b()", "METHOD_EXIT": "[1]|id|A.b()", "CODE_UNIT_FINISHED": "A", "EXCEPTION_THROWN": "[2]|E: x", "USER_DEBUG": "[3]|DEBUG|x"}
    rows = []
    for k in range(3):
        text = [f"10:00:00.0 ({ts})|{kind}|{fields[kind]}" for _, ts, kind, _, _ in calls(random.Random(k), 1500)]
        if k:
            text[400 * k : 400 * k] = ["*** MAXIMUM DEBUG LOG SIZE REACHED ***"]
        rows += [(str(k), i + 1, t) for i, t in enumerate(text)]
    tagged = cut(tag_lines(spark.createDataFrame(rows, "log_id string, line_no long, line string")))
    events = cut(events_of(tagged))
    marks = cut(tagged.filter("role = 'max_size'").select("log_id", "event_index").distinct())
    want, got = [[sorted(map(str, t.collect())) for t in pair(events, marks, size, most)] for size, most in ((10**6, 10**6), (60, 40))]
    assert got == want
    assert any("Max-Size" in r for r in got[2])


def test_events_stay_in_place(spark):
    """What is looked up per slice is a small table, so that events are not shuffled for it."""
    from spanforge.operators.events import resolve_namespaces
    from spanforge.session import cut

    def shuffled(df):
        return "Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()

    rows = [("a", i, "ns" if i == 5 else None, "ns" if i in (2, 5, 8) else "other" if i == 9 else None) for i in range(1, 10)] + [("b", 9, None, "ns")]
    named = resolve_namespaces(cut(spark.createDataFrame(rows, "log_id string, event_index long, own_ns string, candidate string")), 4)
    assert not shuffled(named)
    assert {(r.log_id, r.event_index) for r in named.collect() if r.own_ns} == {("a", 5), ("a", 8)}
    assert named.count() == len(rows)
