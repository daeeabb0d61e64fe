"""Worked examples and invariants of trees, scans and limits."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.schema import METRICS


def span_table(spark, logs):
    """{log_id: [(parent position or 0, text, self)]} in pre-order, totals and paths filled in."""
    rows = []
    for log_id, nodes in logs.items():
        path, last, total = {}, {}, {}
        for i, (parent, _, own) in enumerate(nodes, 1):
            path[i] = path[parent] + [parent] if parent else []
            last[i], total[i] = i, own
            for a in path[i]:
                last[a] = i
                total[a] += own
        for i, (parent, text, own) in enumerate(nodes, 1):
            rows.append((log_id, i, parent, len(path[i]), last[i], path[i], "METHOD_ENTRY", "default", text, "Apex", True, own, total[i], i * 10, i * 10 + total[i]))
    df = spark.createDataFrame(
        rows,
        "log_id string, event_index long, parent_index long, depth int, last_index long, path array<long>, type string, "
        "namespace string, text string, category string, is_parent boolean, dur_self long, dur_total long, ts_ns long, exit_ns long",
    )
    zero = F.lit(0).cast("long")
    return df.select("*", *[zero.alias(f"{m}_{p}") for m in METRICS for p in ("self", "total")], zero.alias("heap_peak"))


def test_bottom_up_recursion(spark):
    from spanforge.operators.trees import bottom_up, top_down

    spans = span_table(spark, {"a": [(0, "Outer", 100), (1, "recursive", 10), (2, "recursive", 8), (3, "recursive", 17)]})
    rows = {tuple(p.split("|")[-1] for p in r.caller_path): (r.dur_self, r.dur_total) for r in bottom_up(spans).collect()}
    rec = "recursive"
    assert rows[(rec,)] == (35, 35) and rows[("Outer",)] == (100, 135)
    assert rows[(rec, "Outer")] == (10, 10) and rows[(rec, rec)] == (25, 25)
    assert rows[(rec, rec, "Outer")] == (8, 8) and rows[(rec, rec, rec)] == (17, 17)
    # top-down counts no total under a parent of the same name
    down = {len(r.key_path): r.dur_total for r in top_down(spans).collect()}
    assert down == {1: 135, 2: 35, 3: 0, 4: 0}


@pytest.mark.parametrize("size", [4, 200_000])
def test_invariants(spark, size):
    from spanforge.operators.rollup import subtree_sums
    from spanforge.operators.tree import contains, covered
    from spanforge.operators.trees import bottom_up, method_metrics

    rng = random.Random(5)
    logs = {}
    for name in "abc":
        nodes, stack = [], []
        for i in range(1, 60):
            while stack and rng.random() < 0.45:
                stack.pop()
            nodes.append((stack[-1] if stack else 0, rng.choice("pqrs"), rng.randrange(20)))
            stack.append(i)
        logs[name] = nodes
    spans = span_table(spark, logs)
    summed = subtree_sums(spans, {"again": F.col("dur_self")}, size)
    assert summed.filter("again <> dur_total").count() == 0
    roots = bottom_up(spans).filter("depth = 0").groupBy("log_id").agg(F.sum("dur_self").alias("s"))
    whole = spans.groupBy("log_id").agg(F.sum("dur_self").alias("t"))
    assert roots.join(whole, "log_id").filter("s <> t").count() == 0
    flat = method_metrics(spans).groupBy("log_id").agg(F.sum("dur_self").alias("s"))
    assert flat.join(whole, "log_id").filter("s <> t").count() == 0
    hit = F.col("text") == "p"
    rows = contains(covered(spans, hit, "inside", size), hit, "has", size).collect()
    by_id = {(r.log_id, r.event_index): r for r in rows}
    for r in rows:
        up = [by_id[r.log_id, a] for a in r.path] + [r]
        assert r.inside == any(x.text == "p" for x in up)
        below = [x for x in rows if x.log_id == r.log_id and r.event_index <= x.event_index <= r.last_index]
        assert r.has == any(x.text == "p" for x in below)


def _series(spark, obs, **kw):
    from spanforge.operators.limits import limit_series

    rows = [("L", i, ts, "default", "soqlQueries", kind, value, 0 if kind == "cumulative" else 1) for i, (ts, kind, value) in enumerate(obs)]
    df = spark.createDataFrame(
        rows, "log_id string, event_index long, ts_ns long, namespace string, metric string, kind string, value long, rank int"
    )
    return [(r.ts_ns, r.used, r.tracked) for r in limit_series(df, **kw).orderBy("ts_ns").collect()]


@pytest.mark.parametrize("size", [1, 1000])
def test_limit_series_cases(spark, size):
    kw = {"size": size}
    assert _series(spark, [(1, "delta", 1), (2, "delta", 1)], **kw) == [(1, 1, None), (2, 2, None)]
    got = _series(spark, [(1, "cumulative", 0), (2, "delta", 1), (3, "cumulative", 3)], **kw)
    assert got[-1] == (3, 3, 1)
    assert _series(spark, [(1, "cumulative", 0), (2, "delta", 5), (3, "cumulative", 2)], **kw)[-1] == (3, 2, None)
    assert _series(spark, [(1, "cumulative", 3), (2, "delta", 1), (3, "delta", 1)], **kw)[-1][1] == 3


def test_gathering_does_not_depend_on_slices():
    from spanforge.operators.limits import _apply, _pending, _transfer

    rng = random.Random(3)
    for _ in range(300):
        limit = rng.choice([1, 2, 7, 40])
        values = [rng.choice([-9, -1, 1, 2, 3, 11]) for _ in range(rng.randrange(1, 25))]
        runs = _transfer(values, [False] * len(values), limit)
        for start in range(1 - limit, limit):
            pending = start
            for v in values:
                pending += v
                if abs(pending) >= limit:
                    pending = 0
            assert _apply(runs, start) == pending
        assert _apply(runs, 0) == _pending(values, [False] * len(values), limit)


def test_nested_statements(spark):
    from spanforge.operators.database import database_tree, statement_net_time

    spans = span_table(spark, {"a": [(0, "run", 5), (1, "DML Op:Insert Type:A", 10), (2, "trigger", 3), (3, "SELECT Id FROM B", 7)]})
    kind = F.when(F.col("event_index") == 2, "DML_BEGIN").when(F.col("event_index") == 4, "SOQL_EXECUTE_BEGIN").otherwise(F.col("type"))
    spans = spans.withColumn("type", kind).withColumn("sobject_type", F.when(F.col("event_index") == 2, "A"))
    rows = {r.event_index: r for r in statement_net_time(spans).collect()}
    assert rows[4].enclosing == 2 and rows[4].net_ns == 7 and rows[2].net_ns == 20 - 7 and rows[2].enclosing is None
    tree = {tuple(r.key_path): (r.time_ns, r.self_ns, r.frames) for r in database_tree(spans).collect()}
    assert tree[("frame:run",)] == (20, 5, 1)
    assert tree[("frame:run", "DML:Insert A")] == (20, 10, 1)
    assert tree[("frame:run", "DML:Insert A", "frame:trigger", "SOQL:SELECT Id FROM B")] == (7, 7, 1)


@pytest.mark.parametrize("size", [3, 40, 200_000])
def test_range_maxima(spark, size):
    from spanforge.operators.rollup import range_max

    rng = random.Random(size)
    points = [(log, at, rng.randint(1, 99)) for log in "ab" for at in rng.sample(range(1, 500), 120)]
    ranges = [("abc"[k % 3], k, low := rng.randint(0, 500), low + rng.choice([0, 1, 5, 60, 400])) for k in range(300)]
    got = range_max(
        spark.createDataFrame(points, "log_id string, at long, value long").repartition(3),
        spark.createDataFrame(ranges, "log_id string, event_index long, low long, high long"), size,
    ).collect()
    want = {}
    for log, k, low, high in ranges:
        inside = [v for name, at, v in points if name == log and low <= at <= high]
        if inside:
            want[log, k] = max(inside)
    assert {(r.log_id, r.event_index): r.value for r in got} == want and len(got) == len(want)


def test_heap_peaks_of_a_deep_tree(spark):
    """A thousand frames inside each other: rows stay linear, no path is exploded."""
    from spanforge.operators.rollup import heap_peaks

    rng = random.Random(3)
    depth = 1000
    rows = [("d", i, True, 0, 3 * depth) for i in range(1, depth + 1)] + [("d", depth + i, False, rng.randint(-9, 10), depth + i) for i in range(1, 2 * depth + 1)]
    df = spark.createDataFrame(rows, "log_id string, event_index long, is_parent boolean, heap_net_self long, last_index long")
    peaks = heap_peaks(df, size=64)
    plan = peaks._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(path" not in plan
    got = {r.event_index: r.heap_peak for r in peaks.collect()}
    live, held, want = 0, {}, {}
    for _, i, _, b, _ in rows[depth:]:
        live += b
        if b and live > 0:
            held[i] = live
    want = held | {i: max(held.values()) for i in range(1, depth + 1)}
    assert got == want


def test_continuation_lines_in_pieces(spark):
    from spanforge.operators import events

    rows = [("a", 1, "10:00:00.0 (5)|USER_DEBUG|[1]|DEBUG|x")] + [("a", i, f"line {i}") for i in range(2, 3500)] + [("a", 3500, "10:00:00.0 (9)|USER_DEBUG|[1]|DEBUG|y")]
    tagged = events.tag_lines(spark.createDataFrame(rows, "log_id string, line_no long, line string").repartition(5))
    extra = {r.line_no: r.extra for r in events.with_continuations(tagged).collect()}
    assert extra == {1: "\n".join(f"line {i}" for i in range(2, 3500)), 3500: None}


@pytest.mark.parametrize("metric", ["soqlQueries", "cpuTime"])
@pytest.mark.parametrize("size", [12, 200_000])
def test_folds_equal_one_pass(spark, metric, size):
    """Changes and reports of all kinds, with and without a cap, against one pass over each series."""
    from spanforge.operators.limits import fold_limits, with_limit

    rng = random.Random(7)
    rows = []
    for ns in range(12):
        kinds = ["delta", "delta", "scoped"] + ["cumulative"] * (ns % 3)
        for i in range(rng.choice([1, 5, 40])):
            kind = rng.choice(kinds)
            rows.append(("L", f"n{ns}", metric, i, i // 2, 0 if kind == "cumulative" else 1, kind, rng.choice([-40, -3, 1, 2, 9, 60]) if kind == "delta" else rng.randint(0, 80)))
    schema = "log_id string, namespace string, metric string, event_index long, ts_ns long, rank int, kind string, value long"
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = {(r.namespace, r.event_index): (r.used, r.tracked, r.saw_delta) for r in fold_limits(with_limit(df, None), size).collect()}
    want = {}
    for ns in range(12):
        mine = sorted((r for r in rows if r[1] == f"n{ns}"), key=lambda r: (r[4], r[5], r[3]))
        cap = max([r[7] for r in mine if r[6] == "cumulative"], default=None)
        x = tracked = 0
        seen = False
        for r in mine:
            kind, value = r[6:]
            if kind == "delta":
                x, tracked, seen = x + value, tracked + value, True
            elif kind == "cumulative":
                x = value
            else:
                x = max(value, x if cap is None else min(x, cap))
            want[r[1], r[3]] = (x if cap is None else min(x, cap), tracked, seen)
    assert got == want


def test_many_changes_in_one_second(spark):
    from spanforge.operators import limits

    n, size = 1_000_000, 200_000
    obs = spark.range(n).select(
        F.lit("L").alias("log_id"), F.col("id").alias("event_index"), (F.col("id") * 900).alias("ts_ns"), F.lit("default").alias("namespace"),
        F.lit("soqlQueries").alias("metric"), F.lit("delta").alias("kind"), F.lit(1).cast("long").alias("value"), F.lit(1).alias("rank"),
    )
    slices = limits._by_time(obs, size).groupBy("slice").count().agg(F.max("count"), F.count("*"), F.sum("count")).first()
    assert slices[0] <= size and slices[1] > 4 and slices[2] == n
    worked = limits._worked(limits.with_limit(obs, None), limits.reported_caps(obs), size)
    assert "Arrow" not in worked._jdf.queryExecution().toString()
    folded = limits.fold_limits(limits.with_limit(obs, None), size)
    assert folded.agg(F.max("used"), F.sum("used"), F.count("*")).first() == (n, n * (n + 1) // 2, n)


def test_hot_path_deeper_than_a_round(spark):
    """A chain longer than the steps of one plan, next to a path that ends at once."""
    from spanforge.operators.highlights import LEVELS, hot_path

    deep = [(k, f"f{k}", 1) for k in range(3 * LEVELS)] + [(3 * LEVELS, "leaf", 100)]
    flat = [(0, "a", 10), (0, "b", 9), (1, "c", 1)]
    rows = hot_path(span_table(spark, {"deep": deep, "flat": flat, "one": [(0, "x", 5)]})).collect()
    path = lambda log: [r.text for r in sorted(rows, key=lambda r: r.step) if r.log_id == log and r.kind == "path"]
    assert path("deep") == [t for _, t, _ in deep] and path("flat") == ["a"] and path("one") == ["x"]
    assert len(rows) == len(deep) + 2


def brute_bottom_up(nodes):
    """{caller path: [calls, self, total]} by walking up from every row of span_table's input."""
    path, total = {}, {i: own for i, (_, _, own) in enumerate(nodes, 1)}
    for i, (parent, _, _) in enumerate(nodes, 1):
        path[i] = path[parent] + [parent] if parent else []
    for i, (_, _, own) in enumerate(nodes, 1):
        for a in path[i]:
            total[a] += own
    text = {i: t for i, (_, t, _) in enumerate(nodes, 1)}
    net = dict(total)
    for i in total:
        equal = [a for a in path[i] if text[a] == text[i]]
        if equal:
            net[equal[-1]] -= total[i]
    out = {}
    for i, (_, _, own) in enumerate(nodes, 1):
        full = [text[i], *[text[a] for a in reversed(path[i])]]
        for n in range(1, len(full) + 1):
            row = out.setdefault(tuple(full[:n]), [0, 0, 0])
            for k, v in enumerate((1, own, net[i])):
                row[k] += v
    return out


def random_nodes(seed, n=80):
    rng = random.Random(seed)
    nodes, stack = [], []
    for i in range(1, n):
        while stack and rng.random() < 0.5:
            stack.pop()
        nodes.append((stack[-1] if stack else 0, rng.choice("pqr"), rng.randrange(1, 20)))
        stack.append(i)
    return nodes


def test_bottom_up_equals_a_walk(spark):
    from spanforge.operators.trees import bottom_up

    logs = {name: random_nodes(seed) for seed, name in enumerate("ab")}
    got = bottom_up(span_table(spark, logs)).collect()
    for name, nodes in logs.items():
        rows = {tuple(k.split("|")[-1] for k in r.caller_path): [r.calls, r.dur_self, r.dur_total] for r in got if r.log_id == name}
        assert rows == brute_bottom_up(nodes)


@pytest.mark.parametrize("size", [4, 200_000])
def test_paths_by_id_equal_paths_by_text(spark, size):
    """Ids of the paths above, their names, and what `more` makes, with a leaf whose path is not its parent's."""
    from spanforge.operators.tree import chain_of, event_key, frame_paths, with_paths
    from spanforge.schema import KEY

    spans = span_table(spark, {"a": random_nodes(3), "b": random_nodes(4), "c": [(0, "x", 1), (0, "y", 2), (2, "x", 3)]})
    stray = (F.col("log_id") == "a") & (F.col("last_index") == F.col("event_index")) & (F.size("path") > 2)
    spans = spans.withColumn("path", F.when(stray, F.slice("path", 2, 100)).otherwise(F.col("path"))).localCheckpoint()
    assert spans.filter(stray).count() > 3
    index = lambda chain: {"up": F.transform(chain, lambda a: a["index"])}
    rows, names = with_paths(spans, spans, frame_paths(spans, None, index, size), None, index, size)
    got = rows.join(names, ["log_id", "pa", "pb"]).select(*KEY, "above", "up")
    want = chain_of(spans, spans, {"key": event_key()}, size).select(*KEY, "chain.key", "chain.index")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == spans.count()


def test_scoped_trees_move_only_what_they_use(spark, monkeypatch):
    """Counters, times and heap of spans stay out of the sorts behind a scoped tree; its rows are those of a walk."""
    from spanforge.operators import scoped
    from spanforge.operators.scoped import row_occurrences, rows_by_event, scoped_bottom_up, scoped_top_down
    from spanforge.schema import METRICS

    kept, cut = [], scoped.cut
    monkeypatch.setattr(scoped, "cut", lambda df: kept.extend(df.columns) or cut(df))
    nodes = random_nodes(6)
    spans = span_table(spark, {"a": nodes}).localCheckpoint()
    picked = F.expr("text = 'q' AND dml_count_self = 0")
    path = {}
    want, seeds, rows = {}, {}, {}
    total = {r.event_index: r.dur_total for r in spans.collect()}
    for i, (parent, text, own) in enumerate(nodes, 1):
        path[i] = path[parent] + [i] if parent else [i]
        key = lambda j: f"METHOD_ENTRY|default|{nodes[j - 1][1]}"
        names = [tuple(key(j) for j in path[i][: k + 1]) for k in range(len(path[i]))]
        below = [a for a in path[i] if nodes[a - 1][1] == "q"]
        seen = [(i, total[i], own)] * len(below) + ([(a, total[i], 0) for a in path[i][:-1]] if text == "q" else [])
        for at, t, s in seen:
            name = names[path[i].index(at)]
            row = want.setdefault(name, [0, 0, 0])
            for k, v in enumerate((t, s, 1)):
                row[k] += v
            rows[at] = " > ".join(name)
            for n in range(1, len(name) + 1):
                if s > 0:
                    seeds[name[::-1][:n]] = seeds.get(name[::-1][:n], 0) + s
    assert {tuple(r.key_path): [r.dur_total, r.dur_self, r.calls] for r in scoped_top_down(spans, picked).collect()} == want
    assert "text" in kept and not {"heap_peak", "ts_ns", *[f"{m}_total" for m in METRICS]} & set(kept)
    assert {tuple(r.caller_path): r.dur_total for r in scoped_bottom_up(spans, picked).collect()} == seeds
    assert {r.event_index: r.rows for r in rows_by_event(row_occurrences(spans, picked)).collect()} == {i: [x] for i, x in rows.items()}
