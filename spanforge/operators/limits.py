"""Governor-limit usage over time, per log.

Observations are changes (`delta`), reports of a running total (`cumulative`) and reports that can
only raise the value (`scoped`). Per namespace and metric:

* small deltas are gathered until they reach 1/500 of the limit (`coalesce_deltas`); the order of
  arrival decides where, so this is a small automaton over slices of the series;
* the value shown is the last report plus what came after it, capped at the highest cumulative
  report (`fold_limits`).

Both run over slices of the time order with a bounded number of rows: a slice is summed up as a function of the
state it starts from, the functions are chained over the slices, and then each slice is worked with its
known start. Metrics whose every change shows need no gathering and stay in columns (`_counted`).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.operators.scan import running
from spanforge.schema import CHUNK, DEFAULT_LIMITS
from spanforge.session import cut

POINTS = 500
# Lookups at given times work in slices of one second of log time unless the caller says otherwise.
SECOND = 1_000_000_000
NS = ["log_id", "namespace", "metric"]
ORDER = ["ts_ns", "rank", "event_index"]


def limit_observations(spans: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """All observations: snapshots first at a given time, then events in log order."""
    ns = F.when(F.col("namespace") != "", F.col("namespace")).otherwise("default")
    t = F.col("type")

    def delta(types: list[str], metric: str, value: Column) -> DataFrame:
        return (
            spans.filter(t.isin(types))
            .select("log_id", "event_index", "ts_ns", ns.alias("namespace"), F.lit(metric).alias("metric"),
                    F.lit("delta").alias("kind"), value.cast("long").alias("value"))
            .filter(F.col("value") != 0)
        )

    out = (
        delta(["SOQL_EXECUTE_BEGIN"], "soqlQueries", F.col("soql_count_self"))
        .unionByName(delta(["SOQL_EXECUTE_BEGIN"], "queryRows", F.col("soql_rows_self")))
        .unionByName(delta(["SOSL_EXECUTE_BEGIN"], "soslQueries", F.col("sosl_count_self")))
        .unionByName(delta(["DML_BEGIN"], "dmlStatements", F.col("dml_count_self")))
        .unionByName(delta(["DML_BEGIN"], "dmlRows", F.col("dml_rows_self")))
        .unionByName(delta(["CALLOUT_REQUEST"], "callouts", F.lit(1)))
    )
    size = F.col("bytes") if "bytes" in spans.columns else F.col("heap_net_self")
    out = out.unionByName(delta(["HEAP_ALLOCATE", "BULK_HEAP_ALLOCATE"], "heapSize", size))
    out = out.unionByName(delta(["HEAP_DEALLOCATE"], "heapSize", -F.abs(size)))
    if "limit_obs" in spans.columns:
        flow_cpu = (t != "LIMIT_USAGE") & (F.col("limit_obs.metric") == "cpuTime")
        scoped = spans.filter(F.col("limit_obs.metric").isNotNull() & ~flow_cpu).select(
            "log_id", "event_index", "ts_ns", ns.alias("namespace"), F.col("limit_obs.metric").alias("metric"),
            F.lit("scoped").alias("kind"), F.col("limit_obs.used").alias("value"),
        )
        out = out.unionByName(scoped)
    out = out.withColumn("rank", F.lit(1))
    if snapshots is not None:
        out = out.unionByName(
            snapshots.select(
                "log_id", "event_index", "ts_ns", "namespace", "metric", F.lit("cumulative").alias("kind"),
                F.col("used").alias("value"), F.lit(0).alias("rank"),
            )
        )
    return out


def effective_limits(snapshots: DataFrame, defaults: Mapping[str, int] = DEFAULT_LIMITS) -> DataFrame:
    """Per log and metric with a reported limit: the larger of the default and any report."""
    return (
        snapshots.filter(F.col("limit") > 0)
        .groupBy("log_id", "metric")
        .agg(F.max("limit").alias("reported"))
        .select("log_id", "metric", F.greatest("reported", _default(defaults)).alias("limit"))
    )


def _default(defaults: Mapping[str, int]) -> Column:
    pairs = [F.lit(x) for k, v in defaults.items() for x in (k, int(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("metric")), F.lit(0)).cast("long")


def with_limit(df: DataFrame, limits: DataFrame | None, defaults: Mapping[str, int] = DEFAULT_LIMITS) -> DataFrame:
    """Attach the limit of each row's log and metric."""
    if limits is None:
        return df.withColumn("limit", _default(defaults))
    # The lookup side has at most 13 rows per log; a hot log's rows are split by the skew join.
    return df.join(
        limits.select("log_id", "metric", F.col("limit").alias("__l")), ["log_id", "metric"], "left"
    ).withColumn("limit", F.coalesce("__l", _default(defaults))).drop("__l")


def reported_caps(observations: DataFrame) -> DataFrame:
    """Highest cumulative report per namespace and metric."""
    return (
        observations.filter(F.col("kind") == "cumulative")
        .groupBy(*NS)
        .agg(F.greatest(F.max("value"), F.lit(0)).alias("cap"))
    )


# ---- gathering of small deltas -----------------------------------------------------------------


def _pending(values: list[int], cuts: list[bool], limit: int) -> int:
    """Pending sum at the end, from 0. A row with `cuts` is a report: it releases what is pending."""
    pending = 0
    for value, report in zip(values, cuts, strict=True):
        pending = 0 if report else pending + value
        if abs(pending) >= limit:
            pending = 0
    return pending


def _transfer(values: list[int], cuts: list[bool], limit: int) -> list[tuple[int, int, bool]]:
    """The end state as a function of the start state, as runs (first start, end, moves): within a
    run the end is constant, or moves along with the start. Starts that meet stay together, so the
    number of runs falls quickly."""
    if limit == 1 or any(cuts):
        return [(1 - limit, _pending(values, cuts, limit), False)]
    runs = [(1 - limit, 1 - limit, True)]  # (first start, state of it, moves with the start)
    top = limit - 1
    for value in values:
        out: list[tuple[int, int, bool]] = []
        for i, (first, state, moves) in enumerate(runs):
            last = runs[i + 1][0] - 1 if i + 1 < len(runs) else top
            state += value
            if not moves:
                out.append((first, 0 if abs(state) >= limit else state, False))
                continue
            # states state .. state + (last - first); those outside (-limit, limit) become 0
            low = max(first, first + (1 - limit) - state)
            high = min(last, first + (limit - 1) - state)
            if low > first:
                out.append((first, 0, False))
            if low <= high:
                out.append((low, state + low - first, True))
            if high < last:
                out.append((max(high + 1, first), 0, False))
        merged: list[tuple[int, int, bool]] = []
        for run in out:
            if merged and not run[2] and not merged[-1][2] and merged[-1][1] == run[1]:
                continue
            merged.append(run)
        runs = merged
    return runs


def _apply(runs: list[tuple[int, int, bool]], start: int) -> int:
    found = runs[0]
    for run in runs:
        if run[0] > start:
            break
        found = run
    return found[1] + (start - found[0]) if found[2] else found[1]


def _compose(f: tuple[float, float, int], value: int, kind: str, cap: float) -> tuple[float, float, int]:
    """Append one observation to x -> max(low, min(high, x + add))."""
    low, high, add = f
    if kind == "delta":
        return low + value, high + value, add + value
    if kind == "cumulative":
        return value, value, 0
    # max(value, min(x, cap))
    return max(min(low, cap), value), max(min(high, cap), value), add


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_SLICE_KEY = [("log_id", pa.string()), ("namespace", pa.string()), ("metric", pa.string()), ("slice", pa.int64())]
_SUMMARY = pa.schema(
    [
        *_SLICE_KEY,
        ("first", pa.list_(pa.int64())),
        ("state", pa.list_(pa.int64())),
        ("moves", pa.list_(pa.bool_())),
        ("low", pa.float64()),
        ("high", pa.float64()),
        ("add", pa.int64()),
        ("tracked", pa.int64()),
        ("deltas", pa.bool_()),
    ]
)
_START = pa.schema(
    [*_SLICE_KEY, ("pending", pa.int64()), ("base", pa.int64()), ("tracked", pa.int64()), ("deltas", pa.bool_())]
)
_VALUE = pa.schema(
    [
        *_SLICE_KEY,
        ("ts_ns", pa.int64()),
        ("rank", pa.int32()),
        ("event_index", pa.int64()),
        ("kind", pa.string()),
        ("value", pa.int64()),
        ("released", pa.bool_()),
        ("pending", pa.int64()),
        ("used", pa.int64()),
        ("tracked", pa.int64()),
        ("saw_delta", pa.bool_()),
    ]
)
_KEY_DDL = "log_id string, namespace string, metric string, slice long"
_INF = float("inf")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice: what it does to the pending sum and to the running value."""

    def close(key, values, reports, fold, threshold):
        runs = _transfer(values, reports, threshold)
        deltas = [v for v, r in zip(values, reports, strict=True) if not r]
        return (*key, [r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs], *fold, sum(deltas), bool(deltas))

    def rows():
        key, values, reports, fold, threshold = None, [], [], (-_INF, _INF, 0), 1
        for *head, _ts, _rank, _index, kind, value, limit, cap in _tuples(batches):
            if tuple(head) != key:
                if key is not None:
                    yield close(key, values, reports, fold, threshold)
                key, values, reports, fold = tuple(head), [], [], (-_INF, _INF, 0)
            threshold = limit
            values.append(value)
            reports.append(kind != "delta")
            fold = _compose(fold, value, kind, _INF if cap is None else cap)
        if key is not None:
            yield close(key, values, reports, fold, threshold)

    yield from _batched(rows(), _SUMMARY)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain the slice functions of each series; the state is four numbers."""

    def rows():
        key, pending, base, tracked, seen = None, 0, 0, 0, False
        for log_id, ns, metric, number, first, state, moves, low, high, add, more, deltas in _tuples(batches):
            if (log_id, ns, metric) != key:
                key, pending, base, tracked, seen = (log_id, ns, metric), 0, 0, 0, False
            yield (*key, number, pending, base, tracked, seen)
            pending = _apply(list(zip(first, state, moves, strict=True)), pending)
            base = int(max(low, min(high, base + add)))
            tracked, seen = tracked + more, seen or deltas

    yield from _batched(rows(), _START)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Work each slice from its known start."""

    def rows():
        key, x, tracked, seen, pending = None, 0, 0, False, 0
        for *head, ts, rank, index, kind, value, limit, cap, p0, b0, t0, d0 in _tuples(batches):
            if tuple(head) != key:
                key, pending, x, tracked, seen = tuple(head), p0, b0, t0, d0
            top = _INF if cap is None else cap
            released = False
            if kind == "delta":
                x, tracked, seen, pending = x + value, tracked + value, True, pending + value
                released = abs(pending) >= limit
            elif kind == "cumulative":
                x = value
            else:
                x = max(value, min(x, top))
            if released or kind != "delta":
                pending = 0
            yield (*key, ts, rank, index, kind, value, released, pending, min(x, top), tracked, seen)

    yield from _batched(rows(), _VALUE)


def _sorted(df: DataFrame, *keys: str) -> DataFrame:
    more = [c for c in ["slice", *ORDER] if c in df.columns and c not in keys]
    return df.repartition(*keys).sortWithinPartitions(*keys, *more)


def _by_time(rows: DataFrame, size: int) -> DataFrame:
    """`rows` with a `slice` that does not fall with log and time: sampled splitters bound its rows, whatever
    the rate of observations. Rows of one time stay together."""
    rows = cut(rows)
    parts = -(-4 * rows.count() // size)
    if parts < 2:
        return rows.withColumn("slice", F.lit(0).cast("long"))
    dealt = rows.repartitionByRange(parts, "log_id", "ts_ns")
    return cut(dealt.withColumn("slice", F.spark_partition_id().cast("long")))


def _worked(observations: DataFrame, caps: DataFrame, size: int) -> DataFrame:
    """Every observation with the state after it: released, pending, used, tracked, saw_delta."""
    threshold = F.greatest(F.lit(1), F.floor(F.col("limit") / POINTS)).cast("long")
    rows = _by_time(
        observations.withColumn("threshold", threshold)
        .join(caps, NS, "left")
        .select(*NS, *ORDER, "kind", "value", "threshold", "cap"),
        size,
    ).select(*NS, "slice", *ORDER, "kind", "value", "threshold", "cap")
    low, high = rows.agg(F.min("threshold"), F.max("threshold")).first()
    if low == high == 1:
        return _counted(rows)
    both = _gathered(rows.filter(F.col("threshold") > 1))
    return both.unionByName(_counted(rows.filter(F.col("threshold") == 1))) if low == 1 else both


def _gathered(rows: DataFrame) -> DataFrame:
    """`_worked` for metrics whose small changes are gathered: an automaton over the rows of a slice."""
    functions = _sorted(rows, *NS, "slice").mapInArrow(
        _summaries,
        f"{_KEY_DDL}, first array<long>, state array<long>, moves array<boolean>, low double, high double, "
        "add long, tracked long, deltas boolean",
    )
    starts = _sorted(functions, *NS).mapInArrow(
        _starts, f"{_KEY_DDL}, pending long, base long, tracked long, deltas boolean"
    )
    joined = rows.join(starts, [*NS, "slice"])
    return _sorted(joined, *NS, "slice").mapInArrow(
        _values,
        f"{_KEY_DDL}, ts_ns long, rank int, event_index long, kind string, value long, released boolean, "
        "pending long, used long, tracked long, saw_delta boolean",
    )


FAR = 2**61


def _counted(rows: DataFrame) -> DataFrame:
    """`_worked` for metrics whose every change shows, with columns alone.

    Between reports a value moves by the sum of the changes. A report is x -> max(low, min(high, x + add)), with
    the changes since the report before it as `add`; such functions are scanned in `chained`.
    """
    is_delta = F.col("kind") == "delta"
    change = F.when(is_delta, F.col("value")).otherwise(0)
    summed = cut(running(rows, NS, ORDER, [F.col("slice")], {"tracked": ("sum", change), "seen": ("max", is_delta.cast("int"))}))
    reports = running(summed.filter(~is_delta), NS, ORDER, [F.col("slice")], {"before": ("last", F.col("tracked"))}, inclusive=False)
    high = F.when(F.col("kind") == "cumulative", F.col("value")).otherwise(F.greatest(F.coalesce("cap", F.lit(FAR)), F.col("value")))
    steps = reports.select(
        *NS, "slice", *ORDER, F.struct(F.col("value").alias("low"), high.alias("high"), (F.col("tracked") - F.coalesce("before", F.lit(0))).alias("add")).alias("f")
    )
    at_report = chained(cut(steps), NS, ORDER)
    keys = [*NS, "slice", *ORDER]
    placed = summed.join(at_report.select(*keys, F.lit(False).alias("__delta"), "x"), [summed[k] == at_report[k] for k in keys] + [~is_delta], "left")
    placed = placed.select(*[summed[c] for c in summed.columns], "x")
    filled = running(placed, NS, ORDER, [F.col("slice")], {"base": ("last", F.when(F.col("x").isNotNull(), F.struct("x", "tracked")))})
    value = F.coalesce("base.x", F.lit(0)) + F.col("tracked") - F.coalesce("base.tracked", F.lit(0))
    return filled.select(
        *NS, "slice", *ORDER, "kind", "value", is_delta.alias("released"), F.lit(0).cast("long").alias("pending"),
        F.least(value, F.coalesce("cap", value)).alias("used"), "tracked", (F.col("seen") == 1).alias("saw_delta"),
    )


def _after(f: Column, g: Column) -> Column:
    """The function that is f and then g."""
    hold = lambda x: F.greatest(g["low"], F.least(g["high"], x + g["add"]))
    both = F.struct(hold(f["low"]).alias("low"), hold(f["high"]).alias("high"), (f["add"] + g["add"]).alias("add"))
    return F.when(f.isNull(), g).otherwise(both)


def _scanned(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`f` becomes all functions of its group up to it, by joining neighbours 1, 2, 4, ... rows back."""
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    over = W.partitionBy(*keys).orderBy(*order)
    for k in range((most - 1).bit_length()):
        df = df.withColumn("f", _after(F.lag("f", 2**k).over(over), F.col("f")))
    return df


def chained(steps: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add `x`, the value after each function `f` (low, high, add) of a series that starts at 0.

    Functions are scanned inside slices, and those of whole slices over the slices, so a task sorts a
    slice of a series, or one row for each of its slices.
    """
    inner = cut(_scanned(steps, [*keys, "slice"], order))
    wholes = inner.groupBy(*keys, "slice").agg(F.max_by("f", F.struct(*order)).alias("f"))
    carry = _scanned(wholes, keys, ["slice"]).select(*keys, "slice", F.lag("f").over(W.partitionBy(*keys).orderBy("slice")).alias("c"))
    f, c = F.col("f"), F.col("c")
    start = F.when(c.isNull(), F.lit(0)).otherwise(F.greatest(c["low"], F.least(c["high"], c["add"])))
    value = F.greatest(f["low"], F.least(f["high"], start + f["add"]))
    return inner.join(carry, [*keys, "slice"]).select(*inner.columns, value.alias("x"))


def worked_series(observations: DataFrame, size: int = CHUNK) -> DataFrame:
    """Observations (with a `limit` column) gathered and folded, one row each.

    Deltas of a namespace and metric are gathered until they reach 1/500 of the limit (at least
    1); `shown` tells whether the row is a point of the series. A pending sum is released before a
    report, dated at its last delta, and at the end of the series. `used` is the value shown after
    the row and `tracked` the sum of deltas so far; sums are the same wherever they are cut.
    """
    worked = cut(_worked(observations, reported_caps(observations), size))
    flagged = running(
        worked.withColumns(
            {"b_ts": -F.col("ts_ns"), "b_rank": -F.col("rank"), "b_idx": -F.col("event_index"), "b_slice": -F.col("slice")}
        ),
        NS,
        ["b_ts", "b_rank", "b_idx"],
        [F.col("b_slice")],
        {"next_kind": ("last", F.col("kind"))},
        inclusive=False,
    )
    # Before a report and at the end of the series, what is pending shows.
    flushed = F.coalesce(F.col("next_kind") != "delta", F.lit(True)) & (F.col("pending") != 0)
    shown = (F.col("kind") != "delta") | F.col("released") | flushed
    return flagged.select(
        *NS, *ORDER, "slice", "kind", "value", shown.alias("shown"), "used", "tracked", "saw_delta"
    )


def coalesce_deltas(observations: DataFrame, size: int = CHUNK) -> DataFrame:
    return worked_series(observations, size).select(*NS, *ORDER, "kind", "value", "shown")


def fold_limits(observations: DataFrame, size: int = CHUNK) -> DataFrame:
    return worked_series(observations, size).select(*NS, *ORDER, "used", "tracked", "saw_delta")


def limit_series(
    observations: DataFrame,
    limits: DataFrame | None = None,
    defaults: Mapping[str, int] = DEFAULT_LIMITS,
    size: int = CHUNK,
) -> DataFrame:
    """One row per point in time and metric seen so far: used, limit, and tracked when below used.

    Each namespace holds its last shown value. A point changes the sum over namespaces by its own
    change, so the sums are running sums of changes and no namespace is repeated per point.
    """
    limited = with_limit(observations, limits, defaults).filter(F.col("limit") > 0)
    folded = cut(worked_series(limited, size).filter("shown"))
    before = running(
        folded, NS, ORDER, [F.col("slice")], {"prev": ("last", F.struct("used", "tracked", "saw_delta"))}, inclusive=False
    )
    seen = F.coalesce("saw_delta", F.lit(False))
    counted = F.when(seen, F.col("tracked")).otherwise(F.col("used"))
    prev_counted = F.when(F.coalesce("prev.saw_delta", F.lit(False)), F.col("prev.tracked")).otherwise(
        F.coalesce("prev.used", F.lit(0))
    )
    changes = cut(
        before.select(
            "log_id", "metric", "ts_ns", "slice",
            (F.col("used") - F.coalesce("prev.used", F.lit(0))).alias("d_used"),
            (counted - prev_counted).alias("d_tracked"),
            seen.cast("int").alias("delta_seen"),
        )
        .groupBy("log_id", "metric", "ts_ns", "slice")
        .agg(F.sum("d_used").alias("d_used"), F.sum("d_tracked").alias("d_tracked"), F.max("delta_seen").alias("delta_seen"))
    )
    # A point shows every metric seen so far: at most 13 rows per point in time.
    instants = changes.select("log_id", "ts_ns", "slice").distinct()
    names = changes.groupBy("log_id", "metric").agg(F.min("ts_ns").alias("since"), F.min("slice").alias("since_slice"))
    per_slice = (
        instants.select("log_id", "slice").distinct().join(names, "log_id")
        .filter(F.col("since_slice") <= F.col("slice")).drop("since_slice")
    )
    grid = instants.join(per_slice, ["log_id", "slice"]).filter(F.col("ts_ns") >= F.col("since")).drop("since")
    dense = grid.join(changes, ["log_id", "metric", "ts_ns", "slice"], "left")
    summed = running(
        cut(dense),
        ["log_id", "metric"],
        ["ts_ns"],
        [F.col("slice")],
        {
            "used": ("sum", F.col("d_used")),
            "tracked_sum": ("sum", F.col("d_tracked")),
            "any_delta": ("max", F.col("delta_seen")),
        },
    )
    limited_points = with_limit(summed.drop("d_used", "d_tracked", "delta_seen"), limits, defaults)
    below = (F.col("any_delta") == 1) & (F.col("tracked_sum") < F.col("used"))
    return limited_points.select(
        "log_id", "ts_ns", "metric", "used", "limit", F.when(below, F.col("tracked_sum")).alias("tracked")
    )


# ---- views of the series -----------------------------------------------------------------------


def limit_totals(series: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Peak per metric with the limit of the last point, and whether the log reported limits."""
    totals = series.groupBy("log_id", "metric").agg(
        F.greatest(F.max("used"), F.lit(0)).alias("used"), F.max_by("limit", "ts_ns").alias("limit")
    )
    if snapshots is None:
        return totals.withColumn("has_limits", F.lit(False))
    reported = snapshots.groupBy("log_id").agg(F.lit(True).alias("__r"))
    return totals.join(reported, "log_id", "left").withColumn(
        "has_limits", F.coalesce("__r", F.lit(False))
    ).drop("__r")


def _metric_order() -> Column:
    pairs = [F.lit(x) for i, k in enumerate(DEFAULT_LIMITS) for x in (k, i)]
    return F.try_element_at(F.create_map(*pairs), F.col("metric"))


def ranked_limits(totals: DataFrame, k: int = 6) -> DataFrame:
    """Top k used metrics by share of the limit; ties in metric order. 13 rows per log at most."""
    used = totals.filter((F.col("limit") > 0) & (F.col("used") > 0)).withColumn(
        "ratio", F.col("used") / F.col("limit") * 100
    )
    order = W.partitionBy("log_id").orderBy(F.desc("ratio"), _metric_order())
    return used.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def limit_trends(series: DataFrame, totals: DataFrame, k: int = 4) -> DataFrame:
    """Points of the top k metrics with a zero anchor at the start."""
    top = ranked_limits(totals, k).select("log_id", "metric", "rank")
    points = series.join(top, ["log_id", "metric"]).select(
        "log_id", "metric", "rank", "ts_ns", "used", (F.col("used") / F.col("limit") * 100).alias("ratio")
    )
    anchors = top.select(
        "log_id", "metric", "rank", F.lit(0).cast("long").alias("ts_ns"), F.lit(0).cast("long").alias("used"),
        F.lit(0.0).alias("ratio"),
    )
    return anchors.unionByName(points)


def _with_probes(points: DataFrame, probes: DataFrame, keys: list[str], slice_ns: int) -> DataFrame:
    """Points and probes in one time order; a point at the probe's time comes first."""
    p = points.withColumn("is_probe", F.lit(0))
    q = probes.withColumn("is_probe", F.lit(1))
    return p.unionByName(q, allowMissingColumns=True).withColumn("slice", F.expr(f"ts_ns div {slice_ns}"))


def limit_at(trends: DataFrame, probes: DataFrame, slice_ns: int = SECOND) -> DataFrame:
    """Value of each trend at the probes (log_id, metric, ts_ns): linear between points, the last
    value after the end."""
    keys = ["log_id", "metric"]
    both = cut(_with_probes(trends.select(*keys, "ts_ns", "used", "ratio"), probes.select(*keys, "ts_ns"), keys, slice_ns))
    point = F.when(F.col("is_probe") == 0, F.struct("ts_ns", "used", "ratio"))
    # The point before is strictly earlier; the point after may be at the probe's own time.
    order = both.withColumns({"after_points": 1 - F.col("is_probe"), "b_ts": -F.col("ts_ns"), "b_slice": -F.col("slice")})
    left = cut(running(order, keys, ["ts_ns", "after_points"], [F.col("slice")], {"prev": ("last", point)}))
    full = running(
        left.filter(F.lit(True)), keys, ["b_ts", "is_probe"], [F.col("b_slice")], {"next": ("last", point)}
    ).filter(F.col("is_probe") == 1)
    span = F.col("next.ts_ns") - F.col("prev.ts_ns")
    share = F.when(span > 0, (F.col("ts_ns") - F.col("prev.ts_ns")) / span).otherwise(1.0)

    def between(name: str) -> Column:
        line = F.col(f"prev.{name}") + share * (F.col(f"next.{name}") - F.col(f"prev.{name}"))
        return F.when(F.col("next").isNull(), F.col(f"prev.{name}")).when(F.col("prev").isNull(), F.col(f"next.{name}")).otherwise(line)

    return full.select(*keys, "ts_ns", between("used").cast("double").alias("used"), between("ratio").cast("double").alias("ratio"))


def limit_step_at(series: DataFrame, probes: DataFrame, slice_ns: int = SECOND) -> DataFrame:
    """Last point at or before each probe (log_id, metric, ts_ns), null before the first."""
    keys = ["log_id", "metric"]
    both = cut(_with_probes(series.select(*keys, "ts_ns", "used", "limit"), probes.select(*keys, "ts_ns"), keys, slice_ns))
    point = F.when(F.col("is_probe") == 0, F.struct(F.col("ts_ns").alias("at"), "used", "limit"))
    out = running(both, keys, ["ts_ns", "is_probe"], [F.col("slice")], {"p": ("last", point)})
    return out.filter(F.col("is_probe") == 1).select(
        *keys, "ts_ns", F.col("p.at").alias("point_ns"), F.col("p.used").alias("used"), F.col("p.limit").alias("limit")
    )


def limit_tiers(series: DataFrame) -> DataFrame:
    """Tier of all 13 metrics per log: the top three by peak share are 1; 80 % and more 2; else 3."""
    peaks = series.filter(F.col("limit") > 0).groupBy("log_id", "metric").agg(
        F.greatest(F.max(F.col("used") / F.col("limit")), F.lit(0.0)).alias("peak")
    )
    logs = series.select("log_id").distinct()
    every = logs.select("log_id", F.explode(F.array(*[F.lit(m) for m in DEFAULT_LIMITS])).alias("metric"))
    ranked = every.join(peaks, ["log_id", "metric"], "left").withColumn("peak", F.coalesce("peak", F.lit(0.0)))
    order = W.partitionBy("log_id").orderBy(F.desc("peak"), _metric_order())
    rank = F.row_number().over(order)
    return ranked.withColumn("rank", rank).withColumn(
        "tier", F.when(F.col("rank") <= 3, 1).when(F.col("peak") >= 0.8, 2).otherwise(3)
    )


def limit_points(series: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per point in time: the highest share, and the highest share among tier 3 metrics."""
    share = F.col("used") / F.col("limit")
    joined = series.filter(F.col("limit") > 0).join(tiers.select("log_id", "metric", "tier"), ["log_id", "metric"])
    return joined.groupBy("log_id", "ts_ns").agg(
        F.max(share).alias("max_share"),
        F.greatest(F.coalesce(F.max(F.when(F.col("tier") == 3, share)), F.lit(0.0)), F.lit(0.0)).alias("tier3_max"),
    )


def limit_band(percent: Column) -> Column:
    return F.when(percent >= 100, "danger").when(percent >= 80, "warn").otherwise("safe")
