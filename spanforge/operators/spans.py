"""Events to spans: the tree, its times and its counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.operators import stack
from spanforge.operators.rollup import direct_child_sums, rollup
from spanforge.operators.scan import running, slice_of
from spanforge.operators.tree import chain_of
from spanforge.schema import CHUNK, KEY
from spanforge.session import cut, scratch

PACKAGE = "ENTERING_MANAGED_PKG"
FLOW_ELEMENTS = ["FLOW_ELEMENT_BEGIN", "FLOW_BULK_ELEMENT_BEGIN"]
FLOW_REPORTS = ["FLOW_ELEMENT_LIMIT_USAGE", "FLOW_BULK_ELEMENT_LIMIT_USAGE"]

# Limit metric a flow element reports -> counter it adds to.
FLOW_COUNTERS = {
    "soqlQueries": "soql_count",
    "queryRows": "soql_rows",
    "soslQueries": "sosl_count",
    "dmlStatements": "dml_count",
    "dmlRows": "dml_rows",
}


def _sliced(rows: DataFrame, marks: DataFrame | None, size: int) -> DataFrame:
    """`rows` (events) with their slice number; see stack.run_slices.

    Even numbers are slices of the event index. Behind a log's first size marker slices begin at an event
    that is no exit and later than all events before it; their numbers are odd.
    """
    plain = rows.withColumn("slice", slice_of("event_index", size) * 2)
    none = [F.lit(False).alias("past"), F.lit(False).alias("strict"), F.lit(None).cast("long").alias("floor")]
    if marks is None:
        return plain.select("*", *none)
    first = marks.groupBy("log_id").agg(F.min("event_index").alias("__first"))
    # Slices from the one with a log's first marker on: none in nearly every log.
    touched = plain.select("log_id", "slice").distinct().join(first, "log_id")
    touched = touched.filter(F.col("slice") >= slice_of("__first", size) * 2)
    marked = plain.join(touched, ["log_id", "slice"], "left")
    before = marked.filter(F.col("__first").isNull()).drop("__first").select("*", *none)
    # The time before the marker: one row per slice.
    earlier = (
        plain.join(first, "log_id", "left_semi").groupBy("log_id", "slice").agg(F.max("ts_ns").alias("top"))
        .select("log_id", "slice", F.max("top").over(W.partitionBy("log_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)).alias("top"))
    )
    late = running(
        cut(marked.filter(F.col("__first").isNotNull())), ["log_id"], ["event_index"], [F.col("slice")], {"seen": ("max", F.col("ts_ns"))}, inclusive=False
    ).join(earlier, ["log_id", "slice"], "left")
    late = late.withColumn("floor", F.greatest("seen", "top")).withColumn("strict", F.coalesce(F.col("ts_ns") > F.col("floor"), F.lit(True)))
    start = F.col("strict") & ~F.col("true_exit") & (F.col("event_index") > F.col("__first"))
    begins = late.filter(start).groupBy("log_id", "slice").agg(F.min("event_index").alias("event_index"), F.lit(True).alias("begins"))
    late = cut(late.join(begins.drop("slice"), KEY, "left"))
    placed = running(
        late, ["log_id"], ["event_index"], [F.col("slice")],
        {"own": ("last", F.when(F.col("begins"), F.col("slice") + 1)), "low": ("last", F.when(F.col("begins"), F.col("floor")))},
    )
    past = F.col("own").isNull() & (F.col("slice") > slice_of("__first", size) * 2)
    after = placed.select(*rows.columns, F.coalesce("own", "slice").alias("slice"), past.alias("past"), "strict", F.col("low").alias("floor"))
    return before.unionByName(after)


_OPS = ["slice", "seq", "variant", "event_index", "op"]


def _groups(ops: DataFrame, most: int) -> DataFrame:
    """For each slice the group of neighbouring slices that it goes into: about `most` operations together."""
    timed = F.col("slice") % 2
    sizes = ops.groupBy("log_id", "slice").agg(F.count("*").alias("n")).withColumn("timed", timed)
    before = F.sum("n").over(W.partitionBy("log_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    dealt = sizes.withColumn("bin", F.floor(F.coalesce(before, F.lit(0)) / most))
    return dealt.select("log_id", "slice", F.min("slice").over(W.partitionBy("log_id", "timed", "bin")).alias("group"))


def _most_of_a_log(ops: DataFrame) -> int:
    return ops.groupBy("log_id").count().agg(F.max("count")).first()[0] or 0


def _settled(rows: DataFrame, anchors: DataFrame | None, choice: DataFrame | None) -> DataFrame:
    """The rows of a level that hold, with the outer path and namespace of their anchor."""
    if choice is not None:
        sure = rows.filter(F.col("variant") == "")
        either = rows.filter(F.col("variant") != "").join(choice, ["log_id", "slice"]).filter(F.startswith("chosen_here", "variant"))
        rows = sure.unionByName(either.drop("chosen_here"))
    if anchors is None:
        return rows.withColumns({"outer": F.array().cast("array<bigint>"), "outer_ns": F.lit(None).cast("string")})
    return rows.withColumn("anchor", F.coalesce("anchor", F.lit(-1))).join(anchors, ["log_id", "slice", "anchor"], "left")


def pair(
    events: DataFrame, marks: DataFrame, size: int = CHUNK, most: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run the stack over all logs: placed events, closed frames, structure issues.

    `marks` are the size markers (log_id, event_index of the event before them). A task gets the operations
    of one group of slices, about `most`, and at the end those of one log; levels of groups are added while a log
    has more than `most`, as long as a level settles a tenth of them at least.
    """
    most = most or max(2048, size // 8)
    cut_off = not marks.isEmpty()
    true_exit = F.col("is_exit") & (F.size("ends") == 0) & ~F.col("ends_at_next")
    rows = _sliced(events.select(*KEY, "ts_ns", "type", "ends", true_exit.alias("true_exit"), "is_parent", "is_external", "line_number", "own_ns"), marks if cut_off else None, size)
    rows = rows.select(
        "log_id",
        "slice",
        "event_index",
        F.lit(False).alias("mark"),
        "ts_ns",
        "type",
        (F.col("is_parent") & (F.size("ends") == 0)).alias("endless"),
        F.when(F.col("is_external"), -1).otherwise(F.col("line_number")).cast("int").alias("line"),
        F.coalesce("own_ns", F.lit("")).alias("ns"),
        "past",
        "strict",
        "floor",
    )
    ordered = (
        rows.unionByName(rows.select(*KEY, "slice").join(marks, KEY).withColumn("mark", F.lit(True)), allowMissingColumns=True)
        .repartition("log_id", "slice")
        .sortWithinPartitions("log_id", "slice", "event_index", "mark")
        .select("log_id", "slice", "event_index", "mark", "ts_ns", "type", "endless", "line", "ns", "past", "strict", "floor")
    )
    levels = [cut(ordered.mapInArrow(stack.run_slices, stack.OUT_DDL))]
    ops = levels[0].filter(F.col("kind") == "op").select("log_id", *_OPS)
    left = _most_of_a_log(ops)
    while left > most:
        grouped = (
            ops.join(_groups(ops, most), ["log_id", "slice"])
            .select("log_id", "group", *_OPS)
            .repartition("log_id", "group")
            .sortWithinPartitions("log_id", "group", "slice", "seq", "variant")
        )
        level = cut(grouped.mapInArrow(stack.merge_groups, stack.OUT_DDL))
        levels.append(level)
        ops = level.filter(F.col("kind") == "op").select("log_id", *_OPS)
        before, left = left, _most_of_a_log(ops)
        if left > 0.9 * before:
            break
    last = ops.repartition("log_id").sortWithinPartitions("log_id", "slice", "seq", "variant")
    levels.append(cut(last.mapInArrow(stack.replay, stack.OUT_DDL)))

    # From the real stack downwards: which variants hold, and the outer path of every anchor.
    outer = F.coalesce("outer", F.array().cast("array<bigint>"))
    name = F.coalesce(F.when(F.col("ns") != "", F.col("ns")), "outer_ns")
    anchors = choice = None
    settled = []
    for k, level in reversed([*enumerate(levels)]):
        rows = _settled(level.filter(F.col("kind") != "op").drop("op"), anchors, choice)
        settled.append(rows.select("kind", *KEY, F.concat(outer, "path").alias("path"), name.alias("ns"), "ts", "closer", "last", "truncated", "issue"))
        if k:
            inner = [F.col("inner").alias("slice"), F.col("inner_anchor").alias("anchor")]
            anchors = rows.filter(F.col("kind") == "anchor").select("log_id", *inner, F.concat(outer, "path").alias("outer"), name.alias("outer_ns"))
            if cut_off:
                choice = rows.filter(F.col("kind") == "choice").groupBy("log_id", F.col("inner").alias("slice")).agg(F.max("chosen").alias("chosen_here"))
            if len(levels) > 2:
                anchors, choice = cut(anchors), cut(choice) if cut_off else None
    both = settled[0]
    for rows in settled[1:]:
        both = both.unionByName(rows)
    placed = both.filter(F.col("kind") == "event").select(*KEY, "path", F.coalesce("ns", F.lit("")).alias("tree_ns"))
    closed = both.filter(F.col("kind") == "close").select(
        *KEY,
        F.col("ts").alias("exit_ns"),
        F.col("closer").alias("exit_index"),
        F.col("last").alias("close_last"),
        F.col("truncated").alias("is_truncated"),
    )
    issues = both.filter(F.col("kind") == "issue").select(
        *KEY, F.col("ts").alias("start_ns"), F.col("issue").alias("summary"), F.col("closer").alias("position")
    )
    return placed, closed, issues


def _merge_packages(spans: DataFrame, size: int = CHUNK) -> DataFrame:
    """Runs of managed-package spans of one namespace under one parent: which rows go, and the
    exit and duration of those that stay. One row per package span."""
    packages = spans.filter(F.col("in_tree") & (F.col("type") == PACKAGE))
    parents = packages.select("log_id", "parent_index").distinct()
    is_pkg = F.col("type") == PACKAGE
    siblings = cut(
        spans.filter(
            F.col("in_tree") & F.col("is_parent") & (is_pkg | (F.coalesce("exit_ns", F.lit(0)) != 0))
        )
        .join(parents, ["log_id", "parent_index"], "left_semi")
        .select(*KEY, "parent_index", is_pkg.alias("pkg"), "namespace", "ts_ns", "exit_ns")
    )
    by_parent = ["log_id", "parent_index"]
    slices = [slice_of("event_index", size)]
    seen = running(
        siblings,
        by_parent,
        ["event_index"],
        slices,
        {"prev": ("last", F.struct("pkg", "namespace"))},
        inclusive=False,
    )
    merged = F.col("pkg") & F.coalesce("prev.pkg", F.lit(False)) & (F.col("prev.namespace") == F.col("namespace"))
    flagged = cut(seen.withColumn("merged", F.coalesce(merged, F.lit(False))).drop("prev"))
    headed = running(
        flagged,
        by_parent,
        ["event_index"],
        slices,
        {"head": ("last", F.when(F.col("pkg") & ~F.col("merged"), F.col("event_index")))},
    )
    runs = (
        headed.filter("pkg")
        .groupBy("log_id", F.col("head").alias("event_index"))
        .agg(
            F.first("parent_index").alias("parent_index"),
            F.max_by(F.coalesce("exit_ns", "ts_ns"), "event_index").alias("run_exit"),
        )
    )
    around = flagged.groupBy(*by_parent).agg(
        F.max("merged").alias("any_merged"),
        F.max(F.when(~F.col("merged"), F.col("event_index"))).alias("last_start"),
    )
    kept = runs.join(around, by_parent).select(
        *KEY,
        "run_exit",
        F.lit(False).alias("gone"),
        (F.col("any_merged") | (F.col("event_index") < F.col("last_start"))).alias("timed"),
    )
    gone = flagged.filter("merged").select(
        *KEY, F.lit(None).cast("long").alias("run_exit"), F.lit(True).alias("gone"), F.lit(False).alias("timed")
    )
    return kept.unionByName(gone)


_NARROW = [*KEY, "ts_ns", "type", "is_parent", "own_ns", "n_rows", "bytes"]


def structure(events: DataFrame, marks: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """All events with their place in the tree (`in_tree` false for consumed exits and merged
    packages), exits, durations and counter seeds; and the structure issues. Texts stay out."""
    placed, closed, issues = pair(events, marks, size)
    narrow = events.select(*_NARROW)
    exits = events.select(
        "log_id",
        F.col("event_index").alias("exit_index"),
        F.col("type").alias("exit_type"),
        F.when(~F.col("text").endswith(")"), F.col("own_ns")).alias("exit_ns_name"),
        F.col("n_rows").alias("exit_rows"),
    ).filter(F.col("exit_ns_name").isNotNull() | F.col("exit_rows").isNotNull())
    # Only a class reference or a query end tells something about the span it closes.
    from_exit = closed.filter(F.col("exit_index").isNotNull()).select(*KEY, "exit_index").join(
        exits, ["log_id", "exit_index"]
    ).select(*KEY, "exit_type", "exit_ns_name", "exit_rows")
    next_ts = (
        events.filter(F.col("type") == PACKAGE)
        .select("log_id", "event_index", (F.col("event_index") + 1).alias("next_index"))
        .join(
            events.select("log_id", F.col("event_index").alias("next_index"), F.col("ts_ns").alias("next_ts")),
            ["log_id", "next_index"],
        )
        .select(*KEY, "next_ts")
    )
    t = F.col("type")
    inherited = F.when(F.col("tree_ns") != "", F.col("tree_ns")).when(
        F.col("is_parent") | (F.size("path") > 0), "default"
    )
    own_exit_ns = F.when((t == "METHOD_ENTRY") & (F.col("exit_ns_name") != ""), F.col("exit_ns_name"))
    joined = (
        narrow.join(placed, KEY, "left")
        .join(closed, KEY, "left")
        .join(from_exit, KEY, "left")
        .join(next_ts, KEY, "left")
    )
    in_tree = F.col("path").isNotNull()
    heap = F.when(t.isin("HEAP_ALLOCATE", "BULK_HEAP_ALLOCATE"), F.col("bytes"))
    count = lambda cond: F.when(in_tree & cond, 1).otherwise(0).cast("long")
    based = cut(
        joined.select(
            *KEY,
            "ts_ns",
            "type",
            "is_parent",
            in_tree.alias("in_tree"),
            F.coalesce("path", F.array().cast("array<bigint>")).alias("path"),
            F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(0)).alias("parent_index"),
            F.coalesce(F.size("path"), F.lit(0)).alias("depth"),
            F.coalesce("close_last", "event_index").alias("last_index"),
            F.coalesce(own_exit_ns, inherited, F.lit("")).alias("namespace"),
            F.coalesce("exit_ns", "next_ts").alias("exit_ns"),
            "exit_index",
            F.coalesce("is_truncated", F.lit(False)).alias("is_truncated"),
            count(t == "DML_BEGIN").alias("dml_count_self"),
            count(t == "SOQL_EXECUTE_BEGIN").alias("soql_count_self"),
            count(t == "SOSL_EXECUTE_BEGIN").alias("sosl_count_self"),
            F.when(t == "DML_BEGIN", F.col("n_rows")).otherwise(0).cast("long").alias("dml_rows_self"),
            F.when(in_tree, _read_rows("SOQL")).otherwise(0).cast("long").alias("soql_rows_self"),
            F.when(in_tree, _read_rows("SOSL")).otherwise(0).cast("long").alias("sosl_rows_self"),
            count(t == "EXCEPTION_THROWN").alias("thrown_self"),
            F.coalesce(heap, F.lit(0)).alias("heap_net_self"),
            F.greatest(F.coalesce(heap, F.lit(0)), F.lit(0)).alias("heap_gross_self"),
        )
    )
    end = F.col("exit_ns")
    total = F.when(F.col("is_parent") & (F.coalesce(end, F.lit(0)) != 0), end - F.col("ts_ns")).otherwise(0)
    others = based.filter(t != PACKAGE).withColumn("dur_total", total.cast("long"))
    # Package spans are rare and the only ones that can merge; the rest is not joined.
    run_end = F.coalesce("run_exit", "exit_ns")
    run_total = F.when(F.col("timed") & (F.coalesce(run_end, F.lit(0)) != 0), run_end - F.col("ts_ns")).otherwise(0)
    packages = (
        based.filter(t == PACKAGE)
        .join(_merge_packages(based, size), KEY, "left")
        .withColumns(
            {
                "in_tree": F.col("in_tree") & ~F.coalesce("gone", F.lit(False)),
                "dur_total": run_total.cast("long"),
                "exit_ns": run_end,
            }
        )
        .drop("run_exit", "gone", "timed")
    )
    return others.unionByName(packages), issues


def _read_rows(kind: str) -> Column:
    t = F.col("type")
    end = f"{kind}_EXECUTE_END"
    closing = F.when(F.col("exit_type") == end, F.col("exit_rows"))
    # An end that pairs with nothing stays in the tree with its own rows.
    own = F.when(t == end, F.col("n_rows"))
    return F.coalesce(F.when(t == f"{kind}_EXECUTE_BEGIN", closing), own, F.lit(0)).cast("long")


def build_spans(events: DataFrame, marks: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Spans with totals (flow residuals included), and the structure issues.

    Tree and counters are worked on a table without texts; those join in once at the end.
    """
    with scratch(events.sparkSession) as keep:
        tree, issues = structure(events, marks, size)
        issues = keep(issues)
        tree = cut(tree.filter("in_tree").drop("in_tree"))
        child = direct_child_sums(tree.filter(F.col("dur_total") != 0), {"__child_time": F.col("dur_total")})
        rolled = (
            rollup(tree, size=size)
            .join(child, KEY, "left")
            .withColumn("dur_self", F.col("dur_total") - F.coalesce("__child_time", F.lit(0)))
            .drop("__child_time", "ts_ns", "type", "is_parent")
        )
        texts = events.drop("n_rows", "own_ns", "line")
        spans = keep(rolled.join(texts, KEY))
        named = flow_names(flow_residuals(spans, size), size)
        return spans if named is spans else keep(named), issues


def flow_names(spans: DataFrame, size: int = CHUNK) -> DataFrame:
    """Kind and name of flow starts, from the nearest code unit or flow above and the first child.

    Flow starts are rare, so only they are joined; a table without any comes back as it is.
    """
    is_flow = (F.col("type") == "FLOW_START_INTERVIEWS_BEGIN") & F.col("exit_index").isNotNull()
    flows = spans.filter(is_flow)
    if flows.isEmpty():
        return spans
    linked = chain_of(
        flows.select(*KEY, "path"), spans, {"a_type": F.col("type"), "a_unit": F.col("unit_type")}, size
    )
    near = F.try_element_at(
        F.filter("chain", lambda a: a["a_type"].isin("CODE_UNIT_STARTED", "FLOW_START_INTERVIEWS_BEGIN")), F.lit(-1)
    )
    kind = (
        F.when(near.getField("a_type") == "FLOW_START_INTERVIEWS_BEGIN", "Flow")
        .when(near.getField("a_unit") == "Flow", "Flow")
        .when(near.getField("a_type") == "CODE_UNIT_STARTED", "Process Builder")
        .otherwise("")
    )
    # The first child is the next event of the log, when it is a child at all.
    first = spans.filter(F.col("event_index") == F.col("parent_index") + 1).select(
        "log_id", F.col("parent_index").alias("event_index"), F.col("text").alias("child_text")
    )
    named = linked.select(*KEY, kind.alias("flow_kind")).join(first, KEY, "left")
    renamed = (
        flows.join(named, KEY, "left")
        .withColumns(
            {
                "text": F.when(F.col("flow_kind").isNotNull(), F.concat("text", F.coalesce("child_text", F.lit("")))).otherwise(F.col("text")),
                "suffix": F.when(F.col("flow_kind").isNotNull(), F.concat(F.lit(" ("), "flow_kind", F.lit(")"))).otherwise(F.col("suffix")),
            }
        )
        .drop("flow_kind", "child_text")
    )
    return spans.filter(~F.coalesce(is_flow, F.lit(False))).unionByName(renamed)


def flow_residuals(spans: DataFrame, size: int = CHUNK) -> DataFrame:
    """Add what flow elements report beyond the statements logged below them.

    An element's residual is its reported rise minus its subtree total, nested residuals included,
    never negative. Nesting levels of elements are worked innermost first; each level is one
    grouped sum, and the number of levels is the nesting of flows, a handful.
    """
    reports = (
        spans.filter(F.col("type").isin(FLOW_REPORTS) & F.col("limit_obs.metric").isin(list(FLOW_COUNTERS)))
        .groupBy("log_id", F.col("parent_index").alias("event_index"), F.col("limit_obs.metric").alias("metric"))
        .agg(
            F.sum("limit_obs.delta").alias("summed"),
            F.min_by(F.col("limit_obs.used") - F.col("limit_obs.delta"), "event_index").alias("before"),
            F.max_by("limit_obs.used", "event_index").alias("after"),
        )
    )
    elements = spans.filter(F.col("type").isin(FLOW_ELEMENTS))
    total = F.coalesce(
        *[F.when(F.col("metric") == m, F.col(f"{c}_total")) for m, c in FLOW_COUNTERS.items()]
    )
    frames = elements.select(*KEY, "last_index", "path", "type", *[f"{c}_total" for c in FLOW_COUNTERS.values()])
    nested = chain_of(frames, elements, {"a_type": F.col("type")}, size)
    rise = F.least("summed", F.col("after") - F.col("before"))
    # Every element stands for itself per metric; those without a report only pass residuals on.
    work = nested.join(reports, KEY).select(
        *KEY, "metric", (rise - total).alias("own"), F.col("path")
    )
    level = nested.select(*KEY, F.size("chain").alias("level"), F.col("chain.index").alias("above"))
    work = cut(work.join(level, KEY))
    top = work.agg(F.max("level")).first()[0]
    if top is None:
        return spans
    done = None
    for k in range(top, -1, -1):
        here = work.filter(F.col("level") == k)
        if done is not None:
            inner = (
                done.select("log_id", "metric", "residual", F.explode("above").alias("event_index"))
                .groupBy("log_id", "metric", "event_index")
                .agg(F.sum("residual").alias("inner"))
            )
            here = here.join(inner, ["log_id", "metric", "event_index"], "left").withColumn(
                "own", F.col("own") - F.coalesce("inner", F.lit(0))
            ).drop("inner")
        found = here.withColumn("residual", F.greatest("own", F.lit(0))).filter(F.col("residual") > 0)
        done = found if done is None else done.unionByName(found)
        done = cut(done)
    own = _spread(done.select(*KEY, "metric", "residual"), "self")
    every = done.select("log_id", "metric", "residual", F.explode(F.concat("path", F.array("event_index"))).alias("event_index"))
    out = spans.join(own, KEY, "left").join(_spread(every, "total"), KEY, "left")
    fixes = {
        f"{c}_{p}": F.col(f"{c}_{p}") + F.coalesce(f"__{c}_{p}", F.lit(0))
        for c in FLOW_COUNTERS.values()
        for p in ("self", "total")
    }
    return out.withColumns(fixes).drop(*[f"__{n}" for n in fixes])


def _spread(rows: DataFrame, part: str) -> DataFrame:
    return rows.groupBy(*KEY).agg(
        *[
            F.sum(F.when(F.col("metric") == m, F.col("residual"))).alias(f"__{c}_{part}")
            for m, c in FLOW_COUNTERS.items()
        ]
    )
