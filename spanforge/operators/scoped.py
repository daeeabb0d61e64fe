"""Call trees around a selection, as path-keyed tables.

The rows of a scoped tree are the selected subtrees and, for each selection, its ancestors, which
carry the selection's total and no self time. `root` names the selection a row belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.tree import chain_of, contains, covered, frame_paths, with_paths
from spanforge.operators.trees import EXCLUDED_DETAIL_TYPES
from spanforge.schema import KEY
from spanforge.session import cut


def _kept() -> Column:
    return (F.col("dur_total") > 0) | F.col("type").isin(EXCLUDED_DETAIL_TYPES)


def _key(prefix: str = "") -> Column:
    # The key of the scoped views is the frame's type, namespace and text as well.
    return F.concat_ws("|", F.coalesce(f"{prefix}type", F.lit("")), f"{prefix}namespace", f"{prefix}text")


def whole_tree(spans: DataFrame) -> DataFrame:
    """The log's tree without timeless details; top-level rows always stay."""
    shown = contains(spans, _kept(), "__kept")
    return shown.filter(F.col("__kept") | (F.col("depth") == 0)).drop("__kept")


_ROW = [*KEY, "root", "depth", "type", "namespace", "text", "dur_total", "dur_self", "ancestor"]


def scoped_tree(spans: DataFrame, selected: Column) -> DataFrame:
    """Rows of the selected subtrees (`ancestor` false) and of the ancestors of each selection.

    A row below two selections appears once for each, as the selections do.
    """
    return _scoped(spans, selected)[0].select(*_ROW)


def _scoped(spans: DataFrame, selected: Column) -> tuple[DataFrame, DataFrame]:
    """The scoped rows with their event key and the id of the path above them, and the names of the paths."""
    columns = ["depth", "type", "namespace", "text", "dur_total", "dur_self"]
    # Two sorts of all rows follow, so only what is used moves.
    spans = spans.select(*KEY, "parent_index", "last_index", "path", *columns, selected.alias("__selected"))
    selected = F.col("__selected")
    inside = covered(spans, selected, "__in").filter("__in").drop("__in")
    shown = contains(cut(inside), _kept(), "__kept").filter(F.col("__kept") | selected).drop("__kept")
    own = F.when(selected, F.array("event_index")).otherwise(F.array().cast("array<bigint>"))
    # Which selections a row is below: itself or an ancestor.
    picked = {"picked": F.coalesce(selected, F.lit(False))}
    roots = lambda chain: {"roots": F.transform(F.filter(chain, lambda a: a["picked"]), lambda a: a["index"])}
    frames = frame_paths(spans, picked, roots)
    narrow = shown.select(*KEY, "parent_index", "last_index", "path", *columns, own.alias("own"))
    placed, names = with_paths(narrow, spans, frames, picked, roots)
    rows = (
        placed.filter(F.col("log_id").isNotNull())
        .withColumn("root", F.explode(F.concat("roots", "own")))
        .select(*KEY, "root", *columns, F.lit(False).alias("ancestor"), _key().alias("key"), "pa", "pb")
    )
    fields = {n: F.col(n) for n in ("type", "namespace", "text")} | {n: F.col(f"own.{n}") for n in ("pa", "pb")}
    lead = chain_of(spans.filter(selected).select(*KEY, "path", "dur_total"), frames, fields)
    ancestors = lead.select(
        "log_id", F.col("event_index").alias("root"), F.col("dur_total").alias("t"), F.explode("chain").alias("f")
    ).select(
        "log_id", F.col("f.index").alias("event_index"), "root", F.col("f.at").alias("depth"),
        F.col("f.type").alias("type"), F.col("f.namespace").alias("namespace"), F.col("f.text").alias("text"),
        F.col("t").alias("dur_total"), F.lit(0).cast("long").alias("dur_self"), F.lit(True).alias("ancestor"),
        _key("f.").alias("key"), "f.pa", "f.pb",
    )
    return rows.unionByName(ancestors), names


_PATH = ["log_id", "pa", "pb"]


def scoped_top_down(spans: DataFrame, selected: Column) -> DataFrame:
    """Scoped rows merged by key path with plain sums (no recursion guard)."""
    rows, names = _scoped(spans, selected)
    merged = rows.groupBy(*_PATH, "key").agg(
        F.sum("dur_total").alias("dur_total"), F.sum("dur_self").alias("dur_self"), F.count("*").alias("calls")
    )
    path = F.concat("above", F.array("key")).alias("key_path")
    return merged.join(names, _PATH).select("log_id", path, "dur_total", "dur_self", "calls")


def scoped_bottom_up(spans: DataFrame, selected: Column) -> DataFrame:
    """Rows with self time as seeds, their callers below; every level carries the seed's self."""
    rows, names = _scoped(spans, selected)
    merged = rows.filter(F.col("dur_self") > 0).groupBy(*_PATH, "key").agg(F.sum("dur_self").alias("t"), F.count("*").alias("n"))
    stacks = merged.join(names, _PATH).withColumn("full", F.concat(F.array("key"), F.reverse("above")))
    levels = stacks.withColumn("n_levels", F.explode(F.sequence(F.lit(1), F.size("full"))))
    out = levels.groupBy("log_id", F.slice("full", F.lit(1), F.col("n_levels")).alias("caller_path")).agg(
        F.sum("t").alias("dur_total"), F.sum("n").alias("calls")
    )
    seed = F.size("caller_path") == 1
    return out.withColumn("dur_self", F.when(seed, F.col("dur_total")).otherwise(0))


def row_occurrences(spans: DataFrame, selected: Column) -> DataFrame:
    """Which events stand behind each merged row: (key_path, event_index), distinct."""
    rows, names = _scoped(spans, selected)
    path = F.concat("above", F.array("key")).alias("key_path")
    return rows.select(*KEY, "pa", "pb", "key").distinct().join(names, _PATH).select("log_id", path, "event_index")


def rows_by_event(occurrences: DataFrame) -> DataFrame:
    """The merged rows of each event, from row_occurrences; an event is in few rows."""
    return occurrences.groupBy("log_id", "event_index").agg(
        F.sort_array(F.collect_list(F.array_join("key_path", " > "))).alias("rows")
    )
