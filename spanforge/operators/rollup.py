"""Subtree rollups: sums by prefix sums, maxima over index ranges, self figures from direct children."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.scan import covered_slices, running, slice_of
from spanforge.schema import CHUNK, KEY, METRICS
from spanforge.session import cut


def frame_totals(df: DataFrame, seeds: Mapping[str, Column], size: int = CHUNK) -> DataFrame:
    """Per frame, the sum of each seed over the frame and everything below it.

    A subtree is the index interval [event_index, last_index], so its sum is the running sum at
    the end of the interval minus the one before its start. Each frame puts a mark behind its
    last row; rows that are neither frames nor carry a seed stay out. One sort per slice,
    whatever the depth.
    """
    names = list(seeds)
    is_frame = F.col("last_index") > F.col("event_index")
    valued = [F.coalesce(seeds[n], F.lit(0)).cast("long").alias(n) for n in names]
    any_seed = is_frame
    for n in names:
        any_seed = any_seed | (F.coalesce(seeds[n], F.lit(0)) != 0)
    opens = df.filter(any_seed).select(
        "log_id",
        F.col("event_index").alias("at"),
        F.lit(0).alias("end"),
        F.when(is_frame, F.col("event_index")).alias("frame"),
        *valued,
    )
    ends = df.filter(is_frame).select(
        "log_id",
        F.col("last_index").alias("at"),
        F.lit(1).alias("end"),
        F.col("event_index").alias("frame"),
        *[F.lit(0).cast("long").alias(n) for n in names],
    )
    cum = running(
        opens.unionByName(ends),
        ["log_id"],
        ["at", "end"],
        [slice_of("at", size)],
        {f"__cum_{n}": ("sum", F.col(n)) for n in names},
    )
    side = F.when(F.col("end") == 1, 1).otherwise(-1)
    return (
        cum.filter(F.col("frame").isNotNull())
        .groupBy("log_id", F.col("frame").alias("event_index"))
        .agg(*[F.sum(side * F.col(f"__cum_{n}") + F.col(n)).alias(n) for n in names])
    )


def _frames(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with others below them, and the rest: most rows, which need no join for their totals."""
    is_frame = F.coalesce(F.col("last_index") > F.col("event_index"), F.lit(False))
    return df.filter(is_frame), df.filter(~is_frame)


def subtree_sums(df: DataFrame, seeds: Mapping[str, Column], size: int = CHUNK) -> DataFrame:
    """Add the sum of each seed over the row and everything below it."""
    frames, leaves = _frames(df)
    return _frame_sums(df, frames, seeds, size).unionByName(_leaf_sums(leaves, seeds))


def _frame_sums(df: DataFrame, frames: DataFrame, seeds: Mapping[str, Column], size: int) -> DataFrame:
    totals = frame_totals(df, seeds, size)
    named = totals.select(*KEY, *[F.col(n).alias(f"__t_{n}") for n in seeds])
    return frames.join(named, KEY, "left").select(
        *df.columns,
        *[F.coalesce(f"__t_{n}", seed, F.lit(0)).cast("long").alias(n) for n, seed in seeds.items()],
    )


def _leaf_sums(leaves: DataFrame, seeds: Mapping[str, Column]) -> DataFrame:
    return leaves.select("*", *[F.coalesce(seed, F.lit(0)).cast("long").alias(n) for n, seed in seeds.items()])


def live_heap(leaves: DataFrame, bytes_col: str, size: int = CHUNK) -> DataFrame:
    """Add `live`, the heap held after each allocation leaf, in log order, never below 0."""
    summed = running(
        leaves,
        ["log_id"],
        ["event_index"],
        [slice_of("event_index", size)],
        {"__live": ("sum", F.col(bytes_col))},
    )
    return summed.withColumn("live", F.greatest(F.col("__live"), F.lit(0))).drop("__live")


def heap_peaks(df: DataFrame, bytes_col: str = "heap_net_self", size: int = CHUNK) -> DataFrame:
    """Per row, the most live heap seen at it or below it; rows without heap are absent."""
    held = cut(_held(df, bytes_col, size))
    own = held.select("log_id", F.col("at").alias("event_index"), F.col("value").alias("heap_peak"))
    return own.unionByName(_frame_peaks(df, held, size))


def _held(df: DataFrame, bytes_col: str, size: int) -> DataFrame:
    leaves = df.filter(~F.col("is_parent") & (F.col(bytes_col) != 0)).select(*KEY, bytes_col)
    return live_heap(leaves, bytes_col, size).filter(F.col("live") > 0).select("log_id", F.col("event_index").alias("at"), F.col("live").alias("value"))


def _frame_peaks(df: DataFrame, held: DataFrame, size: int) -> DataFrame:
    frames = df.filter(F.col("last_index") > F.col("event_index")).select(*KEY, F.col("event_index").alias("low"), F.col("last_index").alias("high"))
    return range_max(held, frames, size).withColumnRenamed("value", "heap_peak")


def range_max(points: DataFrame, ranges: DataFrame, size: int = CHUNK) -> DataFrame:
    """For each range (log_id, event_index, low, high) the largest `value` of the points (log_id, at, value) in
    it, as (log_id, event_index, value); ranges without a point are absent.

    A range is its part of the first slice, its part of the last one, and the slices between, whose
    maxima are again points. So a range makes three rows at most at each level, whatever it covers, and levels
    shrink by `size`. Within a slice maxima come from a table over spans of 1, 2, 4, ... points.
    """
    sliced = points.withColumn("slice", slice_of("at", size))
    tops = cut(sliced.groupBy("log_id", "slice").agg(F.max("value").alias("value")))
    first, last = slice_of("low", size), slice_of("high", size)
    bounds = ranges.select(*KEY, "low", "high", first.alias("first"), last.alias("last"))
    ends = F.when(F.col("first") == F.col("last"), F.array(F.struct(F.col("first").alias("slice"), "low", "high"))).otherwise(
        F.array(
            F.struct(F.col("first").alias("slice"), "low", F.lit(2**62).alias("high")),
            F.struct(F.col("last").alias("slice"), F.lit(0).cast("long").alias("low"), "high"),
        )
    )
    parts = bounds.select(*KEY, F.explode(ends).alias("p")).select(*KEY, "p.*").join(tops.select("log_id", "slice"), ["log_id", "slice"], "left_semi")
    none = F.lit(None).cast("long")
    rows = sliced.select("log_id", "slice", none.alias("event_index"), F.col("at").alias("low"), none.alias("high"), "value").unionByName(
        parts.withColumn("value", none)
    )
    found = rows.groupBy("log_id", "slice").applyInArrow(_range_maxima, "log_id string, event_index long, value long")
    between = bounds.filter(F.col("last") > F.col("first") + 1)
    if not tops.isEmpty() and not between.isEmpty():
        upper = between.select(*KEY, (F.col("first") + 1).alias("low"), (F.col("last") - 1).alias("high"))
        found = found.unionByName(range_max(tops.withColumnRenamed("slice", "at"), upper, size))
    return found.groupBy(*KEY).agg(F.max("value").alias("value"))


def _range_maxima(table: pa.Table) -> pa.Table:
    """One slice of `range_max`: rows with a value are points, the others ranges."""
    is_point = table["value"].is_valid()
    points, ranges = table.filter(is_point), table.filter(pc.invert(is_point))
    at, value = points["low"].to_numpy(), points["value"].to_numpy()
    order = np.argsort(at, kind="stable")
    at, spans = at[order], [value[order]]
    i, j = np.searchsorted(at, ranges["low"].to_numpy()), np.searchsorted(at, ranges["high"].to_numpy(), side="right")
    out = np.full(len(i), -1, dtype=np.int64)
    left = np.flatnonzero(j > i)
    width = 1
    while len(left):  # the widest spans of 2^k points that fit, from both ends
        now = left[j[left] - i[left] < 2 * width]
        out[now] = np.maximum(spans[-1][i[now]], spans[-1][j[now] - width])
        left = left[j[left] - i[left] >= 2 * width]
        if len(left):
            spans.append(np.maximum(spans[-1][:-width], spans[-1][width:]))
            width *= 2
    hit = pa.array(out >= 0)
    return pa.table({"log_id": ranges["log_id"].filter(hit), "event_index": ranges["event_index"].filter(hit), "value": pa.array(out).filter(hit)})


def direct_child_sums(df: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """Per parent, sums over its direct children."""
    return df.groupBy("log_id", F.col("parent_index").alias("event_index")).agg(
        *[F.sum(expr).alias(n) for n, expr in sums.items()]
    )


def with_durations(df: DataFrame) -> DataFrame:
    """Self time: total minus the totals of the direct children."""
    child = direct_child_sums(
        df.filter(F.col("dur_total") != 0), {"__child_time": F.col("dur_total")}
    )
    return (
        df.join(child, KEY, "left")
        .withColumn("dur_self", F.col("dur_total") - F.coalesce("__child_time", F.lit(0)))
        .drop("__child_time")
    )


def rollup(
    df: DataFrame,
    metrics: Sequence[str] = tuple(METRICS),
    extra: Mapping[str, Column] | None = None,
    size: int = CHUNK,
) -> DataFrame:
    """Totals of every counter, heap self of frames and heap peaks.

    Expects `<metric>_self` seeds, `path` and `last_index`, from a table that is cheap to read
    several times. Heap self of a frame is what its non-frame children allocated directly; the
    other self counters stay on their row. `extra` adds further subtree sums.
    """
    seeds = {f"{m}_total": F.col(f"{m}_self") for m in metrics} | dict(extra or {})
    heap = [m for m in metrics if m.startswith("heap_")]
    frames, leaves = _frames(df)
    holds = F.coalesce(~F.col("is_parent") & (F.col("heap_net_self") != 0), F.lit(False))
    own = direct_child_sums(df.filter(holds), {f"__{m}": F.col(f"{m}_self") for m in heap})
    summed = _frame_sums(df, frames, seeds, size)
    peaks = _frame_peaks(df, cut(_held(df, "heap_net_self", size)), size)
    # Heap behind a frame's end may still name it as parent; that is rare, so the file is small and leaves stay in place.
    stray = cut(own.join(frames.select(*KEY), KEY, "left_anti"))
    # A leaf's peak is the live heap at it, so only frames have to be joined with theirs.
    held = _frames(live_heap(df.filter(holds), "heap_net_self", size))[1]
    at = F.when(F.col("log_id").isNotNull(), F.col("live"))
    parts = [
        summed.join(own, KEY, "left").join(peaks, KEY, "left"),
        _leaf_sums(held.withColumn("heap_peak", at).drop("live"), seeds).join(stray, KEY, "left"),
        _leaf_sums(leaves.filter(~holds), seeds).join(stray, KEY, "left").withColumn("heap_peak", F.lit(0).cast("long")),
    ]
    joined = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return joined.select(
        *[c for c in summed.columns if c not in {f"{m}_self" for m in heap}],
        *[
            F.when(F.col("is_parent"), F.coalesce(f"__{m}", F.lit(0)))
            .otherwise(F.col(f"{m}_self"))
            .cast("long")
            .alias(f"{m}_self")
            for m in heap
        ],
        F.coalesce("heap_peak", F.lit(0)).alias("heap_peak"),
    )


def lookup(
    df: DataFrame, index_col: str, spans: DataFrame, cols: Mapping[str, Column], size: int = CHUNK
) -> DataFrame:
    """Attach columns of the enclosing span named by `index_col` (an ancestor of the row).

    A top frame may enclose a third of all rows, so the key also holds the slice of the row; an
    ancestor is repeated once per slice it covers, which bounds the rows behind any one key.
    """
    side = spans.filter(F.col("last_index") > F.col("event_index")).select(
        "log_id",
        F.col("event_index").alias(index_col),
        covered_slices("event_index", "last_index", size).alias("__slice"),
        *[c.alias(n) for n, c in cols.items()],
    )
    return (
        df.withColumn("__slice", slice_of("event_index", size))
        .join(side, ["log_id", index_col, "__slice"], "left")
        .drop("__slice")
    )
