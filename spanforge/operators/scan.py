"""Running aggregates over an ordered log that never put a whole log into one task.

`Window.partitionBy("log_id").orderBy(...)` sorts a log inside a single task. One log may hold a
third of all rows, so every ordered operator here works on *chunks*: consecutive slices of the
order, small enough for a task. A running value is the value inside the chunk combined with a
carry from the chunks before it, and the carry is a window over one row per chunk. When even
the chunk rows of a log are many, coarser slices can be stacked: `chunks=[fine, coarse, ...]`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.schema import CHUNK

Spec = tuple[str, Column]


def slice_of(index: str = "event_index", size: int = CHUNK) -> Column:
    """Slice number of a dense index (integer division, so exact at any size)."""
    return F.expr(f"`{index}` div {size}")


def _local(fn: str, expr: Column, window) -> Column:
    if fn == "last":
        return F.last(expr, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[fn](expr).over(window)


def _slice_total(fn: str, expr: Column, order: Sequence[Column]) -> Column:
    if fn == "last":
        return F.max_by(expr, F.when(expr.isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "max": F.max, "min": F.min}[fn](expr)


def _combine(fn: str, inner: Column, carry: Column) -> Column:
    if fn == "sum":
        return F.coalesce(inner, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if fn == "max":
        return F.greatest(inner, carry)
    if fn == "min":
        return F.least(inner, carry)
    return F.coalesce(inner, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunks: Sequence[Column],
    specs: Mapping[str, Spec],
    inclusive: bool = True,
) -> DataFrame:
    """Add one running column per spec, ordered by `order` inside `keys`.

    specs maps an output name to ("sum" | "max" | "min" | "last", expression); "last" keeps the
    latest non-null value. `chunks` are non-decreasing functions of the order, fine to coarse.
    `inclusive=False` leaves the current row out.
    """
    order_cols = [F.col(c) for c in order]
    depth = len(chunks)
    names = [f"__chunk{depth}_{i}" for i in range(depth)]
    base = df.select("*", *[c.alias(n) for c, n in zip(chunks, names, strict=True)])
    fine = names[0]
    frame = (
        W.partitionBy(*keys, *names)
        .orderBy(*order_cols)
        .rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    )
    inner = base.select(
        "*", *[_local(fn, expr, frame).alias(f"__in_{n}") for n, (fn, expr) in specs.items()]
    )
    totals = base.groupBy(*keys, *names).agg(
        *[_slice_total(fn, expr, order_cols).alias(f"__t_{n}") for n, (fn, expr) in specs.items()]
    )
    upper: dict[str, Spec] = {f"__carry_{n}": (fn, F.col(f"__t_{n}")) for n, (fn, _) in specs.items()}
    if depth == 1:
        over = W.partitionBy(*keys).orderBy(fine).rowsBetween(W.unboundedPreceding, -1)
        carry = totals.select(
            *keys, *names, *[_local(fn, expr, over).alias(n) for n, (fn, expr) in upper.items()]
        )
    else:
        carry = running(
            totals, keys, [fine], [F.col(n) for n in names[1:]], upper, inclusive=False
        ).select(*keys, *names, *upper)
    joined = inner.join(carry, [*keys, *names], "left")
    return joined.select(
        *df.columns,
        *[
            _combine(fn, F.col(f"__in_{n}"), F.col(f"__carry_{n}")).alias(n)
            for n, (fn, _) in specs.items()
        ],
    )


def following(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    specs: Mapping[str, Spec],
    size: int = CHUNK,
) -> DataFrame:
    """`running` from the end of the log, current row left out: ("last", x) becomes the first
    non-null x on a later row of the dense integer `index`."""
    flipped = df.withColumn("__back", -F.col(index))
    out = running(
        flipped,
        keys,
        ["__back"],
        [slice_of("__back", size)],
        specs,
        inclusive=False,
    )
    return out.drop("__back")


def covered_slices(first: str, last: str, size: int = CHUNK) -> Column:
    """The slices an index interval touches; nearly always one or two."""
    return F.explode(
        F.sequence(slice_of(first, size), slice_of(last, size))
    )


def whole(
    df: DataFrame, keys: Sequence[str], chunk: Column, specs: Mapping[str, Spec]
) -> DataFrame:
    """Add group-wide "sum" | "max" | "min" values without bringing a group into one task.

    The group value is joined per slice, so the join has no key with more rows than a slice.
    """
    base = df.withColumn("__slice", chunk)
    totals = base.groupBy(*keys, "__slice").agg(
        *[_slice_total(fn, expr, []).alias(f"__t_{n}") for n, (fn, expr) in specs.items()]
    )
    over = W.partitionBy(*keys)
    values = totals.select(
        *keys, "__slice", *[_local(fn, F.col(f"__t_{n}"), over).alias(n) for n, (fn, _) in specs.items()]
    )
    return base.join(values, [*keys, "__slice"], "left").drop("__slice")
