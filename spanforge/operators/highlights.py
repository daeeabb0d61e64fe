"""Execution highlights: hot path, hot spots, truncation, self-time spread, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.operators.rollup import lookup
from spanforge.operators.scan import running, slice_of
from spanforge.operators.tree import event_key, with_chain
from spanforge.operators.views import top_k
from spanforge.schema import CHUNK
from spanforge.session import cut

FOLLOW_SHARE = 0.4
SELF_DOMINANT_SHARE = 0.5
BRANCH_SHARE = 0.05
HOT_SPOTS = 5
LANES = 5
SINGLES = 3
BINS = 24
MIN_BIN_PERCENT = 10


LEVELS = 8  # steps that are taken one by one


def _path_id(*own: Column) -> Column:
    """128 bits that stand for a path: a hash of the two hashes of every key from the top down to `own`."""
    more = [F.array(c) for c in own] or [F.array().cast("array<bigint>")] * 2
    return F.struct(*[F.xxhash64(F.concat(f"chain.{n}", m)).alias(n) for n, m in zip("ab", more, strict=True)])


def _walk(edges: DataFrame) -> DataFrame:
    """(log_id, id, step): the nodes on the way down from the top of every log, one edge a parent.

    The first steps are taken one by one from a front of one node a log. Where a log goes on, the steps known are
    then doubled in each round, by edges that jump 1, 2, 4, ... steps.
    """
    below = edges.filter("NOT top").select("log_id", F.col("parent").alias("id"), F.col("id").alias("to"))
    front = cut(edges.filter("top").select("log_id", "id", F.lit(1).alias("step")))
    found, step = front, 1
    while step < LEVELS and not front.isEmpty():
        front = cut(front.join(below, ["log_id", "id"]).select("log_id", F.col("to").alias("id"), (F.col("step") + 1).alias("step")))
        found, step = found.unionByName(front), step + 1
    jump, n = below, 1
    while not front.isEmpty():
        tail = found.filter(F.col("step") > step - n)
        front = cut(tail.join(jump, ["log_id", "id"]).select("log_id", F.col("to").alias("id"), (F.col("step") + n).alias("step")))
        found, step = cut(found.unionByName(front)), step + n
        onward = jump.select("log_id", F.col("id").alias("to"), F.col("to").alias("end"))
        jump, n = cut(jump.join(onward, ["log_id", "to"]).select("log_id", "id", F.col("end").alias("to"))), 2 * n
    return found


def hot_path(spans: DataFrame) -> DataFrame:
    """Follow the largest merged child while it holds 40 % of its parent and more than its self.

    Each merged node names its parent by an id of the path, and every parent its largest child. The walk
    goes down all logs at once, one node a log, until no log goes on; paths themselves are not compared.
    """
    hashes = {"a": F.xxhash64(event_key()), "b": F.xxhash64(F.lit("key"), event_key())}
    linked = with_chain(spans, hashes)
    keyed = linked.select("*", _path_id(*hashes.values()).alias("id"), _path_id().alias("parent"), (F.size("chain") == 0).alias("top"))
    # The merged nodes are read four times below.
    nodes = cut(
        keyed.groupBy("log_id", "id", "parent", "top").agg(
            F.sum("dur_total").alias("total"),
            F.sum("dur_self").alias("self"),
            F.count("*").alias("calls"),
            F.min("event_index").alias("first_index"),
            F.max_by(
                F.struct("event_index", "text", "category"),
                F.struct("dur_total", (-F.col("event_index")).alias("o")),
            ).alias("worst"),
        )
    )
    lead = F.struct("total", (-F.col("first_index")).alias("o"))
    best = nodes.groupBy("log_id", "parent", "top").agg(F.max_by(F.struct("id", "total", "self", "calls", "worst"), lead).alias("b"))
    above = nodes.select("log_id", F.col("id").alias("parent"), F.col("total").alias("p_total"), F.col("self").alias("p_self"))
    follows = (F.col("b.total") > 0) & (
        F.col("top") | ((F.col("b.total") >= FOLLOW_SHARE * F.col("p_total")) & (F.col("p_self") <= F.col("b.total")))
    )
    edges = cut(best.join(above, ["log_id", "parent"], "left").filter(follows).select("log_id", "parent", "top", "b.*"))
    on_path = edges.join(_walk(edges), ["log_id", "id"])
    last = (
        on_path.groupBy("log_id")
        .agg(F.max_by(F.struct("id", "total", "self", "step"), "step").alias("l"))
        .select(
            "log_id",
            F.col("l.id").alias("parent"),
            F.col("l.total").alias("l_total"),
            F.col("l.step").alias("l_step"),
            _clamped("l.self", "l.total").alias("l_self"),
        )
    )
    branches = (
        nodes.filter("NOT top")
        .join(last, ["log_id", "parent"])
        .filter(F.col("l_self") < SELF_DOMINANT_SHARE * F.col("l_total"))
        .filter(F.col("total") >= BRANCH_SHARE * F.col("l_total"))
        .withColumn("step", F.col("l_step") + 1)
    )
    ends = branches.select("log_id").distinct().withColumn("fan", F.lit(True))

    def frames(df: DataFrame, kind: str) -> DataFrame:
        return df.select(
            "log_id",
            F.lit(kind).alias("kind"),
            "step",
            F.col("worst.text").alias("text"),
            F.col("worst.category").alias("category"),
            F.col("worst.event_index").alias("event_index"),
            F.col("total").alias("total_ns"),
            _clamped("self", "total").alias("self_ns"),
            "calls",
        )

    return (
        frames(on_path, "path")
        .unionByName(frames(branches, "branch"))
        .join(ends, "log_id", "left")
        .withColumn("path_end", F.when(F.col("fan"), "fan-out").otherwise("hot-spot"))
        .drop("fan")
    )


def _clamped(self_col: str, total_col: str) -> Column:
    return F.least(F.greatest(F.col(self_col), F.lit(0)), F.col(total_col))


def hot_spots(spans: DataFrame, k: int = HOT_SPOTS, size: int = CHUNK) -> DataFrame:
    """Top k signatures by self time; a total counts only calls not inside a counted one."""
    timed = spans.select(
        "log_id", "event_index", "type", "namespace", "text", "category", "ts_ns",
        F.coalesce("exit_ns", "ts_ns").alias("end_ns"),
        "dur_self",
        "dur_total",
    )
    seen = running(
        timed,
        ["log_id", "type", "namespace", "text"],
        ["event_index"],
        [slice_of("event_index", size)],
        {"until": ("max", F.col("end_ns"))},
        inclusive=False,
    )
    counted = F.col("until").isNull() | (F.col("ts_ns") >= F.col("until"))
    spots = seen.groupBy("log_id", "type", "namespace", "text").agg(
        F.sum(F.greatest("dur_self", F.lit(0))).alias("self_ns"),
        F.sum(F.when(counted, F.greatest("dur_total", F.lit(0))).otherwise(0)).alias("total_ns"),
        F.count("*").alias("calls"),
        F.min("event_index").alias("first_index"),
        F.max_by(
            F.struct("event_index", "category"),
            F.struct("dur_self", (-F.col("event_index")).alias("o")),
        ).alias("worst"),
    )
    top = top_k(spots.filter(F.col("self_ns") > 0), k, F.desc("self_ns"), F.asc("first_index"))
    return top.select(
        "log_id",
        "rank",
        "type",
        "namespace",
        "text",
        F.col("worst.category").alias("category"),
        F.col("worst.event_index").alias("event_index"),
        "self_ns",
        F.greatest("total_ns", "self_ns").alias("total_ns"),
        "calls",
    )


def truncation_regions(spans: DataFrame) -> DataFrame:
    """Number of top-most truncated events and the first of them."""
    cut_off = spans.filter("is_truncated").select("log_id", "event_index", "parent_index")
    truncated = spans.filter("is_truncated").withColumn("above", F.lit(True))
    inside = lookup(cut_off, "parent_index", truncated, {"above": F.col("above")})
    return (
        inside.filter(F.col("above").isNull())
        .groupBy("log_id")
        .agg(F.count("*").alias("regions"), F.min("event_index").alias("first_index"))
    )


def tallies(spans: DataFrame) -> DataFrame:
    """Per signature with self time: calls, sum, max and where the largest call is."""
    return (
        spans.filter(F.col("dur_self") > 0)
        .groupBy("log_id", "type", "namespace", "text")
        .agg(
            F.count("*").alias("calls"),
            F.sum("dur_self").alias("self_ns"),
            F.max("dur_self").alias("max_ns"),
            F.min("event_index").alias("first_index"),
            F.max_by(
                F.struct("event_index", "category"),
                F.struct("dur_self", (-F.col("event_index")).alias("o")),
            ).alias("worst"),
        )
    )


_SIGNATURE = ["log_id", "type", "namespace", "text"]


def self_time_spread(spans: DataFrame, k: int = LANES) -> DataFrame:
    """Top k repeated signatures with nearest-rank median and p95, maximum, bins and heights.

    Equal values are counted first, so the ranks run over distinct values, in value slices.
    """
    lanes = top_k(
        tallies(spans).filter(F.col("calls") > 1), k, F.desc("self_ns"), F.asc("first_index")
    )
    values = (
        spans.filter(F.col("dur_self") > 0)
        .groupBy(*_SIGNATURE, F.col("dur_self").alias("v"))
        .agg(F.count("*").alias("n"))
        .join(lanes.select(*_SIGNATURE, "calls", "max_ns"), _SIGNATURE)
    )
    narrow = F.floor(F.col("v") / F.lit(100_000)).cast("long")
    wide = F.floor(F.col("v") / F.lit(10_000_000_000)).cast("long")
    ranked = running(values, _SIGNATURE, ["v"], [narrow, wide], {"upto": ("sum", F.col("n"))})
    bin_no = F.least(F.floor(F.col("v") / F.col("max_ns") * BINS), F.lit(BINS - 1))
    stats = ranked.groupBy(*_SIGNATURE).agg(
        *[
            F.min(F.when(F.col("upto") >= F.ceil(F.lit(share) * F.col("calls")), F.col("v"))).alias(name)
            for name, share in [("median_ns", 0.5), ("p95_ns", 0.95)]
        ],
        F.array(
            *[F.coalesce(F.sum(F.when(bin_no == i, F.col("n"))), F.lit(0)) for i in range(BINS)]
        ).alias("bins"),
    )
    peak = F.array_max("bins")
    floor = F.lit(float(MIN_BIN_PERCENT))
    heights = F.transform(
        "bins", lambda b: F.when(b > 0, F.greatest(b / peak * 100, floor)).otherwise(0.0)
    )
    return (
        lanes.join(stats, _SIGNATURE)
        .withColumn("heights", heights)
        .select(
            *_SIGNATURE, "rank", "calls", "self_ns", "median_ns", "p95_ns", "max_ns", "bins", "heights",
            F.col("worst.event_index").alias("event_index"),
            F.col("worst.category").alias("category"),
        )
    )


def singles(spans: DataFrame, k: int = SINGLES) -> DataFrame:
    """Top k signatures called once."""
    once = tallies(spans).filter(F.col("calls") == 1)
    return top_k(once, k, F.desc("self_ns"), F.asc("first_index")).select(
        *_SIGNATURE, "rank", "self_ns", F.col("worst.event_index").alias("event_index")
    )


def concentration(
    df: DataFrame, value: str = "self_ns", share: float = 0.8, slice_width: int = 1_000_000
) -> DataFrame:
    """How many of the largest rows reach `share` of the sum.

    Rows of equal value are counted together, so even one value held by most rows is one step.
    """
    levels = df.filter(F.col(value) > 0).groupBy("log_id", F.col(value).alias("v")).agg(
        F.count("*").alias("n")
    )
    totals = df.groupBy("log_id").agg(F.sum(value).alias("all"), F.count("*").alias("rows"))
    down = levels.withColumn("d", -F.col("v"))
    steps = running(
        down,
        ["log_id"],
        ["d"],
        [
            F.floor(F.col("d") / F.lit(slice_width)).cast("long"),
            F.floor(F.col("d") / F.lit(slice_width * 100_000)).cast("long"),
        ],
        {"before": ("sum", F.col("v") * F.col("n")), "n_before": ("sum", F.col("n"))},
        inclusive=False,
    )
    target = F.lit(share) * F.col("all")
    need = F.least(F.col("n"), F.ceil((target - F.col("before")) / F.col("v")))
    return (
        steps.join(totals, "log_id")
        .filter(F.col("before") < target)
        .groupBy("log_id")
        .agg(
            F.max(F.col("n_before") + need).cast("long").alias("signatures"),
            F.max(F.col("before") + need * F.col("v")).cast("long").alias("held"),
            F.first("rows").alias("total"),
        )
    )


def bin_range(max_col: Column, index: Column, bins: int = BINS) -> tuple[Column, Column]:
    """Bounds of a histogram bin."""
    step = max_col / F.lit(bins)
    return step * index, step * (index + 1)
