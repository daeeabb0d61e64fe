"""Timeline data: frames, time buckets, density, the category on top, markers, point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.rollup import lookup
from spanforge.operators.scan import covered_slices, running, slice_of, whole
from spanforge.operators.tree import covered
from spanforge.schema import CATEGORIES, CHUNK, KEY
from spanforge.session import cut

SECOND = 1_000_000_000

# Order in which categories win a bucket, and their weight on the skyline.
PRIORITY = ["DML", "SOQL", "Callout", "Apex", "Code Unit", "System", "Automation", "Validation"]
WEIGHTS = {"DML": 2.5, "SOQL": 2.5, "Callout": 1.5, "System": 0.8, "Automation": 0.8, "Validation": 0.8}

# Marker kinds by rising severity.
SEVERITY_RANK = {"skip": 1, "unexpected": 2, "exception": 3}


def timed_spans(spans: DataFrame) -> DataFrame:
    """Spans that took time and are not below one that did not."""
    return covered(spans, F.col("dur_total") <= 0, "__hidden").filter(~F.col("__hidden")).drop("__hidden")


def frames(spans: DataFrame) -> DataFrame:
    """Rectangles: start, end, depth, category and self time of the timed spans of a category."""
    return timed_spans(spans).filter(F.col("category").isin(CATEGORIES)).select(
        *KEY, "parent_index", "last_index", "depth", "category", F.col("ts_ns").alias("start_ns"),
        F.coalesce("exit_ns", "ts_ns").alias("end_ns"), F.col("dur_self").alias("self_ns"),
        F.col("dur_total").alias("total_ns"),
    )


def frame_stats(spans: DataFrame) -> DataFrame:
    """Deepest level and latest end of the timed spans."""
    return timed_spans(spans).groupBy("log_id").agg(
        F.max("depth").alias("max_depth"), F.max(F.coalesce("exit_ns", "ts_ns")).alias("total_ns")
    )


def _priority() -> Column:
    pairs = [F.lit(x) for i, c in enumerate(PRIORITY) for x in (c, i)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("category")), F.lit(99))


def wide_frames(frame_rows: DataFrame, width_ns: int) -> DataFrame:
    """Frames wider than a bucket, which are drawn as they are."""
    return frame_rows.filter(F.col("total_ns") > width_ns)


def bucket_categories(frame_rows: DataFrame, width_ns: int) -> DataFrame:
    """Frames no wider than a bucket by depth, bucket of their start and category."""
    bucket = F.expr(f"start_ns div {width_ns}")
    narrow = frame_rows.filter(F.col("total_ns") <= width_ns)
    return narrow.groupBy("log_id", "depth", bucket.alias("bucket"), "category").agg(
        F.count("*").alias("events"), F.sum("total_ns").alias("time_ns")
    )


def bucket_frames(frame_rows: DataFrame, width_ns: int) -> DataFrame:
    """Buckets of `bucket_categories`: count, time, and the category that wins by priority, time, count."""
    per_category = bucket_categories(frame_rows, width_ns).withColumnsRenamed({"events": "n", "time_ns": "time"})
    wins = F.struct((-_priority()).alias("p"), "time", "n")
    return per_category.groupBy("log_id", "depth", "bucket").agg(
        F.sum("n").alias("events"),
        F.sum("time").alias("time_ns"),
        F.max_by("category", wins).alias("dominant"),
    )


def frames_in(frame_rows: DataFrame, t0: int, t1: int, d0: int, d1: int) -> DataFrame:
    """Frames that overlap a time and depth region."""
    return frame_rows.filter(
        (F.col("end_ns") > t0) & (F.col("start_ns") < t1) & F.col("depth").between(d0, d1)
    )


def _in_buckets(frame_rows: DataFrame, n_buckets: int, size: int) -> DataFrame:
    """Frames repeated once per bucket they touch (at most n_buckets), with the overlap.

    The length of the log joins in per slice of its frames, so no join key has more rows than a slice.
    """
    joined = whole(frame_rows, ["log_id"], slice_of("event_index", size), {"whole_ns": ("max", F.col("end_ns"))})
    width = F.col("whole_ns") / F.lit(n_buckets)
    first = F.greatest(F.lit(0), F.floor(F.col("start_ns") / width)).cast("long")
    last = F.least(F.lit(n_buckets - 1), F.floor(F.col("end_ns") / width)).cast("long")
    spread = joined.filter(first <= last).withColumn("bucket", F.explode(F.sequence(first, last)))
    low, high = F.col("bucket") * width, (F.col("bucket") + 1) * width
    overlap = F.least(F.col("end_ns").cast("double"), high) - F.greatest(F.col("start_ns").cast("double"), low)
    return spread.withColumn("overlap", overlap)


def _every_bucket(frame_rows: DataFrame, n_buckets: int) -> DataFrame:
    logs = frame_rows.select("log_id").distinct()
    return logs.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_buckets - 1).cast("long"))))


def density(frame_rows: DataFrame, n_buckets: int, size: int = CHUNK) -> DataFrame:
    """Per bucket, empty ones included: deepest frame, frames touching it, self time by share of overlap."""
    length = F.col("end_ns") - F.col("start_ns")
    share = F.when(length > 0, F.col("overlap") / length).otherwise(0.0)
    touched = _in_buckets(frame_rows, n_buckets, size).select(
        "log_id", "bucket", "depth", F.lit(1).alias("one"), (F.col("self_ns") * share).alias("part")
    )
    none = _every_bucket(frame_rows, n_buckets).withColumns({"depth": F.lit(0), "one": F.lit(0), "part": F.lit(0.0)})
    return touched.unionByName(none).groupBy("log_id", "bucket").agg(
        F.max("depth").alias("max_depth"), F.sum("one").alias("events"), F.sum("part").alias("self_ns")
    )


def skyline(frame_rows: DataFrame, n_buckets: int, size: int = CHUNK) -> DataFrame:
    """Category seen from above per bucket: weighted time with no deeper frame over it; Apex where
    there is no frame.

    The time on top of a frame in a bucket is its overlap minus that of its child frames, so a
    child adds to its own category and takes from its parent's; no sweep over boundaries.
    """
    parents = frame_rows.withColumn("p_category", F.col("category"))
    linked = lookup(frame_rows, "parent_index", parents, {"p_category": F.col("p_category")}, size)
    spread = _in_buckets(linked, n_buckets, size).withColumn("overlap", F.greatest("overlap", F.lit(0.0)))
    parts = spread.select(
        "log_id", "bucket",
        F.explode(
            F.array(
                F.struct(F.col("category").alias("c"), F.col("overlap").alias("t"), F.lit(1).alias("own")),
                F.struct(F.col("p_category").alias("c"), (-F.col("overlap")).alias("t"), F.lit(0).alias("own")),
            )
        ).alias("x"),
    ).filter(F.col("x.c").isNotNull())
    on_top = parts.groupBy("log_id", "bucket", F.col("x.c").alias("category")).agg(
        F.sum("x.t").alias("time"), F.sum("x.own").alias("frames")
    )
    pairs = [F.lit(x) for c, w in WEIGHTS.items() for x in (c, w)]
    weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("category")), F.lit(1.0))
    # Rounding keeps a fully covered category from winning on the last bits of a difference.
    score = F.round(F.col("time") * weight, 3)
    seen = (
        on_top.filter(F.col("frames") > 0)
        .groupBy("log_id", "bucket")
        .agg(
            F.max_by("category", F.struct(score.alias("s"), (-_priority()).alias("p"))).alias("best"),
            F.max(score).alias("score"),
            F.count("*").alias("categories"),
        )
        .select(
            "log_id",
            "bucket",
            F.when((F.col("categories") > 1) & (F.col("score") <= 0), "Apex").otherwise(F.col("best")).alias("category"),
        )
    )
    every = _every_bucket(frame_rows, n_buckets)
    return every.join(seen, ["log_id", "bucket"], "left").fillna("Apex", ["category"])


def event_at(spans: DataFrame, probes: DataFrame, slice_ns: int = SECOND, size: int = CHUNK) -> DataFrame:
    """Deepest span around each probe (log_id, t); a span that starts at t wins over its children.

    The last span begun by t is found by a scan in time; the answer is it or one of its
    ancestors, so no range join is needed. Needs a log whose times do not run backwards.
    """
    starts = spans.select("log_id", F.col("ts_ns").alias("t"), "event_index", F.lit(0).alias("probe"), "path", "last_index")
    asked = probes.select("log_id", "t").distinct().withColumn("probe", F.lit(1))
    both = cut(starts.unionByName(asked, allowMissingColumns=True).withColumn("slice", F.expr(f"t div {slice_ns}")))
    begun = F.when(F.col("probe") == 0, F.struct("event_index", "path"))
    near = running(both, ["log_id"], ["t", "probe", "event_index"], [F.col("slice")], {"near": ("last", begun)})
    steps = near.filter((F.col("probe") == 1) & F.col("near").isNotNull()).select(
        "log_id", "t", "near.event_index", F.explode(F.concat("near.path", F.array("near.event_index"))).alias("frame")
    )
    sides = spans.select(
        "log_id",
        F.col("event_index").alias("frame"),
        covered_slices("event_index", "last_index", size).alias("__slice"),
        "depth",
        "ts_ns",
        F.coalesce("exit_ns", "ts_ns").alias("end_ns"),
    )
    at = steps.withColumn("__slice", F.expr(f"event_index div {size}")).join(sides, ["log_id", "frame", "__slice"])
    inside = at.filter((F.col("ts_ns") <= F.col("t")) & (F.col("end_ns") >= F.col("t")))
    exact = F.col("ts_ns") == F.col("t")
    # Among spans that start at t the outermost is met first on the way down.
    order = F.struct(exact.alias("e"), F.when(exact, -F.col("depth")).otherwise(F.col("depth")).alias("d"))
    return inside.groupBy("log_id", "t").agg(
        F.max_by("frame", order).alias("event_index"), F.max_by("depth", order).alias("depth")
    )


def markers(issues: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Issue and exception markers with rank and width; sort by time, then severity.

    Issues of limits and fatal errors have an exception event that is a marker already.
    """
    from_issues = issues.filter(F.col("type").isin("skip", "unexpected")).select(
        "log_id", "event_index", F.col("type").alias("kind"), "start_ns", "end_ns", "summary"
    )
    thrown = exceptions.select(
        "log_id", "event_index", F.lit("exception").alias("kind"), F.col("ts_ns").alias("start_ns"),
        F.lit(None).cast("long").alias("end_ns"),
        F.substring_index(F.when(F.col("text") != "", F.col("text")).otherwise(F.col("type")), "\n", 1).alias("summary"),
    )
    rank = F.lit(0)
    for kind, r in SEVERITY_RANK.items():
        rank = F.when(F.col("kind") == kind, r).otherwise(rank)
    return (
        from_issues.unionByName(thrown)
        .filter(F.col("start_ns") >= 0)
        .withColumn("severity", rank)
        .withColumn("width_ns", F.coalesce("end_ns", "start_ns") - F.col("start_ns"))
    )


def search(spans: DataFrame, text: str, match_case: bool = False) -> DataFrame:
    """Frames whose text or type contains `text`."""
    def has(c: str) -> Column:
        return F.col(c).contains(text) if match_case else F.lower(c).contains(text.lower())

    return spans.filter(has("text") | has("type"))
