"""Structure lookups on spans: ancestors with their fields, cover tests, parents."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.rollup import lookup
from spanforge.operators.scan import covered_slices, following, running, slice_of
from spanforge.schema import CHUNK, KEY
from spanforge.session import cut


def event_key() -> Column:
    return F.concat_ws("|", F.coalesce("type", F.lit("")), "namespace", "text")


def stack_key() -> Column:
    return F.concat_ws("|", "namespace", "text")


def chain_of(
    rows: DataFrame, spans: DataFrame, fields: Mapping[str, Column], size: int = CHUNK
) -> DataFrame:
    """Add `chain`: the row's ancestors, outermost first, each with its index and `fields`.

    The join key holds the slice of the row as well (see rollup.lookup), so a root frame with a
    third of all rows below it is still many small keys.
    """
    frames = spans.filter(F.col("last_index") > F.col("event_index")).select(
        "log_id",
        F.col("event_index").alias("ancestor"),
        covered_slices("event_index", "last_index", size).alias("__slice"),
        *[c.alias(n) for n, c in fields.items()],
    )
    steps = rows.select(
        *KEY, slice_of("event_index", size).alias("__slice"), F.posexplode("path").alias("at", "ancestor")
    )
    chains = (
        steps.join(frames, ["log_id", "ancestor", "__slice"])
        .groupBy(*KEY)
        .agg(
            F.sort_array(
                F.collect_list(F.struct("at", F.col("ancestor").alias("index"), *fields))
            ).alias("chain")
        )
    )
    empty = F.array().cast(chains.schema["chain"].dataType)
    return rows.join(chains, KEY, "left").withColumn("chain", F.coalesce("chain", empty))


def with_chain(
    spans: DataFrame, fields: Mapping[str, Column], size: int = CHUNK
) -> DataFrame:
    """`chain_of` for every span: paths are only exploded for frames, leaves take the parent's."""
    frames = spans.filter(F.col("last_index") > F.col("event_index"))
    deep = chain_of(frames.select(*KEY, "last_index", "path", "depth", *_inputs(frames, fields)), spans, fields, size)
    # The parent's own link follows its ancestors.
    link = F.struct(
        F.col("depth").alias("at"),
        F.col("event_index").alias("index"),
        *[c.alias(n) for n, c in fields.items()],
    )
    below = F.concat("chain", F.array(link))
    out = lookup(spans, "parent_index", deep, {"chain": below}, size)
    return out.withColumn("chain", F.coalesce("chain", F.array().cast(deep.schema["chain"].dataType)))


def _hashes(key: Column) -> dict[str, Column]:
    return {"a": F.xxhash64(key), "b": F.xxhash64(F.lit("key"), key)}


def _folded(chain: Column) -> dict[str, Column]:
    """128 bits that stand for the keys of a chain; those of one link more follow from them and its hashes."""
    none = F.lit(0).cast("long")
    return {f"p{n}": F.aggregate(chain[n], none, lambda sofar, h: F.xxhash64(sofar, h)) for n in "ab"}


def frame_paths(
    spans: DataFrame,
    fields: Mapping[str, Column] | None = None,
    more: Callable[[Column], Mapping[str, Column]] = lambda chain: {},
    size: int = CHUNK,
) -> DataFrame:
    """The frames of `spans` with what `with_paths` gives for them (`own`) and for what is right below (`below`).

    `more` makes columns from the ancestors, an array as in chain_of with `fields`.
    """
    fields = _hashes(event_key()) | dict(fields or {})
    made = lambda chain: F.struct(*[c.alias(n) for n, c in (_folded(chain) | dict(more(chain))).items()])
    link = F.struct(F.col("depth").alias("at"), F.col("event_index").alias("index"), *[c.alias(n) for n, c in fields.items()])
    frames = spans.filter(F.col("last_index") > F.col("event_index")).select(*KEY, "last_index", "path", "type", "namespace", "text", link.alias("link"))
    linked = chain_of(frames, spans, fields, size)
    return cut(linked.select("*", made(F.col("chain")).alias("own"), made(F.concat("chain", F.array("link"))).alias("below")).drop("chain", "link"))


def with_paths(
    rows: DataFrame,
    spans: DataFrame,
    frames: DataFrame,
    fields: Mapping[str, Column] | None = None,
    more: Callable[[Column], Mapping[str, Column]] = lambda chain: {},
    size: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """(`rows` with `pa` and `pb`, names (log_id, pa, pb, above)), for rows of `spans` and its `frame_paths`.

    `pa` and `pb` are 128 bits for the event keys of a row's ancestors, and `above` holds those keys, outermost first.
    Texts are joined once for each path, not for each row: paths are exploded for frames, with hashes only, and a
    leaf takes what its parent frame passes on. A leaf whose path is not its parent's is looked up by itself.
    """
    fields = _hashes(event_key()) | dict(fields or {})
    is_frame = F.coalesce(F.col("last_index") > F.col("event_index"), F.lit(False))
    passed = {"__made": F.col("below"), "__at": F.xxhash64("path")}
    leaves = cut(lookup(rows.filter(~is_frame), "parent_index", frames, passed, size))
    plain = F.coalesce(F.col("__at") == F.xxhash64(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))), F.lit(False))
    heads = rows.filter(is_frame).join(frames.select(*KEY, F.col("own").alias("__made")), KEY, "left")
    columns = [*rows.columns, "__made.*"]
    out = heads.filter("__made IS NOT NULL").select(*columns).unionByName(leaves.filter(plain).select(*columns))

    # One frame stands for each path that ends in it.
    below = ["log_id", F.col("below.pa").alias("pa"), F.col("below.pb").alias("pb")]
    first = frames.groupBy(*below).agg(F.min("event_index").alias("event_index"))
    text = {"key": event_key()}
    shown = frames.select(*KEY, "path", event_key().alias("key")).join(first, KEY)
    names = chain_of(shown, spans, text, size).select("log_id", "pa", "pb", F.concat("chain.key", F.array("key")).alias("above"))
    strays = cut(leaves.filter(~plain).drop("__made", "__at").unionByName(heads.filter("__made IS NULL").drop("__made")))
    if not strays.isEmpty():
        looked = chain_of(strays, spans, fields | text, size)
        odd = cut(looked.withColumn("__made", F.struct(*[c.alias(n) for n, c in (_folded(F.col("chain")) | dict(more(F.col("chain")))).items()])))
        out = out.unionByName(odd.select(*columns))
        names = names.unionByName(odd.select("log_id", "__made.pa", "__made.pb", F.col("chain.key").alias("above")))
    none = F.lit(0).cast("long")
    tops = spans.select("log_id").distinct().select("log_id", none.alias("pa"), none.alias("pb"), F.array().cast("array<string>").alias("above"))
    return out, cut(names.unionByName(tops).dropDuplicates(["log_id", "pa", "pb"]))


def _inputs(df: DataFrame, fields: Mapping[str, Column]) -> list[str]:
    skip = {*KEY, "last_index", "path", "depth"}
    return [c for c in ("type", "namespace", "text", "category", "is_parent", "dur_self", "dur_total", "line_number") if c in df.columns and c not in skip]


def covered(df: DataFrame, cond: Column, out: str, size: int = CHUNK, itself: bool = True) -> DataFrame:
    """True where the row (if `itself`) or an enclosing span satisfies `cond`.

    Subtrees nest or are disjoint, so a row is inside one exactly when the furthest end among the
    matching spans opened so far reaches it: a running maximum, no ancestor join.
    """
    far = running(
        df,
        ["log_id"],
        ["event_index"],
        [slice_of("event_index", size)],
        {"__far": ("max", F.when(cond, F.col("last_index")))},
        inclusive=itself,
    )
    return far.withColumn(out, F.coalesce(F.col("__far") >= F.col("event_index"), F.lit(False))).drop("__far")


def contains(df: DataFrame, cond: Column, out: str, size: int = CHUNK) -> DataFrame:
    """True where the row or anything below it satisfies `cond`."""
    next_hit = following(
        df, ["log_id"], "event_index", {"__hit": ("last", F.when(cond, F.col("event_index")))}, size
    )
    hit = F.coalesce(cond, F.lit(False)) | F.coalesce(F.col("__hit") <= F.col("last_index"), F.lit(False))
    return next_hit.withColumn(out, hit).drop("__hit")


def outermost(spans: DataFrame, cond: Column, size: int = CHUNK) -> DataFrame:
    """Spans that satisfy `cond` and are not inside another one that does."""
    return covered(spans, cond, "__inside", size, itself=False).filter(cond & ~F.col("__inside")).drop("__inside")


def sum_outermost(spans: DataFrame, cond: Column, value: str = "dur_total") -> DataFrame:
    return outermost(spans, cond).groupBy("log_id").agg(F.sum(value).alias(value))


def call_stack(spans: DataFrame, cond: Column) -> DataFrame:
    """Ancestors (outermost first) and the event itself for each event that satisfies `cond`."""
    rows = chain_of(
        spans.filter(cond).select(*KEY, "path", "type", "text"),
        spans,
        {"a_type": F.col("type"), "a_text": F.col("text")},
    )
    own = F.struct(
        F.size("path").alias("at"),
        F.col("event_index").alias("index"),
        F.col("type").alias("a_type"),
        F.col("text").alias("a_text"),
    )
    full = F.concat("chain", F.array(own))
    return rows.select(*KEY, F.explode(full).alias("f")).select(
        *KEY,
        F.col("f.at").alias("position"),
        F.col("f.index").alias("frame_index"),
        F.col("f.a_type").alias("type"),
        F.col("f.a_text").alias("text"),
    )


def event_by_index(spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """The spans named by (log_id, event_index) rows, with their depth."""
    return spans.join(wanted.select(*KEY).distinct(), KEY, "left_semi")


def caller_namespace(spans: DataFrame, size: int = CHUNK) -> DataFrame:
    """Add the direct parent's namespace (`default` at the root or when it has none)."""
    out = lookup(spans, "parent_index", spans, {"caller_namespace": F.col("namespace")}, size)
    named = F.when(F.col("caller_namespace") != "", F.col("caller_namespace"))
    return out.withColumn("caller_namespace", F.coalesce(named, F.lit("default")))
