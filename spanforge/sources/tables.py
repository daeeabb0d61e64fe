"""Span tables built from relational tables.

`user_traces`: one flat trace per user of an activity stream.
`order_tree`: one deep trace per region (nation > customer > order > line) that behaves like a
parsed log: code units, methods, database statements and heap leaves, with counters rolled up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.operators.rollup import rollup, subtree_sums
from spanforge.operators.scan import running, slice_of
from spanforge.schema import CHUNK, METRICS
from spanforge.session import cut, measured_broadcasts, scratch

US_PER_HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    measured_broadcasts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_counters(df: DataFrame) -> DataFrame:
    """Add zero counters for a source that has none."""
    zero = F.lit(0).cast("long")
    return df.select(
        "*",
        *[zero.alias(f"{m}_{part}") for m in METRICS for part in ("self", "total")],
        zero.alias("heap_peak"),
    )


def build_user_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a flat trace; an event lasts until the user's next event.

    The order is the event time, sliced by user-hour so that one busy user is many small sorts.
    """
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("log_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "event_id",
        F.col("event_type").alias("type"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
    hour = F.floor(F.col("us") / F.lit(US_PER_HOUR)).cast("long")
    day = F.floor(F.col("us") / F.lit(24 * US_PER_HOUR)).cast("long")
    indexed = running(
        raw, ["log_id"], ["us", "event_id"], [hour, day], {"event_index": ("sum", F.lit(1))}
    )
    flipped = indexed.withColumn("__back", -F.col("us")).withColumn("__bid", -F.col("event_id"))
    ended = running(
        flipped,
        ["log_id"],
        ["__back", "__bid"],
        [-hour, -day],
        {"next_us": ("last", F.col("us"))},
        inclusive=False,
    )
    ts = F.col("us") * 1000
    exit_ns = F.coalesce("next_us", "us") * 1000
    error = F.when(F.col("type") == "error", 1).otherwise(0).cast("long")
    spans = ended.select(
        "log_id",
        F.col("event_index").cast("long").alias("event_index"),
        F.lit(0).cast("long").alias("parent_index"),
        F.lit(0).alias("depth"),
        F.col("event_index").cast("long").alias("last_index"),
        F.array().cast("array<bigint>").alias("path"),
        ts.alias("ts_ns"),
        exit_ns.alias("exit_ns"),
        "type",
        F.lit("default").alias("namespace"),
        F.col("type").alias("text"),
        F.when(F.col("type") == "purchase", "DML")
        .when(F.col("type") == "view", "SOQL")
        .when(F.col("type") == "error", "")
        .otherwise("Apex")
        .alias("category"),
        F.lit(True).alias("is_parent"),
        (exit_ns - ts).alias("dur_self"),
        (exit_ns - ts).alias("dur_total"),
        "cents",
    )
    return no_counters(spans).withColumn("thrown_self", error).withColumn("thrown_total", error)


def order_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of the order tree by key, with the number and time of the lines below an order.

    A unit is a key (log_id, nk, ck, ok), -1 where it has no customer or order. `heads` are its frames; there are
    several where keys repeat. A line comes once per head; `n_early` lines sort before the heads (no line number).
    """
    place = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("nk"), F.col("n_regionkey").cast("string").alias("log_id"), "n_name"
    )
    cust = (
        table(spark, sf_dir, "customer")
        .select(F.col("c_nationkey").cast("long").alias("nk"), F.col("c_custkey").alias("ck"), F.concat(F.lit("Segment."), "c_mktsegment", F.lit("()")).alias("segment"))
        .join(place.drop("n_name"), "nk")
    )
    order = (
        table(spark, sf_dir, "orders")
        .select(F.col("o_custkey").alias("ck"), F.col("o_orderkey").alias("ok"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
        .join(cust, "ck")
    )
    key = ["ck", "ok", "nk", "log_id"]
    missing = F.lit(None).cast("string")

    def unit(src, level, text, own, status=missing, priority=missing):
        keys = [(F.col(k) if k in src.columns else F.lit(-1)).cast("long").alias(k) for k in ("ck", "ok")]
        heads = src.select("log_id", "nk", *keys, F.struct(text.alias("text"), status.alias("status"), priority.alias("priority")).alias("h"))
        return heads.groupBy(*key).agg(F.collect_list("h").alias("heads")).select("*", F.lit(level).alias("depth"), own.cast("long").alias("own"))

    line = order_lines(spark, sf_dir)
    counted = line.groupBy("ok").agg(
        F.count("*").alias("n_lines"),
        F.sum("self_ns").alias("line_ns"),
        F.count_if("early").alias("n_early"),
        F.sum(F.when(F.col("early"), F.col("self_ns"))).alias("early_ns"),
    )
    return (
        unit(order, 2, F.col("segment"), F.col("ok") % 97 + 1, F.col("status"), F.col("priority"))
        .join(counted, "ok", "left")
        .unionByName(unit(cust, 1, F.col("segment"), F.lit(10)), allowMissingColumns=True)
        .unionByName(unit(place, 0, F.col("n_name"), F.lit(0)), allowMissingColumns=True)
        .withColumns({c: F.coalesce(c, F.lit(0).cast("long")) * F.size("heads") for c in ("n_lines", "line_ns", "n_early", "early_ns")})
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of orders with their sort key; `early` ones sort before their order's own key of -1s."""
    key = [F.col("l_linenumber").cast("long"), F.col("l_partkey"), F.col("l_suppkey"), F.round(F.col("l_extendedprice") * 100).cast("long")]
    own = F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_quantity").cast("long") * 1000)
    none = F.lit(-1).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"),
        # Line keys repeat in places; the price tells such lines apart.
        *[c.alias(n) for c, n in zip(key, ("ln", "lp", "ls", "lx"), strict=True)],
        (F.struct(*[c.alias(n) for c, n in zip(key, "abcd", strict=True)]) < F.struct(*[none.alias(n) for n in "abcd"])).alias("early"),
        own.cast("long").alias("self_ns"),
        F.col("l_quantity").cast("long").alias("qty"),
        "l_returnflag",
        "l_linestatus",
    )


def placed_units(units: DataFrame, size: int = CHUNK) -> DataFrame:
    """Add what the log holds before each unit: `before` rows, `spent` time, and the last frame of each depth."""
    # The finest slice is 64 customers; where those have more than `size` units, a range of one customer's orders.
    group = F.floor(F.col("ck") / F.lit(64)).alias("cg")
    large = units.groupBy("log_id", "nk", group).agg(F.count("*").alias("n")).filter(F.col("n") > size)
    split = F.coalesce("large", F.col("log_id").isNull())
    grouped = units.select("*", group).join(cut(large.select("log_id", "nk", "cg", F.lit(True).alias("large"))), ["log_id", "nk", "cg"], "left")
    sliced = grouped.withColumn(
        "fine",
        F.struct("nk", "cg", F.when(split, F.col("ck")).alias("c"), F.when(split, F.floor(F.col("ok") / F.lit(4096))).alias("b")),
    ).drop("cg", "large")
    ranges = [F.col("fine"), F.struct("nk", F.floor(F.col("ck") / F.lit(4096)).alias("b")), F.col("nk")]
    frames = F.size("heads")

    def before(df, specs):
        return running(df, ["log_id"], ["nk", "ck", "ok"], ranges, specs, inclusive=False)

    counted = before(
        sliced, {"before": ("sum", frames + F.col("n_lines")), "spent": ("sum", frames * F.col("own") + F.col("line_ns"))}
    )
    head = F.col("before") + F.col("n_early") + frames
    return before(cut(counted.drop("line_ns")), {f"p{k}": ("last", F.when(F.col("depth") == k, head)) for k in range(3)}).drop("fine")


def order_nodes(spark: SparkSession, sf_dir: str, units: DataFrame) -> DataFrame:
    """Nodes of the order tree with index, path, times, texts and counter seeds, from its placed units.

    All is numbered by unit, so that the many lines move once, by their order.
    """
    zero = F.lit(0).cast("long")

    def below(keys, least):
        return units.filter(F.col("depth") > least).groupBy("log_id", *keys).agg(F.sum(F.size("heads") + F.col("n_lines")).alias("n"))

    def heads(level):
        return units.filter(F.col("depth") == level)

    def frames(src, n):
        at = F.col("before") + F.col("n_early") + F.col("j") + 1
        return src.withColumn("n", n).select("*", F.posexplode("heads").alias("j", "h")).select(
            "*", "h.*", at.alias("event_index"), (F.col("spent") + F.col("early_ns") + F.col("j") * F.col("own")).alias("ts_ns"),
            (at + F.coalesce("n", zero)).alias("last_index"), F.col("own").alias("self_ns"),
        )

    place = frames(heads(0).join(below(["nk"], 0), ["log_id", "nk"], "left"), F.col("n"))
    cust = frames(heads(1).join(below(["nk", "ck"], 1), ["log_id", "nk", "ck"], "left"), F.col("n"))
    order = frames(heads(2), F.when(F.col("log_id").isNotNull(), F.col("n_lines")))

    # Several units have one order key only where keys repeat.
    fields = ["log_id", "nk", "ck", "heads", "own", "before", "spent", "n_early", "p0", "p1", "p2"]
    by_order = heads(2).groupBy("ok").agg(F.collect_list(F.struct(*fields)).alias("units"))
    w = W.partitionBy("ok").orderBy("ln", "lp", "ls", "lx").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = order_lines(spark, sf_dir).withColumns(
        {"rank": F.count(F.lit(1)).over(w), "sofar": F.sum("self_ns").over(w) - F.col("self_ns")}
    )
    item = ranked.join(by_order, "ok").withColumn("u", F.explode("units")).select("*", "u.*").select("*", F.posexplode("heads").alias("j", "h"))
    many = F.size("heads")
    early = F.col("early")
    at = F.col("before") + (F.col("rank") - 1) * many + F.col("j") + 1 + F.when(early, 0).otherwise(many)
    ts = F.col("spent") + F.col("sofar") * many + F.col("j") * F.col("self_ns") + F.when(early, 0).otherwise(many * F.col("own"))
    last_head = F.when(early, F.col("p2")).otherwise(F.col("before") + F.col("n_early") + many)
    item = item.select("*", at.alias("event_index"), ts.alias("ts_ns"), at.alias("last_index"), F.col("h.text").alias("segment")).withColumn("p2", last_head)

    def node(src, level, **cols):
        defaults = {
            "type": F.lit("METHOD_ENTRY"),
            "namespace": F.lit("default"),
            "text": F.lit(""),
            "category": F.lit("Apex"),
            "is_parent": F.lit(True),
            "line_number": F.lit(0),
            "sobject_type": F.lit(None).cast("string"),
            **{f"{m}_self": F.lit(0) for m in METRICS if not m.startswith("heap_")},
        }
        longs = {f"{m}_self" for m in METRICS}
        heap = F.coalesce(cols.pop("heap_bytes", zero), zero).cast("long")
        picked = defaults | cols
        return src.select(
            "log_id",
            F.lit(level).alias("depth"),
            *[(c.cast("long") if n in longs else c).alias(n) for n, c in picked.items()],
            "event_index",
            F.when(F.col("ok") >= 0, F.col("ok")).alias("o_key"),
            "last_index",
            F.slice(F.array("p0", "p1", "p2"), 1, level).alias("path"),
            "ts_ns",
            F.col("self_ns").alias("dur_self"),
            heap.alias("heap_net_self"),
            F.greatest(heap, zero).alias("heap_gross_self"),
        ).withColumn("parent_index", F.coalesce(F.try_element_at("path", F.lit(-1)), zero))

    soql = F.col("status") == "F"
    dml = F.col("status") == "O"
    sosl = F.col("status") == "P"
    kind = lambda q, d, s: F.when(soql, q).when(dml, d).otherwise(s)
    object_name = F.concat(F.lit("Order_"), F.substring("priority", 1, 1), F.lit("__c"))
    query = F.concat(
        F.lit("SELECT Id FROM "),
        object_name,
        F.lit(" WHERE Key__c = '"),
        (F.col("ok") % 11).cast("string"),
        F.lit("'"),
        F.when(F.col("ok") % 3 == 0, " ORDER BY Name").otherwise(""),
        F.when(F.col("ok") % 4 == 0, " LIMIT 10").otherwise(""),
    )
    write = F.concat(F.lit("DML Op:Update Type:"), object_name)
    search = F.concat(F.lit("SOSL: FIND '"), "priority", F.lit("'"))
    heap = F.col("l_returnflag") == "N"
    inner = F.col("l_returnflag") == "A"
    heap_bytes = F.col("qty") * F.when(F.col("ln") % 3 == 0, -10).otherwise(10)
    one = lambda cond: F.when(cond, 1).otherwise(0)

    return (
        node(place, 0, type=F.lit("CODE_UNIT_STARTED"), text=F.col("text"), category=F.lit("Code Unit"))
        .unionByName(node(cust, 1, text=F.col("text")))
        .unionByName(
            node(
                order,
                2,
                type=kind(F.lit("SOQL_EXECUTE_BEGIN"), F.lit("DML_BEGIN"), F.lit("SOSL_EXECUTE_BEGIN")),
                text=kind(query, write, search),
                category=F.when(dml, "DML").otherwise("SOQL"),
                line_number=(F.col("ok") % 4 + 1).cast("int"),
                sobject_type=F.when(dml, object_name),
                dml_count_self=one(dml),
                soql_count_self=one(soql),
                sosl_count_self=one(sosl),
                dml_rows_self=F.when(dml, F.col("ok") % 9).otherwise(0),
                soql_rows_self=F.when(soql, F.col("ok") % 13).otherwise(0),
                sosl_rows_self=F.when(sosl, F.col("ok") % 5).otherwise(0),
            )
        )
        .unionByName(
            node(
                item,
                3,
                type=F.when(heap, "HEAP_ALLOCATE").otherwise("METHOD_ENTRY"),
                namespace=F.when(inner, "pkg").otherwise("default"),
                text=F.when(heap, F.concat(F.lit("Bytes:"), heap_bytes.cast("string")))
                .when(inner, F.concat(F.lit("pkg.Outer.Inner.step"), "l_linestatus", F.lit("()")))
                .otherwise(F.col("segment")),
                category=F.when(heap, "").otherwise("Apex"),
                is_parent=~heap,
                line_number=F.col("ln").cast("int"),
                heap_bytes=F.when(heap, heap_bytes),
            )
        )
    )


def build_order_tree(spark: SparkSession, sf_dir: str, size: int = CHUNK) -> DataFrame:
    """The order tree as spans: pre-order index, paths, times and rolled-up counters."""
    placed = cut(placed_units(cut(order_units(spark, sf_dir))))
    shaped = cut(order_nodes(spark, sf_dir, placed))
    rolled = rollup(shaped, extra={"dur_total": F.col("dur_self")}, size=size)
    return rolled.withColumn("exit_ns", F.col("ts_ns") + F.col("dur_total"))


_BUILT: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write a span table the first time it is asked for in a session, then read it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        with scratch(spark) as keep:
            _BUILT[key] = keep(build(spark, sf_dir))
    return _BUILT[key]


def order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "order_tree", build_order_tree)


def user_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "user_traces", build_user_traces)


def order_logs(spark: SparkSession, sf_dir: str, size: int = CHUNK) -> DataFrame:
    """The order tree written out as trace-log lines, one log per region.

    Line numbers follow from the tree: a line's place is the entries up to it plus the exits
    before it, and those are the frames opened so far minus the ones still open.
    """
    spans = order_tree(spark, sf_dir)
    frame = F.col("is_parent").cast("long")
    counted = subtree_sums(spans, {"frames": frame}, size)
    opened = running(
        counted, ["log_id"], ["event_index"], [slice_of("event_index", size)], {"opened": ("sum", frame)}, inclusive=False
    )
    header = 2
    start = F.col("event_index") + F.col("opened") - F.col("depth") + header
    end = F.col("last_index") + F.col("opened") + F.col("frames") - F.col("depth") + header
    stamp = lambda c: F.concat(F.lit("10:00:00.0 ("), F.col(c).cast("string"), F.lit(")|"))
    t = F.col("type")
    at = F.concat(F.lit("["), F.coalesce("line_number", F.lit(0)).cast("string"), F.lit("]"))

    def body(*cases, otherwise):
        expr = None
        for name, pieces in cases:
            value = F.concat_ws("|", *[p if not isinstance(p, str) else F.lit(p) for p in pieces])
            expr = F.when(t == name, value) if expr is None else expr.when(t == name, value)
        return expr.otherwise(F.concat_ws("|", *[p if not isinstance(p, str) else F.lit(p) for p in otherwise]))

    rows = lambda c: F.concat(F.lit("Rows:"), F.col(c).cast("string"))
    first = body(
        ("CODE_UNIT_STARTED", ["CODE_UNIT_STARTED", "[EXTERNAL]", "01p", F.col("text")]),
        ("SOQL_EXECUTE_BEGIN", ["SOQL_EXECUTE_BEGIN", at, "Aggregations:0", F.col("text")]),
        ("DML_BEGIN", ["DML_BEGIN", at, "Op:Update", F.concat(F.lit("Type:"), "sobject_type"), rows("dml_rows_self")]),
        ("SOSL_EXECUTE_BEGIN", ["SOSL_EXECUTE_BEGIN", at, F.substr("text", F.lit(7))]),
        ("HEAP_ALLOCATE", ["HEAP_ALLOCATE", at, F.col("text")]),
        otherwise=["METHOD_ENTRY", at, "01p", F.col("text")],
    )
    last = body(
        ("CODE_UNIT_STARTED", ["CODE_UNIT_FINISHED", F.col("text")]),
        ("SOQL_EXECUTE_BEGIN", ["SOQL_EXECUTE_END", at, rows("soql_rows_self")]),
        ("DML_BEGIN", ["DML_END", at]),
        ("SOSL_EXECUTE_BEGIN", ["SOSL_EXECUTE_END", at, rows("sosl_rows_self")]),
        otherwise=["METHOD_EXIT", at, "01p", F.col("text")],
    )
    pair = F.when(
        F.col("is_parent"),
        F.array(
            F.struct(start.alias("line_no"), F.concat(stamp("ts_ns"), first).alias("line")),
            F.struct(end.alias("line_no"), F.concat(stamp("exit_ns"), last).alias("line")),
        ),
    ).otherwise(F.array(F.struct(start.alias("line_no"), F.concat(stamp("ts_ns"), first).alias("line"))))
    lines = opened.select("log_id", F.explode(pair).alias("l")).select("log_id", "l.line_no", "l.line")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("log_id"), "r_name")
    top = region.select(
        "log_id",
        F.explode(
            F.array(
                F.struct(F.lit(1).cast("long").alias("line_no"), F.lit("64.0 APEX_CODE,FINE;APEX_PROFILING,NONE;DB,INFO").alias("line")),
                F.struct(
                    F.lit(2).cast("long").alias("line_no"),
                    F.concat(F.lit("10:00:00.0 (0)|USER_INFO|[EXTERNAL]|005|"), F.lower("r_name"), F.lit("@example.com|(GMT+00:00) GMT|GMT")).alias("line"),
                ),
            )
        ).alias("l"),
    ).select("log_id", "l.*")
    return lines.unionByName(top)


def user_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user traces as logs without exits: heap and limit lines, exceptions, open methods,
    skip markers and unsupported types."""
    e = user_traces(spark, sf_dir)
    ts = F.col("ts_ns").cast("string")
    second = (F.col("ts_ns") / F.lit(1_000_000_000)).cast("long") % 86400
    clock = F.format_string(
        "%02d:%02d:%02d.%d", (second / 3600).cast("int"), (second % 3600 / 60).cast("int"), (second % 60).cast("int"), F.lit(5)
    )
    head = F.concat(clock, F.lit(" ("), ts, F.lit(")|"))
    cents = F.col("cents").cast("string")
    mod = lambda n: (F.col("cents") % n).cast("string")
    kind = F.col("type")
    line = (
        F.when(kind == "click", F.concat(head, F.lit("HEAP_ALLOCATE|[1]|Bytes:"), cents))
        .when((kind == "view") & (F.col("cents") % 2 == 0), F.concat(F.lit("*** Skipped "), cents, F.lit(" bytes of detailed log")))
        .when(kind == "view", F.concat(head, F.lit("NOT_KNOWN_"), F.when(F.col("cents") % 3 == 0, "A").otherwise("B"), F.lit("|x")))
        .when(kind == "purchase", F.concat(head, F.lit("LIMIT_USAGE|[1]|SOQL|"), mod(100), F.lit("|100")))
        .when(kind == "error", F.concat(head, F.lit("EXCEPTION_THROWN|["), mod(7), F.lit("]|System.LimitException: Too many SOQL queries: "), mod(3)))
        .otherwise(F.concat(head, F.lit("METHOD_ENTRY|["), mod(5), F.lit("]|01p|Foo.bar()")))
    )
    return e.select("log_id", F.col("event_index").alias("line_no"), line.alias("line"))
