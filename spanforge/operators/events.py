"""Lines to events: one row per line of a known type, with every field the type carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import extract as x
from spanforge.functions.event_types import type_dimension
from spanforge.operators.scan import running, slice_of
from spanforge.schema import CHUNK
from spanforge.session import cut
from spanforge.sources.logs import SETTINGS_LINE

PIECE = 1_000
FLOW_RUNNING = ["FLOW_ELEMENT_LIMIT_USAGE", "FLOW_BULK_ELEMENT_LIMIT_USAGE"]
FLOW_LABELLED = ["FLOW_START_INTERVIEW_LIMIT_USAGE", "FLOW_INTERVIEW_FINISHED_LIMIT_USAGE"]


def _dimension(df: DataFrame, *cols: str) -> DataFrame:
    """The type table, or some of its columns; its size is fixed, so it is broadcast."""
    dim = type_dimension(df.sparkSession)
    return F.broadcast(dim.select("type", *cols) if cols else dim)


def tag_lines(lines: DataFrame, size: int = CHUNK) -> DataFrame:
    """Each line with its role, and the index of the event it is or belongs to.

    Events number from 1 in line order; 0 is the log itself.
    """
    kind = F.coalesce(F.get(F.split("line", r"\|", 3), F.lit(1)), F.lit(""))
    typed = lines.select("log_id", "line_no", "line", kind.alias("type")).join(
        _dimension(lines, "accepts_text"), "type", "left"
    )
    known = F.col("accepts_text").isNotNull()
    counted = running(
        typed,
        ["log_id"],
        ["line_no"],
        [slice_of("line_no", size)],
        {
            "event_index": ("sum", known.cast("long")),
            "host_text": ("last", F.col("accepts_text")),
        },
    )
    named = (F.col("type") != "") & F.col("type").rlike("^[A-Z_]*$")
    hosted = F.col("event_index") > 0
    role = (
        F.when(known, "event")
        .when(~named & F.coalesce("host_text", F.lit(False)), "text")
        .when(named, "unsupported")
        .when(hosted & F.col("line").startswith("*** Skipped"), "skip")
        .when(hosted & F.col("line").contains("MAXIMUM DEBUG LOG SIZE REACHED"), "max_size")
        .when(F.col("line").rlike(SETTINGS_LINE), "settings")
        .otherwise("invalid")
    )
    return counted.select("log_id", "line_no", "line", "type", "event_index", "accepts_text", role.alias("role"))


def parse_errors(tagged: DataFrame) -> DataFrame:
    """Unsupported type names (once per log) and invalid lines (each)."""
    unsupported = (
        tagged.filter(F.col("role") == "unsupported")
        .groupBy("log_id", F.concat(F.lit("Unsupported log event name: "), "type").alias("message"))
        .agg(F.min("line_no").alias("line_no"))
    )
    invalid = tagged.filter(F.col("role") == "invalid").select(
        "log_id", F.concat(F.lit("Invalid log line: "), "line").alias("message"), "line_no"
    )
    time_field = F.substring_index("line", "|", 1)
    bad_time = tagged.filter(
        (F.col("role") == "event") & (time_field != "") & x.ts_ns(time_field).isNull()
    ).select(
        "log_id", F.concat(F.lit("Unable to parse timestamp: "), time_field).alias("message"), "line_no"
    )
    return unsupported.unionByName(invalid).unionByName(bad_time)


def _in_order(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """The texts of a group as one, in order, joined by line ends."""
    found = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("e"))
    return found.select(*keys, F.array_join(F.col("e").getField(text), "\n").alias(text))


def with_continuations(tagged: DataFrame) -> DataFrame:
    """Event lines with `extra`, their continuation lines.

    Only events of types that accept text can have any; the others are not joined. Lines come together in
    runs of PIECE line numbers and those in their order, so no list holds more than PIECE lines, or as
    many runs as a string has room for.
    """
    events = tagged.filter(F.col("role") == "event").drop("role")
    text = tagged.filter(F.col("role") == "text")
    pieces = _in_order(text.withColumn("piece", slice_of("line_no", PIECE)), ["log_id", "event_index", "piece"], "line_no", "line")
    extra = _in_order(pieces, ["log_id", "event_index"], "piece", "line").withColumnRenamed("line", "extra")
    hosts = events.filter("accepts_text").join(extra, ["log_id", "event_index"], "left")
    return hosts.unionByName(
        events.filter("NOT accepts_text").withColumn("extra", F.lit(None).cast("string"))
    )


def _pick(t: Column, cases: list[tuple[str | list[str], Column]], default: Column) -> Column:
    expr = None
    for names, value in cases:
        cond = t.isin(names) if isinstance(names, list) else t == names
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default)


def to_fields(hosted: DataFrame) -> DataFrame:
    """All fields that need only the event itself."""
    t = F.col("type")
    field = F.when(F.col("has_line"), x.part(2))
    split = hosted.drop("accepts_text").withColumn("parts", F.split("line", r"\|"))
    base = split.join(_dimension(hosted), "type").withColumns(
        {
            "ts_ns": F.coalesce(x.ts_ns(x.part(0)), F.lit(0).cast("long")),
            "line_number": F.when(F.col("has_line"), x.line_number(field)).otherwise(0),
            "is_external": F.col("has_line") & x.is_external(field),
        }
    )
    unit, call = x.code_unit(), x.page_call()
    method_name, ctor_name = x.part(4), x.part_or_empty(5)
    method, ctor = x.method_parts(F.coalesce(method_name, F.lit(""))), x.ctor_parts(ctor_name)
    filled_name = F.when(method_name != "", method_name)
    loading = F.coalesce(filled_name, t).startswith("System.Type.forName(")
    exit_text = F.coalesce(x.part(4), x.part(3), t)
    package = x.package_ns(x.part_or_empty(2))
    first_text = _pick(
        t,
        [
            ("METHOD_ENTRY", F.coalesce(filled_name, t)),
            ("METHOD_EXIT", exit_text),
            ("CONSTRUCTOR_ENTRY", x.ctor_text()),
            ("CODE_UNIT_STARTED", unit["text"]),
            ("VF_APEX_CALL_START", call["text"]),
            ("ENTERING_MANAGED_PKG", package),
            ("CUMULATIVE_PROFILING", F.concat(x.part_or_undefined(2), F.lit(" "), x.part_or_empty(3))),
            ("FLOW_START_INTERVIEWS_BEGIN", F.lit("FLOW_START_INTERVIEWS : ")),
            (
                "VALIDATION_FORMULA",
                F.concat(x.part_or_undefined(2), F.when(F.size("parts") > 3, F.concat(F.lit(" "), x.part(3))).otherwise("")),
            ),
            (
                "WF_FLOW_ACTION_DETAIL",
                F.concat(
                    x.part_or_undefined(2), F.lit(" : "), x.part_or_undefined(3),
                    F.when(x.part_or_empty(4) != "", F.concat(F.lit(" : "), x.part(4), F.lit(" :"), x.part_or_undefined(5))).otherwise(""),
                ),
            ),
        ],
        F.when(F.col("rule").isNotNull(), x.ruled_text()).otherwise(t),
    )
    text = F.when(F.col("extra").isNotNull(), F.concat(first_text, F.lit("\n"), "extra")).otherwise(first_text)
    own_ns = _pick(
        t,
        [
            ("METHOD_EXIT", x.class_reference_ns(exit_text)),
            ("CODE_UNIT_STARTED", unit["namespace"]),
            ("ENTERING_MANAGED_PKG", F.when(package != "", package)),
            ("METHOD_ENTRY", F.when(~loading, method["shaped"])),
            ("CONSTRUCTOR_ENTRY", ctor["shaped"]),
        ],
        F.when(F.col("preset_ns"), "default"),
    )
    candidate = _pick(
        t,
        [("METHOD_ENTRY", F.when(~loading, method["candidate"])), ("CONSTRUCTOR_ENTRY", ctor["candidate"])],
        F.lit(None).cast("string"),
    )
    endless = (t == "VF_APEX_CALL_START") & call["endless"]
    heap = t.isin("HEAP_ALLOCATE", "HEAP_DEALLOCATE")
    bytes_ = F.when(heap, x.bytes_of(x.part(3))).when(t == "BULK_HEAP_ALLOCATE", x.bytes_of(x.part(2)))
    rows = _pick(
        t,
        [("DML_BEGIN", x.rows_of(x.part(5))), (["SOQL_EXECUTE_END", "SOSL_EXECUTE_END"], x.rows_of(x.part(3)))],
        F.lit(None).cast("long"),
    )
    coded, running_, labelled = x.coded_limit(), x.running_limit(x.part_or_empty(2)), x.labelled_limit(x.part_or_empty(2))
    limit = {
        name: _pick(
            t,
            [("LIMIT_USAGE", coded[name]), (FLOW_RUNNING, running_[name]), (FLOW_LABELLED, labelled[name])],
            F.lit(None),
        )
        for name in ("metric", "used", "limit", "delta")
    }
    aggregations = x.after(x.part(3), "Aggregations:").try_cast("int")
    return base.select(
        "log_id",
        "event_index",
        "line_no",
        "line",
        "ts_ns",
        "type",
        "kind",
        F.when(endless, F.array().cast("array<string>")).otherwise(F.col("ends")).alias("ends"),
        "category",
        _pick(
            t,
            [("CODE_UNIT_STARTED", unit["cpu_type"]), ("METHOD_ENTRY", F.when(loading, "loading").otherwise("method"))],
            F.col("cpu_type"),
        ).alias("cpu_type"),
        "debug_category",
        "debug_level",
        "accepts_text",
        "is_exit",
        "ends_at_next",
        "discontinuity",
        (F.col("kind") == "span").alias("is_parent"),
        "line_number",
        "is_external",
        text.alias("text"),
        F.col("type_suffix").alias("suffix"),
        F.when(t == "CODE_UNIT_STARTED", unit["unit_type"]).alias("unit_type"),
        own_ns.alias("own_ns"),
        candidate.alias("candidate"),
        F.when((t == "DML_BEGIN") & x.part(4).startswith("Type:"), F.substr(x.part(4), F.lit(6))).alias("sobject_type"),
        F.when(t == "SOQL_EXECUTE_BEGIN", F.coalesce(aggregations, F.lit(0))).alias("aggregations"),
        F.when(t == "SOQL_EXECUTE_EXPLAIN", x.plan_fields(x.part_or_empty(3))).alias("plan"),
        F.struct(*[limit[n].alias(n) for n in limit]).alias("limit_obs"),
        bytes_.alias("bytes"),
        rows.alias("n_rows"),
    )


def known_namespaces(fields: DataFrame) -> DataFrame:
    """Namespaces of each log with the event that first shows them."""
    return (
        fields.filter(F.coalesce("own_ns", F.lit("")) != "")
        .groupBy("log_id", F.col("own_ns").alias("namespace"))
        .agg(F.min("event_index").alias("first_index"))
    )


def resolve_namespaces(fields: DataFrame, size: int = CHUNK) -> DataFrame:
    """Look candidate namespaces up among those already seen in the log.

    A log has few namespaces, so the lookup table holds them once per slice of the log that needs
    it, and no join key gathers more rows than a slice. It is cut, so that the events stay in place unless its
    file is too large to be broadcast.
    """
    slice_ = slice_of("event_index", size)
    asking = fields.filter(F.col("candidate").isNotNull()).withColumn("__slice", slice_)
    seen = known_namespaces(fields).select(
        "log_id", F.col("namespace").alias("candidate"), F.col("first_index").alias("__first")
    )
    table = cut(asking.select("log_id", "__slice").distinct().join(seen, "log_id"))
    hit = F.col("__first") < F.col("event_index")
    looked = (
        asking.join(table, ["log_id", "__slice", "candidate"], "left")
        .withColumn("own_ns", F.when(hit, F.col("candidate")).otherwise(F.col("own_ns")))
        .drop("__slice", "__first", "candidate")
    )
    return looked.unionByName(fields.filter(F.col("candidate").isNull()).drop("candidate"))


def to_events(lines: DataFrame, size: int = CHUNK) -> DataFrame:
    """Event table of all logs (see to_fields), continuation text included."""
    return events_of(cut(tag_lines(lines, size)), size)


def events_of(tagged: DataFrame, size: int = CHUNK) -> DataFrame:
    fields = cut(to_fields(with_continuations(tagged)))
    return resolve_namespaces(fields, size)


def limit_snapshots(events: DataFrame) -> DataFrame:
    """Limit blocks: 13 metrics each, 0/0 for a metric the block leaves out."""
    blocks = events.filter(F.col("type") == "LIMIT_USAGE_FOR_NS")
    # Without a line break the namespace is the text minus its last character, brackets dropped.
    at = F.instr("text", "\n")
    first = F.when(at > 0, F.substring("text", F.lit(1), at - 1)).otherwise(
        F.substring("text", F.lit(1), F.greatest(F.length("text") - 1, F.lit(0)))
    )
    from spanforge.schema import LIMIT_METRICS

    clean = F.replace(F.replace(F.col("l"), F.lit("******* CLOSE TO LIMIT"), F.lit("")), F.lit(" out of "), F.lit("/"))
    obs = x.labelled_limit(F.ltrim(clean, F.lit(" \t\r")))
    lines = blocks.select(
        "log_id", "event_index", "ts_ns", F.regexp_replace(first, r"[()]", "").alias("namespace"),
        F.posexplode(F.split("text", "\n")).alias("at", "l"),
    )
    read = lines.select("log_id", "event_index", "ts_ns", "namespace", "at", *[obs[n].alias(n) for n in ("metric", "used", "limit")])
    per_metric = read.groupBy("log_id", "event_index", "ts_ns", "namespace").agg(
        *[
            F.max_by(F.struct("used", "limit"), F.when(F.col("metric") == m, F.col("at"))).alias(m)
            for m in LIMIT_METRICS
        ]
    )
    zero = F.lit(0).cast("long")
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.coalesce(F.col(m).getField("used"), zero).alias("used"),
                F.coalesce(F.col(m).getField("limit"), zero).alias("limit"),
            )
            for m in LIMIT_METRICS
        ]
    )
    return per_metric.select("log_id", "event_index", "ts_ns", "namespace", F.explode(rows).alias("r")).select(
        "log_id", "event_index", "ts_ns", "namespace", "r.*"
    )
