"""Column functions that read fields of a trace line. `parts` is the line split on `|`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label of a limit line -> metric.
LIMIT_LABELS = {
    "Number of SOQL queries": "soqlQueries",
    "Number of query rows": "queryRows",
    "Number of SOSL queries": "soslQueries",
    "Number of DML statements": "dmlStatements",
    "Number of Publish Immediate DML": "publishImmediateDml",
    "Number of DML rows": "dmlRows",
    "Maximum CPU time": "cpuTime",
    "Maximum heap size": "heapSize",
    "Number of callouts": "callouts",
    "Number of Email Invocations": "emailInvocations",
    "Number of future calls": "futureCalls",
    "Number of queueable jobs added to the queue": "queueableJobsAddedToQueue",
    "Number of Mobile Apex push calls": "mobileApexPushCalls",
    "SOQL queries": "soqlQueries",
    "SOQL query rows": "queryRows",
    "SOSL queries": "soslQueries",
    "DML statements": "dmlStatements",
    "DML rows": "dmlRows",
    "CPU time in ms": "cpuTime",
    "ms CPU time": "cpuTime",
    "Heap size in bytes": "heapSize",
    "Callouts": "callouts",
    "Email invocations": "emailInvocations",
    "Future calls": "futureCalls",
    "Jobs in queue": "queueableJobsAddedToQueue",
}

# Code of a single-line limit record -> metric.
LIMIT_CODES = {
    "SOQL": "soqlQueries",
    "SOQL_ROWS": "queryRows",
    "SOSL": "soslQueries",
    "DML": "dmlStatements",
    "DML_ROWS": "dmlRows",
}

# Controllers whose page calls have no end line.
ENDLESS_CONTROLLERS = [
    "pagemessagescomponentcontroller",
    "pagemessagecomponentcontroller",
    "severitymessages",
]

_USED_OF = r"(\d+)\s*(?:out of|/)\s*(\d+)"


def part(i: int, parts: str = "parts") -> Column:
    """i-th field, null when the line is shorter."""
    return F.get(F.col(parts), F.lit(i))


def part_or_empty(i: int) -> Column:
    return F.coalesce(part(i), F.lit(""))


def part_or_undefined(i: int) -> Column:
    """i-th field as it shows inside a composed text."""
    return F.coalesce(part(i), F.lit("undefined"))


def after(text: Column, mark: str) -> Column:
    """Text behind the first `mark`; the text from position len(mark) - 1 when it is absent."""
    at = F.instr(text, mark)
    return F.substring(text, at + len(mark), F.length(text))


def ts_ns(time_field: Column) -> Column:
    """Nanoseconds between the parentheses, null when they are missing."""
    start = F.instr(time_field, "(")
    inside = F.substring(time_field, start + 1, F.length(time_field) - start - 1)
    return F.when(start > 0, inside.try_cast("long"))


def line_number(field: Column) -> Column:
    """`[n]` as a number, 0 when absent or external."""
    inside = F.substring(field, F.lit(2), F.length(field) - 2)
    return F.coalesce(inside.try_cast("int"), F.lit(0))


def is_external(field: Column) -> Column:
    return F.coalesce(field == "[EXTERNAL]", F.lit(False))


def wall_clock_ms(line: Column) -> Column:
    """Milliseconds since midnight of `HH:MM:SS.f `, null when the line does not start so."""
    pattern = r"^(\d{1,2}):(\d{2}):(\d{2})\.(\d+)\s"
    at = lambda g: F.regexp_extract(line, pattern, g)
    digits = at(4)
    fraction = F.when(F.length(digits) < 3, F.rpad(digits, 3, "0")).otherwise(digits)
    seconds = at(1).try_cast("long") * 3600 + at(2).try_cast("long") * 60 + at(3).try_cast("long")
    return F.when(line.rlike(pattern), seconds * 1000 + fraction.try_cast("long"))


def event_wall_ms(start_ms: Column, ts: Column, first_ts: Column) -> Column:
    return start_ms + (ts - first_ts) / F.lit(1_000_000)


def rows_of(field: Column) -> Column:
    """`Rows:n`, 0 when the field is empty."""
    return F.coalesce(F.regexp_extract(field, r"Rows:(.*)$", 1).try_cast("long"), F.lit(0))


def bytes_of(field: Column) -> Column:
    """`Bytes:n`, signed, 0 when absent."""
    return F.coalesce(F.regexp_extract(field, r"^Bytes:(-?\d+)", 1).try_cast("long"), F.lit(0))


def object_namespace(text: Column) -> Column:
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "")
        .when(F.instr(text, "__") == 0, "default")
        .otherwise(F.substring_index(text, "__", 1))
    )


def page_namespace(text: Column) -> Column:
    """Between the second `/` and `__`, else `default`."""
    end = F.instr(text, "__")
    first = F.instr(text, "/")
    second = F.length(F.substring_index(text, "/", 2)) + 1
    has_two = F.size(F.split(text, "/")) > 2
    return F.when((end == 0) | (first == 0) | ~has_two, "default").otherwise(
        F.substring(text, second + 1, F.greatest(end - second - 1, F.lit(0)))
    )


def package_ns(text: Column) -> Column:
    return F.substring_index(text, ".", -1)


def code_unit() -> dict[str, Column]:
    """Type, namespace, cpu type and text of a code unit start."""
    filled = lambda i: F.when(part(i) != "", part(i))
    label = F.coalesce(filled(5), filled(4), filled(3), F.lit(""))
    colon, slash = F.instr(label, ":"), F.instr(label, "/")
    sep = F.when(colon > 0, colon).otherwise(slash)
    unit = F.when(sep > 0, F.substring(label, F.lit(1), sep - 1)).otherwise("")
    name = F.coalesce(filled(4), filled(3), F.when(unit != "", unit), F.lit(""))
    dot = F.instr(name, ".")
    # What precedes the first dot, read from behind the scheme.
    scheme = F.instr(name, "apex://") + 7
    apex_ns = F.when(dot > 0, F.substring(name, scheme, F.greatest(dot - scheme, F.lit(0)))).otherwise("default")
    trigger = F.split(part_or_empty(5), "/")
    trigger_ns = F.when(F.size(trigger) == 3, F.get(trigger, F.lit(1))).otherwise("default")
    # Up to and with the last bracket, so a bare call keeps its "(".
    head = F.regexp_extract(name, r"(?s)^(.*\()", 1)
    steps = F.split(F.when(head != "", head).otherwise(name), r"\.")
    two = (F.size(steps) == 2) & ~F.get(steps, F.lit(1)).endswith("(")
    plain_ns = F.when((F.size(steps) == 3) | two, F.get(steps, F.lit(0)))
    ns = (
        F.when(unit == "EventService", object_namespace(F.substring(label, sep + 1, F.length(label))))
        .when(unit.isin("Validation", "Workflow", "Flow"), F.lit(""))
        .when(unit == "VF", page_namespace(name))
        .when(unit == "apex", apex_ns)
        .when(unit == "__sfdc_trigger", trigger_ns)
        .otherwise(plain_ns)
    )
    return {
        "unit_type": unit,
        "text": name,
        "namespace": F.coalesce(F.when(ns != "", ns), F.lit("default")),
        "cpu_type": F.when(unit.isin("Validation", "Workflow", "Flow"), "custom").otherwise("method"),
    }


def method_parts(name: Column) -> dict[str, Column]:
    """Candidate namespace of a method (to look up) and the one its shape alone gives."""
    call = (F.instr(name, "(") > 0) & (F.instr(name, ".") > 0)
    steps = F.split(F.substring_index(name, "(", 1), r"\.")
    return {
        "candidate": F.when(call, F.substring_index(name, ".", 1)),
        "shaped": F.when(call & (F.size(steps) == 4), F.get(steps, F.lit(0))).when(
            call & (F.size(steps) == 2), "default"
        ),
    }


def ctor_parts(name: Column) -> dict[str, Column]:
    steps = F.split(name, r"\.")
    return {
        "candidate": F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", 1)),
        "shaped": F.when(F.size(steps) == 3, F.get(steps, F.lit(0))),
    }


def ctor_text() -> Column:
    """Class name with the arguments from the last bracket on."""
    args = part_or_empty(4)
    tail = F.regexp_extract(args, r"(?s)(\([^(]*)$", 1)
    shown = F.when(args == "", "").when(tail != "", tail).otherwise(F.substring(args, F.length(args), F.lit(1)))
    return F.concat(part_or_undefined(5), shown)


def class_reference_ns(text: Column) -> Column:
    """Namespace of a class reference: what precedes the first dot of a text without `)`."""
    return F.when(~text.endswith(")") & (F.instr(text, ".") > 0), F.substring_index(text, ".", 1))


def plan_fields(text: Column) -> Column:
    """Query plan line as a struct, all null when it is not in plan form."""
    ok = F.instr(text, "],") > 0
    head = F.substring_index(text, "],", 1)
    on = F.instr(head, " on")
    colon = F.instr(head, " :")
    figures = F.split(F.get(F.split(text, r"\],"), F.lit(1)), ",")
    number = lambda i, mark: after(F.get(figures, F.lit(i)), mark)
    names = F.regexp_replace(F.substring(head, F.instr(head, "[") + 1, F.length(head)), r"\s+", "")
    return F.struct(
        F.when(ok, F.substring(head, F.lit(1), on - 1)).alias("leading_op"),
        F.when(ok, F.substring(head, on + 4, F.greatest(colon - on - 4, F.lit(0)))).alias("sobject"),
        F.when(ok, F.when(names == "", F.array().cast("array<string>")).otherwise(F.split(names, ","))).alias("fields"),
        F.when(ok, number(0, "cardinality: ").try_cast("long")).alias("cardinality"),
        F.when(ok, number(1, "sobjectCardinality: ").try_cast("long")).alias("sobject_cardinality"),
        F.when(ok, number(2, "relativeCost ").try_cast("double")).alias("relative_cost"),
    )


def _metric(label: Column, labels: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), label)


def labelled_limit(body: Column) -> dict[str, Column]:
    """`label: n out of m` (or n/m) of a known label."""
    rest = F.substring(body, F.instr(body, ":") + 1, F.length(body))
    metric = F.when(F.instr(body, ":") > 0, _metric(F.trim(F.substring_index(body, ":", 1), F.lit(" \t\r\n")), LIMIT_LABELS))
    known = metric.isNotNull() & rest.rlike(_USED_OF)
    return {
        "metric": F.when(known, metric),
        "used": F.when(known, F.regexp_extract(rest, _USED_OF, 1).try_cast("long")),
        "limit": F.when(known, F.regexp_extract(rest, _USED_OF, 2).try_cast("long")),
        "delta": F.lit(None).cast("long"),
    }


def running_limit(body: Column) -> dict[str, Column]:
    """`n label, total u out of m`: total so far and the rise since the last report."""
    comma = F.instr(body, ",")
    head = F.trim(F.substring_index(body, ",", 1), F.lit(" \t\r\n"))
    rest = F.substring(body, comma + 1, F.length(body))
    counted = head.rlike(r"^\d+\s+.+$")
    label = F.when(counted, F.regexp_extract(head, r"^(\d+)\s+(.+)$", 2)).otherwise(head)
    metric = F.when(comma > 0, _metric(label, LIMIT_LABELS))
    known = metric.isNotNull() & rest.rlike(_USED_OF)
    rise = F.coalesce(F.regexp_extract(head, r"^(\d+)\s+(.+)$", 1).try_cast("long"), F.lit(0))
    return {
        "metric": F.when(known, metric),
        "used": F.when(known, F.regexp_extract(rest, _USED_OF, 1).try_cast("long")),
        "limit": F.when(known, F.regexp_extract(rest, _USED_OF, 2).try_cast("long")),
        "delta": F.when(known, rise),
    }


def coded_limit() -> dict[str, Column]:
    """`CODE|used|limit` of a known code."""
    metric = _metric(part(3), LIMIT_CODES)
    known = metric.isNotNull()
    return {
        "metric": metric,
        "used": F.when(known, F.coalesce(part(4).try_cast("long"), F.lit(0))),
        "limit": F.when(known, F.coalesce(part(5).try_cast("long"), F.lit(0))),
        "delta": F.lit(None).cast("long"),
    }


def page_call() -> dict[str, Column]:
    """Text of a page call and whether it is one of the calls that never end."""
    filled = lambda i: F.when(part(i) != "", part(i))
    cls = F.coalesce(filled(5), filled(3), F.lit(""))
    method = part_or_empty(4)
    lower = F.lower(cls)
    endless = (method == "") & (
        (F.instr(cls, " ") == 0)
        | F.greatest(*[F.instr(lower, c) for c in ENDLESS_CONTROLLERS]).cast("boolean")
    )
    opened = F.instr(method, "(")
    init = F.instr(method, "<init>")
    inside = F.substring(method, opened + 1, F.greatest(F.length(method) - opened - 1, F.lit(0)))
    shown = (
        F.when(method == "", "")
        .when(opened > 0, F.concat(F.lit("."), inside, F.lit("()")))
        .when(init > 0, F.concat(F.substring(method, init + 6, F.length(method)), F.lit("()")))
        .otherwise(F.concat(F.lit("."), method))
    )
    return {"text": F.concat(cls, shown), "endless": endless}


def ruled_text() -> Column:
    """Text by the type's rule (see event_types.TEXTS)."""
    number = F.when(F.col("is_external"), "EXTERNAL").otherwise(F.col("line_number").cast("string"))
    composed = F.array_join(
        F.transform(
            "rule",
            lambda r: F.when(r["field"].isNotNull(), F.coalesce(F.get("parts", r["field"]), F.lit("undefined")))
            .when(
                r["rest"].isNotNull(),
                F.array_join(F.slice("parts", r["rest"] + 1, F.greatest(F.size("parts"), F.lit(1))), " | "),
            )
            .when(r["line"], number)
            .otherwise(r["literal"]),
        ),
        "",
    )
    missing = F.col("single") & (F.size("parts") <= F.get(F.col("rule.field"), F.lit(0)))
    return F.when(missing, "").otherwise(composed)
