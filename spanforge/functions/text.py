"""Column functions over statement and exception texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal and stack-frame patterns of the trace texts.
SOQL_LITERAL = r"'(?:[^']|'')*'|\b\d+\b"
STACK_FRAME = r"(?:Class|Trigger|AnonymousBlock|External entry point)[.:]"


def without_parentheses(text: Column) -> Column:
    """Blank out parenthesised parts, innermost first, however deep they nest."""
    opens = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    return F.when(opens > 0, F.aggregate(
        F.sequence(F.lit(1), F.greatest(opens, F.lit(1))),
        text,
        lambda acc, _: F.regexp_replace(acc, r"\([^()]*\)", " "),
    )).otherwise(text)


def from_object(query: Column) -> Column:
    """Object after the outer FROM, null when there is none."""
    found = F.regexp_extract(without_parentheses(query), r"(?i)\bFROM\s+([A-Za-z0-9_]+)", 1)
    return F.when(found != "", found)


def soql_shape(query: Column) -> Column:
    return F.regexp_replace(query, SOQL_LITERAL, "?")


def dml_operation(text: Column) -> Column:
    op = F.regexp_extract(text, r"\bOp:(\w+)", 1)
    return F.when(op != "", op).otherwise("DML")


def split_issue(text: Column) -> tuple[Column, Column]:
    """First line, and the rest."""
    at = F.instr(text, "\n")
    first = F.trim(F.when(at == 0, text).otherwise(F.substring(text, F.lit(1), at - 1)))
    rest = F.when(at == 0, F.lit("")).otherwise(F.trim(F.substring(text, at + 1, F.length(text)), F.lit(" \n\r\t")))
    return F.trim(first, F.lit(" \n\r\t")), rest


def split_exception(text: Column) -> tuple[Column, Column]:
    """Head of an exception text and its innermost stack frame ('' when there is no stack)."""
    blank = F.lit(" \n\r\t")
    head = F.regexp_extract(text, rf"(?s)^(.+?)(?={STACK_FRAME})", 1)
    frame = F.regexp_extract(text, rf"(?s)^.+?({STACK_FRAME}[^\n]*)", 1)
    has = head != ""
    return (
        F.trim(F.when(has, head).otherwise(text), blank),
        F.when(has, F.trim(frame, blank)).otherwise(""),
    )


def skipped_bytes(text: Column) -> Column:
    figure = F.regexp_extract(text, r"(?i)Skipped\s+([\d,]+)\s+bytes", 1)
    return F.coalesce(F.replace(figure, F.lit(","), F.lit("")).try_cast("long"), F.lit(0))


def event_label(text: Column, kind: Column, suffix: Column) -> Column:
    """Display name: bare texts (empty, booleans, integers) are prefixed by the type."""
    name = F.concat(text, F.coalesce(suffix, F.lit("")))
    bare = (text == "") | text.isin("true", "false") | text.rlike(r"^-?\d+$")
    prefixed = F.when(name != "", F.concat(kind, F.lit(": "), name)).otherwise(kind)
    return F.when(~bare | (text == kind), name).otherwise(prefixed)


# ---- clause-level tests of a query text --------------------------------------------------------

_CLAUSES = ["WHERE", "WITH", "GROUP BY", "HAVING", "ORDER BY", "LIMIT", "OFFSET", "ALL ROWS", "FOR", "UPDATE", "USING"]


def _flat(query: Column) -> Column:
    """Outer level of a query: string literals reduced to their quotes and leading wildcard,
    white space collapsed, nested parentheses blanked."""
    kept = F.regexp_replace(query, r"'(%?)(?:[^'\\]|\\.)*'", "'$1'")
    return F.regexp_replace(kept, r"\s+", " ")


def conditions(query: Column) -> Column:
    """The conditions directly under the outer WHERE, without nested groups."""
    outer = without_parentheses(_flat(query))
    ends = "|".join(c.replace(" ", r"\s+") for c in _CLAUSES if c != "WHERE")
    found = F.regexp_extract(outer, rf"(?is)\bWHERE\b(.*?)(?=\b(?:{ends})\b|$)", 1)
    return F.when(outer.rlike(r"(?is)\bWHERE\b"), found)


def query_traits(query: Column) -> dict[str, Column]:
    """Shape tests of a query: its clauses, limit value, single object, plain select list."""
    outer = without_parentheses(_flat(query))
    has = lambda words: outer.rlike(rf"(?is)\b{words}\b")
    selected = F.regexp_extract(_flat(query), r"(?is)^\s*SELECT\s+(.*?)\s+FROM\b", 1)
    sources = F.regexp_extract(
        outer, r"(?is)\bFROM\s+(.*?)(?=\b(?:WHERE|WITH|GROUP BY|ORDER BY|LIMIT|OFFSET|ALL ROWS|FOR|UPDATE|USING)\b|$)", 1
    )
    limit = F.regexp_extract(outer, r"(?is)\bLIMIT\s+(\d+)", 1)
    bound = F.regexp_extract(outer, r"(?is)\bLIMIT\s+(:\s*[\w.]+)", 1)
    return {
        "is_simple_select": ~selected.rlike(r"[()]") & ~selected.rlike(r"(?is)\bTYPEOF\b"),
        "is_trivial": ~(
            has(r"USING\s+SCOPE") | has("WITH") | has(r"GROUP\s+BY") | has("OFFSET")
            | has(r"ALL\s+ROWS") | has(r"FOR\s+(?:VIEW|UPDATE|REFERENCE)")
            | has(r"UPDATE\s+(?:TRACKING|VIEWSTAT)")
        ),
        "is_ordered": has(r"ORDER\s+BY"),
        "limit_value": F.when(limit != "", limit).when(bound != "", F.regexp_replace(bound, r"\s", "")),
        "from_object": F.when(
            (sources != "") & ~sources.contains(","), F.regexp_extract(sources, r"^\s*([\w.]+)", 1)
        ),
    }


# Rule id, severity, summary code of the query checks, in report order.
LINT_RULES = [
    ("unbounded", "Warning"),
    ("leading_wildcard", "Warning"),
    ("negative_operator", "Warning"),
    ("order_without_limit", "Info"),
    ("last_modified_upper_bound", "Info"),
    ("in_trigger", "Warning"),
]


def lint_columns(query: Column, in_trigger: Column) -> dict[str, Column]:
    """One boolean per check. Only conditions directly under WHERE count, as in the grammar."""
    outer = without_parentheses(_flat(query))
    where = conditions(query)
    under = F.coalesce(where, F.lit(""))
    limited = outer.rlike(r"(?is)\bLIMIT\b")
    return {
        "unbounded": where.isNull() & ~limited,
        "leading_wildcard": under.rlike(r"(?is)\bLIKE\s+'%"),
        "negative_operator": under.rlike(r"(?is)!=|<>|\bNOT\b|\bEXCLUDES\b"),
        "order_without_limit": outer.rlike(r"(?is)\bORDER\s+BY\b") & ~limited,
        "last_modified_upper_bound": under.rlike(r"(?is)\b[\w.]*lastmodifieddate\s*<(?![=>])"),
        "in_trigger": in_trigger,
    }
