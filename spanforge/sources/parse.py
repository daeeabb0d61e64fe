"""The whole path from lines to span, issue and limit tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from spanforge.operators.events import events_of, known_namespaces, limit_snapshots, parse_errors, tag_lines
from spanforge.operators.facts import log_entry_point, log_table
from spanforge.operators.issues import collect_issues, issue_ends
from spanforge.operators.spans import build_spans
from spanforge.operators.times import log_times
from spanforge.schema import CHUNK
from spanforge.session import cut, scratch
from spanforge.sources.logs import debug_levels, log_user


@dataclass
class ParsedLogs:
    """Tables of a set of logs; all keyed by log_id."""

    lines: DataFrame
    events: DataFrame
    spans: DataFrame
    logs: DataFrame
    issues: DataFrame
    parse_errors: DataFrame
    limit_snapshots: DataFrame
    namespaces: DataFrame
    debug_levels: DataFrame
    users: DataFrame


def parse_logs(lines: DataFrame, size: int = CHUNK, header: DataFrame | None = None) -> ParsedLogs:
    """Parse body lines (see sources.logs.read_logs) of many logs at once.

    Settings often stand before the body; `header` are the lines to look for them in, if others than
    `lines`.
    """
    tagged = cut(tag_lines(lines, size))
    with scratch(lines.sparkSession) as keep:
        events = keep(events_of(tagged, size))
    marks = tagged.filter(tagged.role == "max_size").select("log_id", "event_index").distinct()
    spans, structure = build_spans(events, marks, size)
    times = log_times(spans)
    # Looked-up names add nothing new, so the resolved column shows the same set.
    names = known_namespaces(events)
    return ParsedLogs(
        lines=tagged,
        events=events,
        spans=spans,
        logs=log_table(tagged, names, times, log_entry_point(spans)),
        issues=issue_ends(collect_issues(tagged, events, structure), events, times, size),
        parse_errors=parse_errors(tagged),
        limit_snapshots=limit_snapshots(events),
        namespaces=names,
        debug_levels=debug_levels(lines if header is None else header),
        users=log_user(lines),
    )
