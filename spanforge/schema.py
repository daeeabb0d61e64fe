"""Column names and fixed values shared by the operators."""

from __future__ import annotations

# Counter pairs carried by every span as <name>_self and <name>_total.
METRICS = [
    "dml_count",
    "soql_count",
    "sosl_count",
    "dml_rows",
    "soql_rows",
    "sosl_rows",
    "thrown",
    "heap_net",
    "heap_gross",
]

STATEMENT_TYPES = {
    "SOQL_EXECUTE_BEGIN": "SOQL",
    "DML_BEGIN": "DML",
    "SOSL_EXECUTE_BEGIN": "SOSL",
}

# Default limit of each governed metric.
DEFAULT_LIMITS = {
    "soqlQueries": 100,
    "queryRows": 50000,
    "soslQueries": 20,
    "dmlStatements": 150,
    "publishImmediateDml": 150,
    "dmlRows": 10000,
    "cpuTime": 10000,
    "heapSize": 6000000,
    "callouts": 100,
    "emailInvocations": 10,
    "futureCalls": 50,
    "queueableJobsAddedToQueue": 50,
    "mobileApexPushCalls": 10,
}

LIMIT_METRICS = list(DEFAULT_LIMITS)

# The seven span categories in display order.
CATEGORIES = ["Apex", "Code Unit", "System", "Automation", "DML", "SOQL", "Callout"]

SOSL_ROWS_PER_QUERY = 2000

# Rows of one log that a single task may sort at once (see operators/scan.py).
CHUNK = 200_000

KEY = ["log_id", "event_index"]
