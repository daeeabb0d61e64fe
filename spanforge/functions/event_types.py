"""Event types of the trace format: which open a span, which close one, how their text is built.

The tables below are fixed values of the format. What follows from a name is derived from it: a
`..._BEGIN` ends at `..._END`, an `..._ENTRY` at `..._EXIT`, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Span types by (category, cpu type).
SPANS = {
    ("Callout", "free"): """
        CALLOUT_REQUEST
    """,
    ("Code Unit", "custom"): """
        CODE_UNIT_STARTED
    """,
    ("Apex", "method"): """
        CONSTRUCTOR_ENTRY EXECUTION_STARTED FORMULA_EVALUATE_BEGIN METHOD_ENTRY
        ORG_CACHE_GET_BEGIN ORG_CACHE_PUT_BEGIN ORG_CACHE_REMOVE_BEGIN
        SESSION_CACHE_GET_BEGIN SESSION_CACHE_PUT_BEGIN SESSION_CACHE_REMOVE_BEGIN
        VF_APEX_CALL_START VF_DESERIALIZE_CONTINUATION_STATE_BEGIN
        VF_SERIALIZE_CONTINUATION_STATE_BEGIN
    """,
    ("System", "system"): """
        CUMULATIVE_LIMIT_USAGE
    """,
    ("System", "custom"): """
        CUMULATIVE_PROFILING_BEGIN DUPLICATE_DETECTION_BEGIN VF_EVALUATE_FORMULA_BEGIN
    """,
    ("SOQL", "method"): """
        CURSOR_CREATE_BEGIN
    """,
    ("DML", "free"): """
        DML_BEGIN
    """,
    ("Apex", "pkg"): """
        ENTERING_MANAGED_PKG
    """,
    ("Automation", "custom"): """
        EVENT_SERVICE_PUB_BEGIN EVENT_SERVICE_SUB_BEGIN FLOW_BULK_ELEMENT_BEGIN
        FLOW_ELEMENT_BEGIN FLOW_START_INTERVIEWS_BEGIN FLOW_START_INTERVIEW_BEGIN
        WF_APPROVAL WF_APPROVAL_SUBMIT WF_CRITERIA_BEGIN WF_EMAIL_ALERT WF_EMAIL_SENT
        WF_EVAL_ENTRY_CRITERIA WF_FIELD_UPDATE WF_FORMULA WF_NEXT_APPROVER WF_PROCESS_FOUND
        WF_PROCESS_NODE WF_RULE_EVAL_BEGIN WF_RULE_INVOCATION
    """,
    ("System", "method"): """
        MATCH_ENGINE_BEGIN RLM_CONFIGURATOR_BEGIN RLM_PRICING_BEGIN SYSTEM_CONSTRUCTOR_ENTRY
        SYSTEM_METHOD_ENTRY VF_DESERIALIZE_VIEWSTATE_BEGIN VF_SERIALIZE_VIEWSTATE_BEGIN
    """,
    ("Automation", "method"): """
        NBA_NODE_BEGIN NBA_STRATEGY_BEGIN
    """,
    ("SOQL", "custom"): """
        QUERY_MORE_BEGIN
    """,
    ("SOQL", "free"): """
        SOQL_EXECUTE_BEGIN SOSL_EXECUTE_BEGIN
    """,
}

# Types with fields of their own by (debug category, level).
LEVELS = {
    ("ApexCode", "Debug"): """
        PUSH_NOTIFICATION_NO_DEVICES PUSH_NOTIFICATION_SENT USER_DEBUG
    """,
    ("ApexCode", "Error"): """
        CODE_UNIT_FINISHED CODE_UNIT_STARTED EXECUTION_STARTED FATAL_ERROR
        PUSH_NOTIFICATION_INVALID_APP PUSH_NOTIFICATION_INVALID_CERTIFICATE
        PUSH_NOTIFICATION_INVALID_NOTIFICATION USER_INFO
    """,
    ("ApexCode", "Fine"): """
        CONSTRUCTOR_ENTRY CONSTRUCTOR_EXIT ENTERING_MANAGED_PKG METHOD_ENTRY METHOD_EXIT
    """,
    ("ApexCode", "Finer"): """
        FORMULA_EVALUATE_BEGIN HEAP_ALLOCATE HEAP_DEALLOCATE STATEMENT_EXECUTE
    """,
    ("ApexCode", "Finest"): """
        BULK_HEAP_ALLOCATE VARIABLE_ASSIGNMENT VARIABLE_SCOPE_BEGIN
    """,
    ("ApexCode", "Info"): """
        EMAIL_QUEUE EXCEPTION_THROWN ORG_CACHE_GET_BEGIN ORG_CACHE_PUT_BEGIN
        ORG_CACHE_REMOVE_BEGIN SESSION_CACHE_GET_BEGIN SESSION_CACHE_PUT_BEGIN
        SESSION_CACHE_REMOVE_BEGIN VF_PAGE_MESSAGE
    """,
    ("ApexProfiling", "Fine"): """
        CUMULATIVE_PROFILING CUMULATIVE_PROFILING_BEGIN STACK_FRAME_VARIABLE_LIST
        STATIC_VARIABLE_LIST TOTAL_EMAIL_RECIPIENTS_QUEUED
    """,
    ("ApexProfiling", "Finest"): """
        LIMIT_USAGE LIMIT_USAGE_FOR_NS
    """,
    ("ApexProfiling", "Info"): """
        CUMULATIVE_LIMIT_USAGE TESTING_LIMITS
    """,
    ("Callout", "Error"): """
        XDS_RESPONSE_ERROR
    """,
    ("Callout", "Finer"): """
        NAMED_CREDENTIAL_RESPONSE_DETAIL XDS_DETAIL XDS_RESPONSE_DETAIL
    """,
    ("Callout", "Info"): """
        CALLOUT_REQUEST CALLOUT_RESPONSE NAMED_CREDENTIAL_REQUEST NAMED_CREDENTIAL_RESPONSE
        XDS_RESPONSE
    """,
    ("Database", "Finest"): """
        IDEAS_QUERY_EXECUTE SOQL_EXECUTE_EXPLAIN
    """,
    ("Database", "Info"): """
        BULK_DML_RETRY CURSOR_CREATE_BEGIN DML_BEGIN DML_END QUERY_MORE_BEGIN QUERY_MORE_END
        QUERY_MORE_ITERATIONS SAVEPOINT_ROLLBACK SAVEPOINT_SET SOQL_EXECUTE_BEGIN
        SOQL_EXECUTE_END SOSL_EXECUTE_BEGIN SOSL_EXECUTE_END
    """,
    ("NBA", "Error"): """
        NBA_NODE_ERROR NBA_STRATEGY_ERROR
    """,
    ("NBA", "Fine"): """
        NBA_NODE_BEGIN NBA_NODE_DETAIL NBA_NODE_END NBA_OFFER_INVALID NBA_STRATEGY_BEGIN
        NBA_STRATEGY_END
    """,
    ("System", "Debug"): """
        DUPLICATE_DETECTION_MATCH_INVOCATION_DETAILS
    """,
    ("System", "Fine"): """
        RLM_CONFIGURATOR_BEGIN RLM_PRICING_BEGIN SYSTEM_CONSTRUCTOR_ENTRY
        SYSTEM_CONSTRUCTOR_EXIT SYSTEM_METHOD_ENTRY SYSTEM_METHOD_EXIT
    """,
    ("System", "Info"): """
        DUPLICATE_DETECTION_BEGIN DUPLICATE_DETECTION_MATCH_INVOCATION_SUMMARY
        DUPLICATE_DETECTION_RULE_INVOCATION MATCH_ENGINE_BEGIN POP_TRACE_FLAGS
        PUSH_TRACE_FLAGS SYSTEM_MODE_ENTER SYSTEM_MODE_EXIT
    """,
    ("Validation", "Info"): """
        VALIDATION_ERROR VALIDATION_FORMULA VALIDATION_PASS VALIDATION_RULE
    """,
    ("Visualforce", "Fine"): """
        VF_APEX_CALL_END VF_APEX_CALL_START
    """,
    ("Visualforce", "Finer"): """
        VF_EVALUATE_FORMULA_BEGIN VF_EVALUATE_FORMULA_END
    """,
    ("Visualforce", "Info"): """
        VF_DESERIALIZE_CONTINUATION_STATE_BEGIN VF_DESERIALIZE_VIEWSTATE_BEGIN
        VF_SERIALIZE_CONTINUATION_STATE_BEGIN VF_SERIALIZE_VIEWSTATE_BEGIN
    """,
    ("Workflow", "Error"): """
        FLOW_CREATE_INTERVIEW_ERROR FLOW_ELEMENT_ERROR FLOW_START_INTERVIEWS_ERROR
        WF_FLOW_ACTION_ERROR WF_FLOW_ACTION_ERROR_DETAIL
    """,
    ("Workflow", "Fine"): """
        FLOW_BULK_ELEMENT_BEGIN FLOW_ELEMENT_BEGIN FLOW_ELEMENT_DEFERRED
        WF_FLOW_ACTION_DETAIL
    """,
    ("Workflow", "Finer"): """
        EVENT_SERVICE_PUB_DETAIL EVENT_SERVICE_SUB_DETAIL FLOW_ACTIONCALL_DETAIL
        FLOW_ASSIGNMENT_DETAIL FLOW_BULK_ELEMENT_DETAIL FLOW_BULK_ELEMENT_LIMIT_USAGE
        FLOW_ELEMENT_LIMIT_USAGE FLOW_INTERVIEW_FINISHED_LIMIT_USAGE FLOW_LOOP_DETAIL
        FLOW_RULE_DETAIL FLOW_START_INTERVIEW_LIMIT_USAGE FLOW_SUBFLOW_DETAIL
        FLOW_VALUE_ASSIGNMENT FLOW_WAIT_EVENT_RESUMING_DETAIL FLOW_WAIT_EVENT_WAITING_DETAIL
        FLOW_WAIT_RESUMING_DETAIL FLOW_WAIT_WAITING_DETAIL
    """,
    ("Workflow", "Info"): """
        EVENT_SERVICE_PUB_BEGIN EVENT_SERVICE_PUB_END EVENT_SERVICE_SUB_BEGIN
        EVENT_SERVICE_SUB_END FLOW_BULK_ELEMENT_NOT_SUPPORTED FLOW_INTERVIEW_FINISHED
        FLOW_INTERVIEW_PAUSED FLOW_INTERVIEW_RESUMED FLOW_START_INTERVIEWS_BEGIN
        FLOW_START_INTERVIEW_BEGIN FLOW_START_SCHEDULED_RECORDS SLA_END SLA_EVAL_MILESTONE
        SLA_PROCESS_CASE WF_ACTION WF_ACTIONS_END WF_ACTION_TASK WF_APPROVAL
        WF_APPROVAL_REMOVE WF_APPROVAL_SUBMIT WF_APPROVAL_SUBMITTER WF_ASSIGN
        WF_CRITERIA_BEGIN WF_EMAIL_ALERT WF_EMAIL_SENT WF_ENQUEUE_ACTIONS
        WF_ESCALATION_ACTION WF_EVAL_ENTRY_CRITERIA WF_FIELD_UPDATE WF_FORMULA
        WF_NEXT_APPROVER WF_OUTBOUND_MSG WF_PROCESS_FOUND WF_PROCESS_NODE WF_REASSIGN_RECORD
        WF_RESPONSE_NOTIFY WF_RULE_ENTRY_ORDER WF_RULE_EVAL_BEGIN WF_RULE_EVAL_VALUE
        WF_RULE_FILTER WF_RULE_INVOCATION WF_SOFT_REJECT WF_SPOOL_ACTION_BEGIN
        WF_TIME_TRIGGER
    """,
    ("Workflow", "Warn"): """
        FLOW_ELEMENT_FAULT
    """,
}

# Detail types without a text of their own.
PLAIN_DETAILS = """
    ADD_SCREEN_POP_ACTION ADD_SKILL_REQUIREMENT_ACTION AE_PERSIST_VALIDATION
    APP_ANALYTICS_ERROR APP_ANALYTICS_FINE APP_ANALYTICS_WARN APP_CONTAINER_INITIATED
    ASSET_DIFF_DETAIL ASSET_DIFF_SUMMARY BULK_COUNTABLE_STATEMENT_EXECUTE
    CALLOUT_REQUEST_FINALIZE CALLOUT_REQUEST_PREPARE CURSOR_FETCH CURSOR_FETCH_PAGE
    DATA_ACCESS_EVALUATION DATAWEAVE_USER_DEBUG DUPLICATE_RULE_FILTER
    DUPLICATE_RULE_FILTER_INVOCATION DUPLICATE_RULE_FILTER_RESULT
    DUPLICATE_RULE_FILTER_VALUE END_CALL EXTERNAL_SERVICE_CALLBACK EXTERNAL_SERVICE_REQUEST
    EXTERNAL_SERVICE_RESPONSE FLOW_COLLECTION_PROCESSOR_DETAIL FLOW_CREATE_INTERVIEW_BEGIN
    FLOW_CREATE_INTERVIEW_END FLOW_SCHEDULED_PATH_QUEUED FLOW_SCREEN_DETAIL
    FOR_UPDATE_LOCKS_RELEASE FORMULA_BUILD FUNCTION_INVOCATION_REQUEST
    FUNCTION_INVOCATION_RESPONSE HEAP_DUMP INVOCABLE_ACTION_DETAIL INVOCABLE_ACTION_ERROR
    JSON_DIFF_DETAIL JSON_DIFF_SUMMARY MATCH_ENGINE_INVOCATION ORG_CACHE_CONTAINS
    ORG_CACHE_GET ORG_CACHE_GET_CAPACITY ORG_CACHE_GET_PARTITION ORG_CACHE_MEMORY_USAGE
    ORG_CACHE_PUT ORG_CACHE_REMOVE PLAY_PROMPT
    POLICY_RULE_DEFINITION_CONDITION_EVALUATION_RESPONSE POLICY_RULE_EVALUATION_REQUEST
    POLICY_RULE_EVALUATION_RESPONSE POLICY_RULE_EVALUATION_SKIPPED
    POLICY_RULE_EVALUATION_START PUSH_NOTIFICATION_INVALID_CONFIGURATION
    PUSH_NOTIFICATION_INVALID_PAYLOAD PUSH_NOTIFICATION_NOT_ENABLED QUERY_SQL_LOG
    REFERENCED_OBJECT_LIST RLM_CONFIGURATOR_DEPLOY RLM_CONFIGURATOR_STATS ROUTE_WORK_ACTION
    RULES_EXECUTION_DETAIL RULES_EXECUTION_SUMMARY SAVEPOINT_RELEASE SAVEPOINT_RESET
    SCHEDULED_FLOW_DETAIL SCRIPT_EXECUTION SESSION_CACHE_CONTAINS SESSION_CACHE_GET
    SESSION_CACHE_GET_CAPACITY SESSION_CACHE_GET_PARTITION SESSION_CACHE_MEMORY_USAGE
    SESSION_CACHE_PUT SESSION_CACHE_REMOVE SLA_CASE_MILESTONE SLA_NULL_START_DATE
    TEMPLATE_PROCESSING_ERROR TEMPLATED_ASSET TRANSFORMATION_SUMMARY USER_DEBUG_DEBUG
    USER_DEBUG_ERROR USER_DEBUG_FINE USER_DEBUG_FINER USER_DEBUG_FINEST USER_DEBUG_INFO
    USER_DEBUG_WARN USER_MODE_PERMSET_APPLIED VALIDATION_FAIL VARIABLE_SCOPE_END
    VF_APEX_CALL WAVE_APP_LIFECYCLE WF_APEX_ACTION WF_CHATTER_POST WF_ESCALATION_RULE
    WF_FLOW_ACTION_BEGIN WF_FLOW_ACTION_END WF_HARD_REJECT WF_KNOWLEDGE_ACTION
    WF_NO_PROCESS_FOUND WF_QUICK_CREATE WF_SEND_ACTION WF_TIME_TRIGGERS_BEGIN
    XDS_REQUEST_DETAIL
"""

# Flags.
ACCEPTS_TEXT = """
    CUMULATIVE_PROFILING EMAIL_QUEUE EXCEPTION_THROWN FATAL_ERROR FLOW_ELEMENT_ERROR
    FLOW_START_INTERVIEWS_ERROR FLOW_VALUE_ASSIGNMENT LIMIT_USAGE_FOR_NS
    STACK_FRAME_VARIABLE_LIST STATIC_VARIABLE_LIST TESTING_LIMITS USER_DEBUG
    VALIDATION_ERROR VALIDATION_FORMULA VF_PAGE_MESSAGE WF_FLOW_ACTION_ERROR
    WF_FLOW_ACTION_ERROR_DETAIL WF_FORMULA WF_RULE_FILTER
"""
HAS_LINE_NUMBER = """
    CALLOUT_REQUEST CALLOUT_RESPONSE CONSTRUCTOR_ENTRY CONSTRUCTOR_EXIT DML_BEGIN DML_END
    EMAIL_QUEUE EXCEPTION_THROWN HEAP_ALLOCATE HEAP_DEALLOCATE IDEAS_QUERY_EXECUTE
    LIMIT_USAGE METHOD_ENTRY METHOD_EXIT POP_TRACE_FLAGS PUSH_TRACE_FLAGS QUERY_MORE_BEGIN
    QUERY_MORE_END QUERY_MORE_ITERATIONS SAVEPOINT_ROLLBACK SAVEPOINT_SET SOQL_EXECUTE_BEGIN
    SOQL_EXECUTE_END SOQL_EXECUTE_EXPLAIN SOSL_EXECUTE_BEGIN SOSL_EXECUTE_END
    STATEMENT_EXECUTE SYSTEM_CONSTRUCTOR_ENTRY SYSTEM_CONSTRUCTOR_EXIT SYSTEM_METHOD_ENTRY
    SYSTEM_METHOD_EXIT USER_DEBUG USER_INFO VARIABLE_ASSIGNMENT VARIABLE_SCOPE_BEGIN
    VF_APEX_CALL_START
"""
DEFAULT_NAMESPACE = """
    CUMULATIVE_LIMIT_USAGE CUMULATIVE_PROFILING CUMULATIVE_PROFILING_BEGIN DML_BEGIN
    EXECUTION_STARTED LIMIT_USAGE LIMIT_USAGE_FOR_NS
"""
ENDS_AT_NEXT = """
    WF_APPROVAL WF_APPROVAL_SUBMIT WF_EMAIL_ALERT WF_EMAIL_SENT WF_EVAL_ENTRY_CRITERIA
    WF_FIELD_UPDATE WF_FORMULA WF_NEXT_APPROVER WF_PROCESS_FOUND WF_PROCESS_NODE
    WF_RULE_INVOCATION
"""

# Ends that do not follow from the name of the span type.
OTHER_ENDS = {
    "CALLOUT_REQUEST": ["CALLOUT_RESPONSE"],
    "CUMULATIVE_LIMIT_USAGE": ["CUMULATIVE_LIMIT_USAGE_END"],
    "ENTERING_MANAGED_PKG": [],
    "VF_DESERIALIZE_CONTINUATION_STATE_BEGIN": ["VF_SERIALIZE_CONTINUATION_STATE_END"],
    "WF_CRITERIA_BEGIN": ["WF_CRITERIA_END", "WF_RULE_NOT_EVALUATED"],
}
UNPAIRED_ENDS = ["VF_DESERIALIZE_CONTINUATION_STATE_END"]
UNWINDS = ["EXCEPTION_THROWN", "FATAL_ERROR"]

# Display text by type. {n} is the n-th field of the line (the type is field 1),
# {n*} the fields from the n-th on joined by " | ", {line} the line number.
TEXTS = {
    "{2}": """
        BULK_DML_RETRY BULK_HEAP_ALLOCATE CODE_UNIT_FINISHED EVENT_SERVICE_PUB_BEGIN
        EVENT_SERVICE_PUB_END FATAL_ERROR FLOW_BULK_ELEMENT_LIMIT_USAGE FLOW_ELEMENT_LIMIT_USAGE
        FLOW_INTERVIEW_FINISHED_LIMIT_USAGE FLOW_START_INTERVIEW_LIMIT_USAGE LIMIT_USAGE_FOR_NS
        NAMED_CREDENTIAL_RESPONSE SLA_EVAL_MILESTONE SLA_PROCESS_CASE SYSTEM_MODE_ENTER
        SYSTEM_MODE_EXIT TOTAL_EMAIL_RECIPIENTS_QUEUED VALIDATION_ERROR VF_APEX_CALL_END
        VF_EVALUATE_FORMULA_END VF_PAGE_MESSAGE WF_ACTION WF_ACTIONS_END WF_APPROVAL_REMOVE
        WF_APPROVAL_SUBMIT WF_ENQUEUE_ACTIONS WF_PROCESS_NODE WF_RULE_ENTRY_ORDER
        WF_RULE_EVAL_BEGIN WF_RULE_EVAL_VALUE WF_RULE_FILTER WF_RULE_INVOCATION WF_SOFT_REJECT
        WF_SPOOL_ACTION_BEGIN XDS_DETAIL XDS_RESPONSE_DETAIL XDS_RESPONSE_ERROR
    """,
    "{3}": """
        CALLOUT_REQUEST CALLOUT_RESPONSE EXCEPTION_THROWN FLOW_INTERVIEW_FINISHED
        FLOW_START_INTERVIEW_BEGIN HEAP_ALLOCATE SOQL_EXECUTE_EXPLAIN SYSTEM_CONSTRUCTOR_ENTRY
        SYSTEM_METHOD_ENTRY VALIDATION_PASS VALIDATION_RULE VF_EVALUATE_FORMULA_BEGIN
    """,
    "{4}": "SOQL_EXECUTE_BEGIN",
    "{2*}": """
        DUPLICATE_DETECTION_MATCH_INVOCATION_DETAILS DUPLICATE_DETECTION_MATCH_INVOCATION_SUMMARY
        NBA_NODE_BEGIN NBA_NODE_DETAIL NBA_NODE_END NBA_NODE_ERROR NBA_OFFER_INVALID
        NBA_STRATEGY_BEGIN NBA_STRATEGY_END NBA_STRATEGY_ERROR
    """,
    "{3*}": "USER_DEBUG VARIABLE_ASSIGNMENT VARIABLE_SCOPE_BEGIN",
    "{2} {3}": "EVENT_SERVICE_SUB_BEGIN EVENT_SERVICE_SUB_END FLOW_ELEMENT_DEFERRED",
    "{3} {4}": "FLOW_ELEMENT_BEGIN FLOW_VALUE_ASSIGNMENT USER_INFO",
    "{2} {3} {4}": "EVENT_SERVICE_PUB_DETAIL",
    "{2} {3} {4} {6} {6}": "EVENT_SERVICE_SUB_DETAIL",
    "{1} {4}": "WF_FLOW_ACTION_ERROR",
    "{1} {2}": "WF_FLOW_ACTION_ERROR_DETAIL",
    " {2} {3} {4} {5} {6}": "WF_FIELD_UPDATE",
    "{2} : {3}": """
        FLOW_INTERVIEW_RESUMED FLOW_START_SCHEDULED_RECORDS WF_ASSIGN WF_ESCALATION_ACTION
        WF_FORMULA WF_PROCESS_FOUND WF_REASSIGN_RECORD
    """,
    "{2} : {3} : {4}": """
        FLOW_BULK_ELEMENT_DETAIL FLOW_BULK_ELEMENT_NOT_SUPPORTED FLOW_ELEMENT_FAULT
        FLOW_INTERVIEW_PAUSED FLOW_WAIT_RESUMING_DETAIL WF_APPROVAL WF_APPROVAL_SUBMITTER
        WF_EMAIL_ALERT WF_EMAIL_SENT WF_EVAL_ENTRY_CRITERIA WF_NEXT_APPROVER
    """,
    "{2} : {3} : {4} : {5}": """
        FLOW_CREATE_INTERVIEW_ERROR FLOW_SUBFLOW_DETAIL FLOW_WAIT_EVENT_RESUMING_DETAIL
        FLOW_WAIT_WAITING_DETAIL WF_OUTBOUND_MSG WF_RESPONSE_NOTIFY WF_TIME_TRIGGER
    """,
    "{2} : {3} : {4} : {5} : {6}": "FLOW_WAIT_EVENT_WAITING_DETAIL SLA_END XDS_RESPONSE",
    "{2} : {3} : {4} : {5} : {6} : {7}": "WF_ACTION_TASK",
    "{3} : {4}": "FLOW_LOOP_DETAIL FLOW_RULE_DETAIL",
    "{3} : {4} : {5}": "FLOW_ASSIGNMENT_DETAIL",
    "{3} : {4} : {5} : {6}": "FLOW_ACTIONCALL_DETAIL NAMED_CREDENTIAL_REQUEST",
    "{3} : {4} {5} : {6} {7}": "NAMED_CREDENTIAL_RESPONSE_DETAIL",
    "{2} - {3}": "FLOW_BULK_ELEMENT_BEGIN",
    "{2} - {4}": "FLOW_START_INTERVIEWS_ERROR",
    "{3} - {4}": "DUPLICATE_DETECTION_RULE_INVOCATION",
    "{2}.{3}": """
        PUSH_NOTIFICATION_INVALID_APP PUSH_NOTIFICATION_INVALID_CERTIFICATE
        PUSH_NOTIFICATION_NO_DEVICES
    """,
    "{2}.{3} : {4} : {5} : {6} : {7} : {8}": "PUSH_NOTIFICATION_INVALID_NOTIFICATION",
    "{2}.{3} : {4} : {5} : {6} : {7}": "PUSH_NOTIFICATION_SENT",
    "WF_CRITERIA : {5} : {3}": "WF_CRITERIA_BEGIN",
    "SOSL: {3}": "SOSL_EXECUTE_BEGIN",
    "DML {3} {4}": "DML_BEGIN",
    "{3} {4} out of {5}": "LIMIT_USAGE",
    "{4}, line:{line} - {5}": "POP_TRACE_FLAGS PUSH_TRACE_FLAGS",
    "line: {line}": "QUERY_MORE_BEGIN QUERY_MORE_END",
    "line: {line}, iterations:{3}": "QUERY_MORE_ITERATIONS",
    "{3}, line: {line}": "SAVEPOINT_ROLLBACK SAVEPOINT_SET",
}

# What is added to a bare name.
SUFFIXES = {
    "CONSTRUCTOR_ENTRY": " (constructor)",
    "SYSTEM_CONSTRUCTOR_ENTRY": " (system constructor)",
    "CODE_UNIT_STARTED": " (code unit)",
    "VF_APEX_CALL_START": " (VF APEX)",
    "VF_EVALUATE_FORMULA_BEGIN": " (VF FORMULA)",
    "ENTERING_MANAGED_PKG": " (managed package)",
    "FLOW_START_INTERVIEW_BEGIN": " (flow)",
}

_NAME_RULES = [("_ENTRY", "_EXIT"), ("_BEGIN", "_END"), ("_STARTED", "_FINISHED"), ("_START", "_END")]


def _words(text: str) -> list[str]:
    return text.split()


def ends_of(name: str) -> list[str]:
    """Types that end a span of type `name`."""
    if name in _words(ENDS_AT_NEXT):
        return [name]
    if name in OTHER_ENDS:
        return OTHER_ENDS[name]
    for start, end in _NAME_RULES:
        if name.endswith(start):
            return [name.removesuffix(start) + end]
    return []


def _rule(template: str) -> list[tuple[int | None, int | None, bool, str]]:
    """Template as (field, first field of a joined rest, line number?, literal) pieces."""
    pieces: list[tuple[int | None, int | None, bool, str]] = []
    while template:
        literal, _, rest = template.partition("{")
        if literal:
            pieces.append((None, None, False, literal))
        field, _, template = rest.partition("}")
        if field == "line":
            pieces.append((None, None, True, ""))
        elif field.endswith("*"):
            pieces.append((None, int(field[:-1]), False, ""))
        elif field:
            pieces.append((int(field), None, False, ""))
    return pieces


SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType(), False),
        T.StructField("kind", T.StringType()),
        T.StructField("ends", T.ArrayType(T.StringType(), False)),
        T.StructField("category", T.StringType()),
        T.StructField("cpu_type", T.StringType()),
        T.StructField("debug_category", T.StringType()),
        T.StructField("debug_level", T.StringType()),
        T.StructField("accepts_text", T.BooleanType()),
        T.StructField("has_line", T.BooleanType()),
        T.StructField("preset_ns", T.BooleanType()),
        T.StructField("is_exit", T.BooleanType()),
        T.StructField("ends_at_next", T.BooleanType()),
        T.StructField("discontinuity", T.BooleanType()),
        T.StructField("type_suffix", T.StringType()),
        T.StructField("single", T.BooleanType()),
        T.StructField(
            "rule",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("field", T.IntegerType()),
                        T.StructField("rest", T.IntegerType()),
                        T.StructField("line", T.BooleanType()),
                        T.StructField("literal", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def rows() -> list[tuple]:
    """The dimension, one row per known type."""
    spans = {t: key for key, names in SPANS.items() for t in _words(names)}
    levels = {t: key for key, names in LEVELS.items() for t in _words(names)}
    ends = [e for t in spans for e in ends_of(t)] + UNPAIRED_ENDS
    known = dict.fromkeys([*levels, *_words(PLAIN_DETAILS), *ends])
    texts = {t: template for template, names in TEXTS.items() for t in _words(names)}
    pseudo = set(_words(ENDS_AT_NEXT))
    sets = [set(_words(s)) for s in (ACCEPTS_TEXT, HAS_LINE_NUMBER, DEFAULT_NAMESPACE)]
    out = []
    for t in known:
        category, cpu = spans.get(t, ("", ""))
        debug_category, level = levels.get(t, ("", ""))
        template = texts.get(t)
        kind = "span" if t in spans else "exit" if t in ends else "detail"
        out.append(
            (
                t,
                kind,
                ends_of(t) if t in spans else [],
                category,
                cpu,
                debug_category,
                level,
                *[t in s for s in sets],
                t in ends,
                t in pseudo,
                t in UNWINDS,
                SUFFIXES.get(t),
                template in ("{2}", "{3}", "{4}"),
                _rule(template) if template else None,
            )
        )
    return out


def type_dimension(spark: SparkSession) -> DataFrame:
    """The dimension as a table; its size is fixed, so joins may broadcast it."""
    return spark.createDataFrame(rows(), SCHEMA)
