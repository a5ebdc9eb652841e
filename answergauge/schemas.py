"""Table layouts, as DDL strings that every reader and writer shares."""

CASES = (
    "case_pos BIGINT, case_id STRING, case_desc STRING, prompt STRING, "
    "standard_answer STRING, expect_keywords ARRAY<STRING>"
)

ATTEMPTS = (
    "request_id BIGINT, attempt_no INT, error_kind STRING, http_status INT, body STRING, "
    "error_text STRING, started_at TIMESTAMP, ended_at TIMESTAMP"
)

OUTCOMES = "case_pos BIGINT, code INT, data STRING, msg STRING, cost_ms DOUBLE"

JUDGEMENTS = "case_pos BIGINT, code INT, data STRING"

# One graded case; the order is the order of the stored detail table.
RESULT_FIELDS = {
    "case_id": "STRING",
    "case_desc": "STRING",
    "prompt": "STRING",
    "execute_timestamp": "STRING",
    "thread_id": "STRING",
    "api_cost_ms": "DOUBLE",
    "compute_cost_ms": "DOUBLE",
    "request_cost_ms": "DOUBLE",
    "answer_content": "STRING",
    "success_flag": "BOOLEAN",
    "error_msg": "STRING",
    "is_valid": "BOOLEAN",
    "is_compliant": "BOOLEAN",
    "validity_msg": "STRING",
    "compliance_msg": "STRING",
    "total_score": "DOUBLE",
    "relevance_score": "DOUBLE",
    "completeness_score": "DOUBLE",
    "hallucination_level": "STRING",
    "hallucination_msg": "STRING",
}

RESULT_COLUMNS = list(RESULT_FIELDS)

RESULTS = "case_pos BIGINT, " + ", ".join(f"{k} {v}" for k, v in RESULT_FIELDS.items())

BATCH_FIELDS = {
    "batch_id": "STRING",
    "execute_time": "STRING",
    "model_name": "STRING",
    "total_cases": "BIGINT",
    "success_count": "BIGINT",
    "total_time": "DOUBLE",
    "success_rate": "DOUBLE",
    "avg_total_score": "DOUBLE",
}

BATCH_COLUMNS = list(BATCH_FIELDS)

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
