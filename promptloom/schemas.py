"""Table schemas and the closed value sets of their status columns."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "timestamp": T.TimestampType(),
}


def _schema(columns: str) -> T.StructType:
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


JOB_STATES = ("PENDING", "INGESTING", "RUNNING", "COMPLETED", "FAILED")
TERMINAL_STATES = ("COMPLETED", "FAILED")
ACTIVE_STATES = ("INGESTING", "RUNNING")
ITEM_STATUSES = ("PENDING", "CLAIMED", "SUCCEEDED", "FAILED")

JOBS = _schema(
    "job_id string, state string, input_path string, model string, total_items bigint, "
    "config string, error string, created_at timestamp, updated_at timestamp"
)

ITEMS = _schema(
    "id bigint, job_id string, external_id string, prompt string, status string, attempts int, "
    "worker_id string, lease_until timestamp, chunk_id string, result_ref string, error string, "
    "created_at timestamp, updated_at timestamp"
)

RESULT_FIELDS = ("external_id", "status", "response", "error", "attempts", "latency_ms")

RESULTS = _schema(
    "job_id string, run_id string, chunk_group bigint, chunk_id string, row_number bigint, external_id string, "
    "status string, response string, error string, attempts int, latency_ms bigint"
)

ATTEMPTS = _schema(
    "job_id string, chunk_no bigint, row_number bigint, external_id string, attempt int, "
    "model string, outcome string, error string, response string, started_at timestamp, "
    "ended_at timestamp, prompt_tokens int, completion_tokens int"
)

LOG_LINE = _schema(
    "ts string, level string, logger string, msg string, request_id string, job_id string, "
    "worker_id string, exception string"
)
