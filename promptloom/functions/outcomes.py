"""Expressions over inference attempts: outcome classes, waits, responses, latency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUCCESS = "success"
RETRYABLE = "retryable_error"
PERMANENT = "permanent_error"
UNEXPECTED = "unexpected"

# Response codes worth another try.
RETRYABLE_STATUS = (429, 500, 502, 503, 504)
# Failures without a response code that are worth another try.
RETRYABLE_KINDS = ("rate_limit", "timeout", "connection")
STATUS_KIND = "status"


def retryable_status(code: Column) -> Column:
    return code.isin(*RETRYABLE_STATUS)


def outcome_class(error_kind: Column, status_code: Column) -> Column:
    """Outcome of one try: ``error_kind`` null means the call returned."""
    server_side = (error_kind == STATUS_KIND) & ((status_code >= 500) | retryable_status(status_code))
    return (
        F.when(error_kind.isNull(), SUCCESS)
        .when(error_kind.isin(*RETRYABLE_KINDS) | F.coalesce(server_side, F.lit(False)), RETRYABLE)
        .when(error_kind == STATUS_KIND, PERMANENT)
        .otherwise(UNEXPECTED)
    )


def wait_ceiling(retry: Column, base: float = 1.0, factor: float = 2.0, cap: float = 30.0) -> Column:
    """Longest wait in seconds before retry number ``retry`` (0 = first retry)."""
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(float(factor)), retry))


def response_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def used_tokens(count: Column) -> Column:
    return F.coalesce(count, F.lit(0))


def elapsed_ms(started: Column, ended: Column) -> Column:
    """Whole milliseconds between two timestamps, rounded down."""
    return F.floor((F.unix_micros(ended) - F.unix_micros(started)) / 1000).cast("bigint")


def as_json(*columns: str) -> Column:
    """JSON object with the given columns; null fields are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
