"""Open work and its division into chunks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.text import whole_quotient
from promptloom.operators.prefix import number_rows

# Fixed value: rows per chunk.
CHUNK_ROWS = 50


def is_open(as_of: Column | datetime) -> Column:
    """Waiting, or claimed by someone whose lease ran out before ``as_of``."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    expired = (F.col("status") == "CLAIMED") & F.coalesce(F.col("lease_until") < moment, F.lit(False))
    return (F.col("status") == "PENDING") | expired


def open_work(items: DataFrame, as_of: Column | datetime) -> DataFrame:
    return items.where(is_open(as_of))


def next_open_rows(
    items: DataFrame, as_of: Column | datetime, count: int, order: Sequence[str] = ("id",), job_id: str | None = None
) -> DataFrame:
    """The first ``count`` open rows in id order, of one job or of all."""
    rows = open_work(items, as_of)
    if job_id is not None:
        rows = rows.where(F.col("job_id") == job_id)
    return rows.orderBy(*order).limit(count)


def chunk_key(job_id: Column, chunk_no: Column) -> Column:
    """Key of a chunk: the same for every run over the same rows."""
    return F.sha2(F.concat_ws(":", job_id, chunk_no.cast("string")), 256)


def plan_chunks(items: DataFrame, chunk_rows: int = CHUNK_ROWS, order: Sequence[str] = ("row_number",)) -> DataFrame:
    """Divide each job's rows into chunks: adds ``seq, chunk_no, chunk_id``.

    Hand in the accepted rows' keys; all chunks of a job but its last are full.
    """
    return (
        number_rows(items, ["job_id"], list(order))
        .withColumn("chunk_no", whole_quotient(F.col("seq") - 1, chunk_rows))
        .withColumn("chunk_id", chunk_key(F.col("job_id"), F.col("chunk_no")))
    )
