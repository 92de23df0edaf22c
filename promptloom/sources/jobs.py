"""The jobs table: appended job rows and appended state transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.operators.infer import model_or_default
from promptloom.operators.jobs import latest_state
from promptloom.schemas import JOBS


def job_rows(submitted: DataFrame, default_model: str) -> DataFrame:
    """New job rows out of (job_id, input_path, model, config, created_at): PENDING, no items yet."""
    return submitted.select(
        "job_id",
        F.lit("PENDING").alias("state"),
        "input_path",
        model_or_default(F.col("model"), default_model).alias("model"),
        F.lit(0).cast("bigint").alias("total_items"),
        F.coalesce("config", F.lit("{}")).alias("config"),
        F.lit(None).cast("string").alias("error"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )


def append_jobs(jobs: DataFrame, path: str) -> None:
    jobs.select(*JOBS.fieldNames()).write.mode("append").parquet(path)


def read_jobs(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """The jobs table, or the row of one job (the filter reaches the scan)."""
    rows = spark.read.schema(JOBS).parquet(path)
    return rows if job_id is None else rows.where(F.col("job_id") == job_id)


def current_jobs(jobs: DataFrame, transitions: DataFrame, totals: DataFrame) -> DataFrame:
    """Job rows with their latest state, error and item total.

    ``transitions`` is (job_id, seq, state, error); ``totals`` is (job_id, total) as counted at
    ingest. A job without a transition keeps its own state.
    """
    now = latest_state(transitions, ["seq"]).select("job_id", F.struct("state", "error").alias("_now"))
    return (
        jobs.join(now, "job_id", "left")
        .join(totals.select("job_id", "total"), "job_id", "left")
        .withColumns(
            {
                "state": F.coalesce("_now.state", "state"),
                "error": F.when(F.col("_now").isNotNull(), F.col("_now.error")).otherwise(F.col("error")),
                "total_items": F.coalesce(F.col("total").cast("bigint"), F.col("total_items")),
            }
        )
        .select(*JOBS.fieldNames())
    )
