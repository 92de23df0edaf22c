"""Incremental inference with results that survive restarts."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from promptloom.operators.infer import Client, committed_inference
from promptloom.operators.results import collapse_attempts
from promptloom.streaming.runs import run_folder


def infer_stream(
    requests: DataFrame, client_factory: Callable[[], Client], path: str, **options: Any
) -> DataStreamWriter:
    """Writer that sends a stream of requests and stores attempts, then results, per micro-batch.

    Results are derived from the stored attempts. Each task of a micro-batch commits its own
    attempts; one that is repeated after a crash sends only the chunks that were not stored.
    Its results replace themselves.
    """

    def send(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        folder = run_folder(spark, epoch)
        stored = committed_inference(batch, client_factory, f"{path}/attempts/{folder}", **options)
        results = collapse_attempts(stored, ["row_number", "chunk_no", "ended_at"])
        results.write.mode("overwrite").parquet(f"{path}/results/{folder}")

    return requests.writeStream.foreachBatch(send)


def read_stream_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of all micro-batches; an item that was sent again keeps its latest result."""
    rows = spark.read.parquet(f"{path}/results")
    payload = [name for name in rows.columns if name not in ("job_id", "external_id", "run_id", "epoch")]
    latest = F.max_by(F.struct(*payload), "ended_at")
    return rows.groupBy("job_id", "external_id").agg(latest.alias("_r")).select("job_id", "external_id", "_r.*")
