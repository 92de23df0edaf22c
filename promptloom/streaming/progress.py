"""Live progress and throughput."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.operators.reports import count_by_status


def running_status(items: DataFrame) -> DataFrame:
    """Items by job and status while they arrive."""
    return count_by_status(items)


def throughput(finished: DataFrame, at: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Finished items per status and time window; rows later than ``delay`` are dropped."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return (
        finished.withWatermark(at, delay)
        .groupBy(window.alias("_w"), "status")
        .agg(F.count("*").alias("items"))
        .select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "status", "items")
    )


def changed_rows(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for update-mode results: each epoch stores the groups it changed, and only those.

    A repeated epoch overwrites its own folder.
    """

    def store(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return store


def read_latest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Current state of every group: its row of the last epoch that changed it."""
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])).parquet(path)
    values = [name for name in schema.fieldNames() if name not in keys]
    latest = F.max_by(F.struct(*values), "epoch")
    return stored.groupBy(*keys).agg(latest.alias("_v")).select(*keys, "_v.*")
