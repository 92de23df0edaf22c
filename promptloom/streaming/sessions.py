"""Log lines of one request, job or worker, put together while they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.operators.logs import LEVELS


def log_sessions(parsed: DataFrame, by: str = "request_id", silence: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of lines: (id, first_at, last_at, lines, worst_level).

    A session of an id ends when no line of it came for ``silence``; a line right at that end
    still belongs to it. It is emitted once, in append mode, when the watermark has passed its
    end, and its state is dropped then. Lines later than ``delay`` and lines without a time or
    an id take no part. Aggregates are combined before the shuffle, so a hot id costs its
    sessions. ``parsed`` may also be a batch, which gives all sessions.
    """
    levels = F.array(*[F.lit(level) for level in LEVELS])
    rank = F.array_position(levels, F.col("level"))
    return (
        parsed.where(F.col(by).isNotNull() & F.col("at").isNotNull())
        .withWatermark("at", delay)
        .groupBy(F.session_window("at", silence).alias("_s"), F.col(by).alias("id"))
        .agg(F.count("*").alias("lines"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max(rank).alias("_worst"))
        .select("id", "first_at", "last_at", "lines", F.try_element_at(levels, F.nullif("_worst", F.lit(0)).cast("int")).alias("worst_level"))
    )
