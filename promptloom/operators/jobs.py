"""Job table operators: states, integrity between jobs and items, open jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.operators.chunks import open_work
from promptloom.schemas import TERMINAL_STATES


def latest_state(transitions: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Current state and error of every job: the last transition overwrites both."""
    last = F.max_by(F.struct("state", "error"), F.struct(*order))
    return transitions.groupBy("job_id").agg(last.alias("last")).select("job_id", "last.state", "last.error")


def jobs_by_state(states: DataFrame) -> DataFrame:
    """Jobs that reached a terminal state, by state."""
    return (
        states.where(F.col("state").isin(*TERMINAL_STATES))
        .groupBy("state")
        .agg(F.count("*").alias("jobs"))
    )


def jobs_with_open_work(jobs: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """Jobs that still have an open item."""
    waiting = open_work(items, as_of).select("job_id").distinct()
    return jobs.join(waiting, "job_id", "left_semi")


def purge_jobs(items: DataFrame, deleted: DataFrame) -> DataFrame:
    """Items left after their jobs were deleted."""
    gone = deleted.select("job_id")
    return items.join(gone, "job_id", "left_anti")


def orphan_items(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items whose job does not exist."""
    return items.join(jobs.select("job_id"), "job_id", "left_anti")
