"""From attempts to results, and from results back into the item table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.outcomes import SUCCESS, elapsed_ms, response_text
from promptloom.functions.text import last_segment
from promptloom.operators.chunks import chunk_key
from promptloom.schemas import ACTIVE_STATES

_ITEM = ["job_id", "external_id"]


def collapse_attempts(attempts: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One result per (job_id, external_id): the last try decides.

    Latency spans all tries and the waits between them. ``carry`` names further columns to
    take from the last try. Aggregates are combined on the map side, so the number of tries
    of one item does not matter.
    """
    last = F.max_by(F.struct("outcome", "error", "response", *carry), "attempt")
    succeeded = F.col("last.outcome") == SUCCESS
    return (
        attempts.groupBy(*_ITEM)
        .agg(
            last.alias("last"),
            F.max("attempt").alias("attempts"),
            F.min("started_at").alias("started_at"),
            F.max("ended_at").alias("ended_at"),
        )
        .select(
            *_ITEM,
            F.when(succeeded, "SUCCEEDED").otherwise("FAILED").alias("status"),
            F.when(succeeded, response_text(F.col("last.response"))).alias("response"),
            F.when(~succeeded, F.col("last.error")).alias("error"),
            F.col("attempts").cast("int").alias("attempts"),
            elapsed_ms(F.col("started_at"), F.col("ended_at")).alias("latency_ms"),
            *[F.col(f"last.{name}").alias(name) for name in carry],
        )
    )


def results_of(attempts: DataFrame) -> DataFrame:
    """Results of ``infer`` output with their chunk keys, ready to be written."""
    collapsed = collapse_attempts(attempts, ["row_number", "chunk_no"])
    return collapsed.withColumn("chunk_id", chunk_key(F.col("job_id"), F.col("chunk_no")))


def guarded_completion(items: DataFrame, results: DataFrame, applied: Sequence[str | Column]) -> DataFrame:
    """Apply results to claimed items: new item columns plus ``committed``.

    A result counts only for an item that is CLAIMED by the worker that sent it. Of several
    results for one item the first in ``applied`` order counts; copies are combined on the
    map side before the join, which then meets each item at most once. Items that are not
    claimed take no part in it.
    """
    key = [*_ITEM, "worker_id"]
    fields = ["status", "result_ref", "error", "attempts"]
    first = results.groupBy(*key).agg(
        F.min_by(F.struct(*[F.col(f).alias(f) for f in fields]), F.struct(*applied)).alias("_new")
    )
    is_claimed = F.coalesce(F.col("status") == "CLAIMED", F.lit(False))
    joined = items.where(is_claimed).join(first, key, "left").withColumn("committed", F.col("_new").isNotNull())

    def taken(new: Column, name: str) -> Column:
        return F.when(F.col("committed"), new).otherwise(F.col(name)).alias(name)

    changed = {f: taken(F.col(f"_new.{f}"), f) for f in fields}
    changed["chunk_id"] = taken(last_segment(F.col("_new.result_ref")), "chunk_id")
    applied_rows = joined.select(*[changed.get(name, F.col(name)) for name in items.columns], "committed")
    return applied_rows.unionByName(items.where(~is_claimed).withColumn("committed", F.lit(False)))


def replay_winners(results: DataFrame, items: DataFrame, written: Sequence[str | Column]) -> DataFrame:
    """One result per (job_id, external_id) when chunks were processed more than once.

    The result of the chunk the item table committed wins, else the latest in ``written``
    order. Copies within a chunk collapse first; the item table is then looked up by item
    and chunk, so no task sees all copies of one item.
    """
    payload = [name for name in results.columns if name not in (*_ITEM, "chunk_id")]
    per_chunk = results.groupBy(*_ITEM, "chunk_id").agg(
        F.max(F.struct(F.struct(*written).alias("_at"), F.struct(*payload).alias("_row"))).alias("_last")
    )
    committed = items.where(F.col("result_ref").isNotNull()).select(
        *_ITEM, last_segment(F.col("result_ref")).alias("chunk_id"), F.lit(True).alias("_committed")
    )
    ranked = per_chunk.join(committed, [*_ITEM, "chunk_id"], "left").select(
        *_ITEM,
        F.struct(
            F.coalesce("_committed", F.lit(False)).alias("committed"),
            F.col("_last._at").alias("at"),
            F.col("chunk_id"),
            F.col("_last._row").alias("row"),
        ).alias("_rank"),
    )
    return (
        ranked.groupBy(*_ITEM)
        .agg(F.max("_rank").alias("_best"))
        .select(*_ITEM, "_best.chunk_id", *[f"_best.row.{name}" for name in payload])
    )


def full_report(results: DataFrame, judged: DataFrame) -> DataFrame:
    """Processed results and rows rejected at ingest in one frame.

    A rejected row whose id was accepted elsewhere in the batch is part of the report too:
    nothing that was handed in is left out.
    """
    processed = results.select(
        "job_id", "row_number", "external_id", "status", "response", "error", "attempts", "latency_ms"
    )
    refused = judged.where(~F.col("ok")).select("job_id", "row_number", "external_id", "status", "error")
    return processed.unionByName(
        refused.withColumn("attempts", F.lit(0)), allowMissingColumns=True
    )


def resume_set(
    jobs: DataFrame, items: DataFrame, results: DataFrame, states: Sequence[str] = ACTIVE_STATES
) -> DataFrame:
    """Accepted items of interrupted jobs that have no final result yet."""
    # Jobs have one row each, so a task holds its share of them and sorts neither items nor results.
    active = jobs.where(F.col("state").isin(*states)).select("job_id").hint("shuffle_hash")
    waiting = items.where(F.col("status").isin("PENDING", "CLAIMED"))
    # Results of jobs that are done are left out before anything is moved; files lie by job.
    final = results.where(F.col("status").isin("SUCCEEDED", "FAILED")).select(*_ITEM)
    finished = final.join(active, "job_id", "left_semi").distinct()
    return waiting.join(active, "job_id", "left_semi").join(finished, _ITEM, "left_anti")
