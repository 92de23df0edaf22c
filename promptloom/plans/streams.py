"""Streaming jobs run over the given tables to their end; the SQL is the batch answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from promptloom.operators.validate import standard_rules
from promptloom.plans.clients import FlakyClient
from promptloom.plans.inference import FLAKY_SQL, NO_WAIT, flaky_requests
from promptloom.plans.registry import query
from promptloom.plans.tables import DOCUMENT_ITEMS_SQL, judged_sql, table
from promptloom.session import new_folder
from promptloom.streaming import duplicates, progress
from promptloom.streaming.inference import infer_stream, read_stream_results
from promptloom.sources.items import read_items, read_loads
from promptloom.streaming.ingest import ingest_stream
from promptloom.streaming.runs import run_available, stream_table

TOKENS = 1000
WINDOW = ["window_start", "window_end", "status"]


@query(f"""
WITH {DOCUMENT_ITEMS_SQL}, {judged_sql("doc_items", max_tokens=TOKENS)}
SELECT job_id, row_number, external_id, status, error,
       CAST(CASE WHEN ok THEN length(prompt) END AS BIGINT) AS prompt_chars
FROM judged
""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents loaded as a stream, then handed in a second time, which adds nothing."""
    items = stream_table(spark, sf_dir, "documents.parquet").select(
        F.col("source").alias("job_id"),
        (F.col("doc_id") + 1).alias("row_number"),
        F.col("doc_id").cast("string").alias("external_id"),
        F.col("text").alias("prompt"),
        F.col("text").isNull().alias("is_malformed"),
    )
    root = new_folder(spark, "stream-ingest")
    rules = standard_rules(max_tokens=TOKENS)
    run_available(ingest_stream(items, f"{root}/items", rules), f"{root}/first")
    run_available(ingest_stream(items, f"{root}/items", rules), f"{root}/second")
    return read_items(spark, f"{root}/items").select(
        "job_id",
        "row_number",
        "external_id",
        "status",
        "error",
        F.char_length("prompt").cast("bigint").alias("prompt_chars"),
    )


def _event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_table(spark, sf_dir, "events.parquet").select(
        F.col("event_type").alias("job_id"),
        F.col("user_id").cast("string").alias("external_id"),
        F.col("event_id").alias("row_number"),
    )


PARTS = 3
ALL_FILES = (1 << 31) - 1


def _run_event_parts(
    spark: SparkSession, sf_dir: str, root: str, start: Callable[[DataFrame], DataStreamWriter]
) -> None:
    """All events as a stream of ``PARTS`` micro-batches, in the order of their ids.

    A part arrives, in as many files as its tasks write, when the stream has worked off the one
    before; each run of it goes on from the checkpoint.
    """
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    part = F.floor(F.col("event_id") * PARTS / (last + 1))
    for number in range(PARTS):
        events.where(part == number).write.mode("append").parquet(f"{root}/events.parquet")
        stream = stream_table(spark, root, "events.parquet", files_per_trigger=ALL_FILES).select(
            F.col("event_type").alias("job_id"),
            (F.col("event_id") + 1).alias("row_number"),
            F.col("user_id").cast("string").alias("external_id"),
            F.col("props").alias("prompt"),
            F.col("props").isNull().alias("is_malformed"),
        )
        run_available(start(stream), f"{root}/checkpoint", spark)


_PARTS_SQL = f"""
parts AS (
  SELECT event_type AS job_id, CAST(user_id AS VARCHAR) AS external_id, event_id + 1 AS row_number,
         CAST(floor(event_id * {PARTS}::DOUBLE / ((SELECT max(event_id) FROM events) + 1)) AS INTEGER) AS part
  FROM events),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, external_id, part ORDER BY row_number) AS place,
         min(row_number) OVER (PARTITION BY job_id, external_id) AS first_row,
         min(part) OVER (PARTITION BY job_id, external_id) AS first_part
  FROM parts)
"""


@query(f"""
WITH {_PARTS_SQL}
SELECT job_id, external_id, row_number, first_row, 'duplicate external id: ' || external_id AS error
FROM placed WHERE row_number > first_row
""")
def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event whose id came before, in its micro-batch or an earlier one, reported as it arrives."""
    root = new_folder(spark, "stream-repeats")

    def start(stream: DataFrame) -> DataStreamWriter:
        found = duplicates.repeated_items(stream, keep_for_seconds=86_400)
        return found.writeStream.format("parquet").option("path", f"{root}/out")

    _run_event_parts(spark, sf_dir, root, start)
    return spark.read.schema(duplicates.REPEATS).parquet(f"{root}/out")


@query(f"""
WITH {_PARTS_SQL}
SELECT job_id, CAST(part AS BIGINT) AS epoch, CASE WHEN place = 1 THEN 'PENDING' ELSE 'FAILED' END AS status,
       CASE WHEN place > 1 THEN 'dropped_in_batch' WHEN part > first_part THEN 'dropped_existing' ELSE 'inserted' END AS disposition,
       count(*) AS rows, CAST(sum(row_number) AS BIGINT) AS row_numbers
FROM placed GROUP BY ALL
""")
def stream_ingest_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every event of a stream in several micro-batches."""
    root = new_folder(spark, "stream-dispositions")
    _run_event_parts(spark, sf_dir, root, lambda stream: ingest_stream(stream, f"{root}/items"))
    loads = read_loads(spark, f"{root}/items")
    return loads.groupBy("job_id", "epoch", "status", "disposition").agg(
        F.count("*").alias("rows"), F.sum("row_number").alias("row_numbers")
    )


@query("SELECT DISTINCT event_type AS job_id, CAST(user_id AS VARCHAR) AS external_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that pass the streaming duplicate check."""
    root = new_folder(spark, "stream-dedup")
    passed = duplicates.distinct_items(_event_items(spark, sf_dir)).select("job_id", "external_id")
    run_available(passed.writeStream.format("parquet").option("path", f"{root}/ids"), f"{root}/checkpoint")
    return spark.read.schema(passed.schema).parquet(f"{root}/ids")


@query("""
SELECT event_type AS job_id, CAST(user_id AS VARCHAR) AS external_id, min(event_id) AS first_row, count(*) AS rows
FROM events GROUP BY 1, 2
""")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row and number of rows of every id, kept while the stream runs."""
    return _kept_up(spark, duplicates.seen_counts(_event_items(spark, sf_dir)), ["job_id", "external_id"], "stream-seen")


def _kept_up(spark: SparkSession, result: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run a streaming aggregation to its end and return the state its epochs left."""
    root = new_folder(spark, label)
    writer = result.writeStream.outputMode("update").foreachBatch(progress.changed_rows(f"{root}/out"))
    run_available(writer, f"{root}/checkpoint")
    return progress.read_latest(spark, f"{root}/out", result.schema, keys)


@query("""
SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS status, count(*) AS items FROM events GROUP BY 1, 2
""")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live counts by job and status."""
    items = stream_table(spark, sf_dir, "events.parquet").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status")
    )
    return _kept_up(spark, progress.running_status(items), ["job_id", "status"], "stream-status")


def _finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_table(spark, sf_dir, "events.parquet").select(
        F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("status")
    )


def _windows(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), "status", "items"
    )


@query("""
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us,
       epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) + 3600000000 AS end_us, event_type AS status, count(*) AS items
FROM events GROUP BY 1, 2, 3
""")
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished items per hour and status."""
    rate = progress.throughput(_finished(spark, sf_dir), "at", "1 hour")
    return _windows(_kept_up(spark, rate, WINDOW, "stream-rate"))


@query("""
WITH slots AS (
  SELECT event_type AS status, epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) - i * 1800000000 AS start_us
  FROM events, (VALUES (0), (1)) AS n(i))
SELECT start_us, start_us + 3600000000 AS end_us, status, count(*) AS items FROM slots GROUP BY 1, 2, 3
""")
def stream_throughput_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished items per status in hours that start every half hour."""
    rate = progress.throughput(_finished(spark, sf_dir), "at", "1 hour", "30 minutes")
    return _windows(_kept_up(spark, rate, WINDOW, "stream-slide"))


@query("""
WITH closed AS (SELECT epoch_us(max(ts)) - 600000000 AS watermark FROM events)
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us,
       epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) + 3600000000 AS end_us, event_type AS status, count(*) AS items
FROM events, closed
WHERE epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) + 3600000000 <= watermark // 1000 * 1000
GROUP BY 1, 2, 3
""")
def stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours the watermark has passed: emitted once and final."""
    root = new_folder(spark, "stream-closed")
    closed = progress.throughput(_finished(spark, sf_dir), "at", "1 hour")
    run_available(closed.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/checkpoint")
    return _windows(spark.read.schema(closed.schema).parquet(f"{root}/out"))


@query(FLAKY_SQL)
def stream_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference over a stream of requests; results are read from what the epochs wrote."""
    root = new_folder(spark, "stream-infer")
    requests = flaky_requests(stream_table(spark, sf_dir, "events.parquet"))
    run_available(infer_stream(requests, FlakyClient, f"{root}/out", rule=NO_WAIT), f"{root}/checkpoint")
    return read_stream_results(spark, f"{root}/out").select(
        "job_id", "external_id", "status", "response", "error", "attempts"
    )
