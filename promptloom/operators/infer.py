"""Batch inference over a table of prompts with a client supplied by the user.

Calls go out from the tasks; each task keeps at most ``calls_per_task`` of them open. The
result is one row per try, written once: calls are costly and not repeatable, so nothing
downstream may run them again.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from queue import SimpleQueue
from threading import Thread
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.outcomes import PERMANENT, RETRYABLE, SUCCESS, UNEXPECTED
from promptloom.schemas import ATTEMPTS
from promptloom.session import materialise, path_exists, ship_package


class RetryableError(Exception):
    """Raised by a client when another try may succeed."""


class PermanentError(Exception):
    """Raised by a client when no further try makes sense."""


@dataclass(frozen=True)
class Request:
    model: str
    prompt: str
    max_tokens: int
    temperature: float
    top_p: float
    attempt: int


@dataclass(frozen=True)
class Response:
    text: str | None
    prompt_tokens: int | None = 0
    completion_tokens: int | None = 0


class Client(Protocol):
    def complete(self, request: Request) -> Response: ...


@dataclass(frozen=True)
class RetryRule:
    """Number of tries and the waits between them (full jitter)."""

    max_attempts: int = 5
    base: float = 1.0
    factor: float = 2.0
    cap: float = 30.0

    def __post_init__(self) -> None:
        if self.max_attempts < 1:
            raise ValueError("max_attempts must be at least 1")

    def wait(self, retry: int) -> float:
        return random.uniform(0.0, min(self.cap, self.base * self.factor**retry))


# Request parameters.
OUTPUT_LIMIT = 2048
TEMPERATURE = 0.7
TOP_P = 1.0

_ATTEMPT_BATCH = pa.schema(
    [
        ("job_id", pa.string()),
        ("chunk_no", pa.int64()),
        ("row_number", pa.int64()),
        ("external_id", pa.string()),
        ("attempt", pa.int32()),
        ("model", pa.string()),
        ("outcome", pa.string()),
        ("error", pa.string()),
        ("response", pa.string()),
        ("started_at", pa.timestamp("us", tz="UTC")),
        ("ended_at", pa.timestamp("us", tz="UTC")),
        ("prompt_tokens", pa.int32()),
        ("completion_tokens", pa.int32()),
    ]
)


def model_or_default(model: Column, default: str) -> Column:
    """The requested model; the default if none or an empty one was requested."""
    return F.coalesce(F.nullif(model, F.lit("")), F.lit(default))


def request_columns(rows: DataFrame, default_model: str, output_limit: int = OUTPUT_LIMIT) -> DataFrame:
    """Project rows of (job_id, chunk_no, row_number, external_id, prompt, model) to requests."""
    return rows.select(
        "job_id",
        "chunk_no",
        "row_number",
        "external_id",
        model_or_default(F.col("model"), default_model).alias("model"),
        F.coalesce("prompt", F.lit("")).alias("prompt"),
        F.lit(output_limit).alias("max_tokens"),
        F.lit(TEMPERATURE).alias("temperature"),
        F.lit(TOP_P).alias("top_p"),
    )


def message_json(prompt: Column) -> Column:
    """The one-message conversation that is sent."""
    return F.to_json(F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))))


@dataclass(frozen=True)
class CallLayout:
    partitions: int
    calls_per_task: int


def call_layout(slots: int, max_concurrency: int, tasks_per_slot: int = 8) -> CallLayout:
    """Spread a ceiling of open calls over task slots.

    With fewer calls than slots, every task makes one call at a time and the number of
    partitions is the ceiling. Otherwise each slot gets its share, and several small
    partitions per slot keep the repeated work low when a task is lost.
    """
    if max_concurrency < 1:
        raise ValueError("max_concurrency must be at least 1")
    if max_concurrency < slots:
        return CallLayout(max_concurrency, 1)
    return CallLayout(slots * tasks_per_slot, max_concurrency // slots)


class _Clock:
    """Wall-clock stamps in microseconds whose differences come from the monotonic clock."""

    def __init__(self) -> None:
        self._offset = time.time_ns() - time.monotonic_ns()

    def now(self) -> int:
        return (time.monotonic_ns() + self._offset) // 1000


# What a try yields: outcome, error, response, prompt tokens, completion tokens.
Outcome = tuple[str, str | None, str | None, int | None, int | None]


def _call(client: Client, request: Request) -> Outcome:
    try:
        response = client.complete(request)
        return SUCCESS, None, response.text or "", response.prompt_tokens or 0, response.completion_tokens or 0
    except RetryableError as error:
        return RETRYABLE, str(error), None, None, None
    except PermanentError as error:
        return PERMANENT, str(error), None, None, None
    except Exception as error:  # whatever a client raises stays with its row
        return UNEXPECTED, f"unexpected: {error}", None, None, None


_REQUEST_COLUMNS = (
    "job_id", "chunk_no", "row_number", "external_id", "model", "prompt", "max_tokens", "temperature", "top_p",
)


def _tries(client: Client, rule: RetryRule, clock: _Clock, row: tuple[Any, ...]) -> list[tuple[Any, ...]]:
    """All tries of one request as rows of the attempts table."""
    job_id, chunk_no, row_number, external_id, model, prompt, max_tokens, temperature, top_p = row
    done: list[tuple[Any, ...]] = []
    for attempt in range(1, rule.max_attempts + 1):
        request = Request(model, prompt, max_tokens, temperature, top_p, attempt)
        started = clock.now()
        outcome, error, response, prompt_tokens, completion_tokens = _call(client, request)
        done.append(
            (
                job_id,
                chunk_no,
                row_number,
                external_id,
                attempt,
                model,
                outcome,
                error,
                response,
                started,
                clock.now(),
                prompt_tokens,
                completion_tokens,
            )
        )
        if outcome != RETRYABLE or attempt == rule.max_attempts:
            break
        pause = rule.wait(attempt - 1)
        if pause > 0:
            time.sleep(pause)
    return done


def _rows(batches: Iterator[pa.RecordBatch], slice_rows: int) -> Iterator[tuple[Any, ...]]:
    """Rows of Arrow batches; only a slice at a time becomes Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, slice_rows):
            part = batch.slice(start, slice_rows)
            yield from zip(*[part.column(name).to_pylist() for name in _REQUEST_COLUMNS], strict=True)


def infer(
    requests: DataFrame,
    client_factory: Callable[[], Client],
    rule: RetryRule = RetryRule(),
    layout: CallLayout | None = None,
    chunk_rows: int = 50,
) -> DataFrame:
    """One row per try (schema ``ATTEMPTS``) for every request; no row can fail the job.

    Requests come from ``request_columns``. Chunks are hashed to partitions, so one large
    job spreads over all tasks. A task keeps its calls going without pause: a row that waits
    for its next try holds one place and no other row. Finished rows leave in batches of
    ``chunk_rows``, and as many rows stand by, so a task never holds more than these and its open calls.
    """
    ship_package(requests.sparkSession)
    slots = requests.sparkSession.sparkContext.defaultParallelism
    plan = layout or CallLayout(slots * 4, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = client_factory()
        clock = _Clock()
        asked: SimpleQueue[tuple[Any, ...] | None] = SimpleQueue()
        finished: SimpleQueue[list[tuple[Any, ...]] | BaseException] = SimpleQueue()
        done: list[tuple[Any, ...]] = []

        def work() -> None:
            while (row := asked.get()) is not None:
                try:
                    finished.put(_tries(client, rule, clock, row))
                except BaseException as error:
                    finished.put(error)

        def take() -> None:
            found = finished.get()
            if isinstance(found, BaseException):
                raise found
            done.extend(found)

        def packed() -> pa.RecordBatch:
            columns = [
                pa.array(values, field.type)
                for values, field in zip(zip(*done, strict=True), _ATTEMPT_BATCH, strict=True)
            ]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_ATTEMPT_BATCH)

        threads = [Thread(target=work, daemon=True) for _ in range(plan.calls_per_task)]
        # So many rows stand by that no place is ever idle, and that quick calls seldom wake this thread.
        most = max(2 * plan.calls_per_task, chunk_rows)
        for thread in threads:
            thread.start()
        try:
            waiting = 0
            for row in _rows(batches, chunk_rows):
                asked.put(row)
                waiting += 1
                if waiting >= most:
                    for _ in range(max(1, finished.qsize())):
                        take()
                        waiting -= 1
                if len(done) >= chunk_rows:
                    yield packed()
            for _ in range(waiting):
                take()
            if done:
                yield packed()
        finally:
            for _ in threads:
                asked.put(None)
            for thread in threads:
                thread.join()
            close = getattr(client, "close", None)
            if close is not None:
                close()

    return requests.repartition(plan.partitions, "job_id", "chunk_no").mapInArrow(run, ATTEMPTS)


def run_inference(requests: DataFrame, client_factory: Callable[[], Client], **options: Any) -> DataFrame:
    """``infer``, with the attempts table written before anyone reads it."""
    return materialise(infer(requests, client_factory, **options), "attempts")


def committed_inference(
    requests: DataFrame, client_factory: Callable[[], Client], path: str, rows_per_task: int = 5000, **options: Any
) -> DataFrame:
    """``infer`` in one job whose tasks each commit their attempts to ``path`` as they end.

    A task has whole chunks, about ``rows_per_task`` rows, and one file, which its own commit
    puts in place (committer algorithm 2). So what a stopped run has finished is there without
    any job commit. Called again, it lists the chunks that are stored and sends the others:
    a call is repeated only if its task had not ended. ``requests`` must be the same each time.
    On stores without atomic renames, give Spark a committer that publishes files whole.
    """
    spark = requests.sparkSession
    if path_exists(spark, path):
        chunks = spark.read.schema(ATTEMPTS).parquet(path).select("job_id", "chunk_no").distinct()
        requests = requests.join(chunks, ["job_id", "chunk_no"], "left_anti")
    rows = requests.count()
    if rows:
        slots = spark.sparkContext.defaultParallelism
        layout = options.pop("layout", None) or CallLayout(slots, 4)
        if layout.partitions >= slots:  # fewer ones hold the number of open calls down
            layout = CallLayout(max(layout.partitions, -(-rows // rows_per_task)), layout.calls_per_task)
        infer(requests, client_factory, layout=layout, **options).write.mode("append").option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2"
        ).parquet(path)
    if not path_exists(spark, path):
        return spark.createDataFrame([], ATTEMPTS)
    return spark.read.schema(ATTEMPTS).parquet(path)


def resumable_inference(
    requests: DataFrame, client_factory: Callable[[], Client], path: str, rows_per_task: int = 5000, **options: Any
) -> DataFrame:
    """``committed_inference`` below ``path`` that also pins the requests; the attempts of all of them.

    The requests are stored first. Called again with the same path, after a crash or a stop,
    it reads the stored ones, so chunks are the same however the requests were made.
    """
    spark = requests.sparkSession
    planned = f"{path}/requests"
    if not path_exists(spark, f"{planned}/_SUCCESS"):
        requests.write.mode("overwrite").parquet(planned)
    stored = spark.read.schema(requests.schema).parquet(planned)
    return committed_inference(stored, client_factory, f"{path}/attempts", rows_per_task, **options)
