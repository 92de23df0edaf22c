"""Requests, inference runs, results and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions.outcomes import response_text
from promptloom.functions.text import last_segment
from promptloom.operators import chunks, infer, results
from promptloom.operators.validate import standard_rules, validate
from promptloom.plans.clients import EchoClient, FlakyClient
from promptloom.plans.registry import query
from promptloom.plans.tables import DOCUMENT_ITEMS_SQL, document_items, judged_sql, table
from promptloom.session import materialise, new_folder
from promptloom.sources import results as result_files

CHUNK = 7
TOKENS = 1000


def _planned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their chunk; only keys are numbered, texts join by position."""
    items = document_items(spark, sf_dir)
    plan = chunks.plan_chunks(items.select("job_id", "row_number"), CHUNK)
    return items.join(plan.select("job_id", "row_number", "chunk_no"), ["job_id", "row_number"])


@query(f"""
WITH {DOCUMENT_ITEMS_SQL}
SELECT external_id, CASE WHEN model = 'es' THEN 'standard' ELSE model END AS model, prompt,
       2048 AS max_tokens, CAST(0.7 AS DOUBLE) AS temperature, CAST(1.0 AS DOUBLE) AS top_p, 'user' AS role
FROM doc_items
""")
def request_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests; rows without a model get the default one."""
    asked = document_items(spark, sf_dir).withColumns(
        {"model": F.when(F.col("model") != "es", F.col("model")).otherwise(""), "chunk_no": F.lit(0)}
    )
    requests = infer.request_columns(asked, "standard")
    sent = F.from_json(infer.message_json(F.col("prompt")), "array<struct<role string, content string>>")[0]
    return requests.withColumn("_m", sent).select(
        "external_id", "model", F.col("_m.content").alias("prompt"), "max_tokens", "temperature", "top_p", "_m.role"
    )


@query("""
SELECT source AS job_id, CAST(doc_id AS VARCHAR) AS external_id,
       CASE WHEN contains(text, 'the') THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
       CASE WHEN NOT contains(text, 'the') THEN 'echo: ' || text END AS response,
       CASE WHEN contains(text, 'the') THEN 'refused' END AS error, 1 AS attempts
FROM documents
""")
def infer_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sent to the echo client, which refuses those that contain a word."""
    requests = infer.request_columns(_planned_documents(spark, sf_dir), "standard")
    attempts = infer.run_inference(requests, lambda: EchoClient(refuse="the"))
    return results.results_of(attempts).select("job_id", "external_id", "status", "response", "error", "attempts")


def flaky_requests(events: DataFrame) -> DataFrame:
    """Events as requests that say how often they fail; works on a stream as well."""
    plan = F.pmod("event_id", F.lit(8))
    word = F.when(plan == 6, "refuse").when(plan == 7, "crash").otherwise(plan.cast("string"))
    return infer.request_columns(
        events.select(
            F.date_format("ts", "yyyy-MM-dd").alias("job_id"),
            F.floor(F.col("event_id") / 50).alias("chunk_no"),
            F.col("event_id").alias("row_number"),
            F.col("event_id").cast("string").alias("external_id"),
            F.concat(F.lit("answer after "), word).alias("prompt"),
            F.col("event_type").alias("model"),
        ),
        "standard",
    )


FLAKY_SQL = """
SELECT strftime(ts, '%Y-%m-%d') AS job_id, CAST(event_id AS VARCHAR) AS external_id,
       CASE WHEN event_id % 8 < 5 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
       CASE WHEN event_id % 8 < 5 THEN '' END AS response,
       CASE event_id % 8 WHEN 5 THEN 'busy 5' WHEN 6 THEN 'refused' WHEN 7 THEN 'unexpected: boom' END AS error,
       CAST(CASE WHEN event_id % 8 < 5 THEN event_id % 8 + 1 WHEN event_id % 8 = 5 THEN 5 ELSE 1 END AS INTEGER)
         AS attempts
FROM events
"""

NO_WAIT = infer.RetryRule(base=0.0)


@query(FLAKY_SQL)
def infer_retry_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tries, last error and status of every event sent to a client that fails as told."""
    attempts = infer.run_inference(flaky_requests(table(spark, sf_dir, "events")), FlakyClient, rule=NO_WAIT)
    return results.collapse_attempts(attempts).drop("latency_ms")


@query(FLAKY_SQL)
def infer_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``infer_retry_accounting``, by a run that keeps its progress and is called twice."""
    requests, path = flaky_requests(table(spark, sf_dir, "events")), new_folder(spark, "progress")
    rows = -(-requests.count() // 4)
    infer.resumable_inference(requests, FlakyClient, path, rows, rule=NO_WAIT)
    attempts = infer.resumable_inference(requests, FlakyClient, path, rows, rule=NO_WAIT)
    return results.collapse_attempts(attempts).drop("latency_ms")


# Results as the labels tell them: quality decides the status, unlabelled documents fail.


def document_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("row_number"), "quality")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return (
        _planned_documents(spark, sf_dir)
        .join(labels, "row_number", "left")
        .select(
            "job_id",
            "chunk_no",
            chunks.chunk_key(F.col("job_id"), F.col("chunk_no")).alias("chunk_id"),
            "row_number",
            "external_id",
            F.when(good, "SUCCEEDED").otherwise("FAILED").alias("status"),
            F.when(good, response_text(F.col("prompt"))).alias("response"),
            F.when(~good, F.coalesce(F.concat(F.lit("quality "), F.col("quality")), F.lit("no label"))).alias("error"),
            F.lit(1).alias("attempts"),
            F.char_length("prompt").cast("bigint").alias("latency_ms"),
        )
    )


DOCUMENT_RESULTS_SQL = f"""
{DOCUMENT_ITEMS_SQL},
doc_results AS (
  SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY row_number) - 1) // {CHUNK} AS chunk_no,
         row_number, external_id,
         CASE WHEN quality = 1 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
         CASE WHEN quality = 1 THEN prompt END AS response,
         CASE WHEN quality = 1 THEN NULL WHEN quality IS NULL THEN 'no label' ELSE 'quality ' || quality END AS error,
         1 AS attempts, CAST(length(prompt) AS BIGINT) AS latency_ms, quality
  FROM doc_items i LEFT JOIN labels l ON l.doc_id + 1 = i.row_number)
"""


@query(f"""
WITH {DOCUMENT_RESULTS_SQL}
SELECT job_id, row_number, external_id, status, response, error, attempts, latency_ms,
       sha256(job_id || ':' || chunk_no) || '.jsonl' AS chunk_key
FROM doc_results
""")
def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as files, twice, and read back."""
    root = new_folder(spark, "results")
    produced = document_results(spark, sf_dir)
    result_files.write_results(produced, root, chunks_per_group=20)
    result_files.write_results(produced, root, chunks_per_group=20)
    reference = F.concat(F.lit("jobs/"), F.col("job_id"), F.lit("/chunks/"), F.col("chunk_id"), F.lit(".jsonl"))
    return result_files.read_results(spark, root).select(
        "job_id",
        "row_number",
        "external_id",
        "status",
        "response",
        "error",
        "attempts",
        "latency_ms",
        last_segment(reference).alias("chunk_key"),
    )


@query(f"""
WITH {DOCUMENT_RESULTS_SQL},
lines AS (
  SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY row_number) AS seq,
         count(*) OVER (PARTITION BY job_id) AS n, external_id, status, response, error, attempts, latency_ms
  FROM doc_results)
SELECT job_id, seq, external_id, status, response, error, attempts, latency_ms, seq = 1 AS opens, seq = n AS closes
FROM lines
""")
def results_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The downloadable JSON array of each batch, taken apart again line by line."""
    lines = result_files.array_lines(document_results(spark, sf_dir))
    inner = F.regexp_replace("line", r"(?s)^\[?(\{.*\})[,\]]$", "$1")
    schema = "external_id string, status string, response string, error string, attempts int, latency_ms bigint"
    return lines.select(
        "job_id",
        "seq",
        F.from_json(inner, schema).alias("_r"),
        F.col("line").startswith("[").alias("opens"),
        F.col("line").endswith("]").alias("closes"),
    ).select("job_id", "seq", "_r.*", "opens", "closes")


@query(f"""
WITH {DOCUMENT_RESULTS_SQL}, {judged_sql("doc_items", max_tokens=TOKENS)}
SELECT j.job_id, j.row_number, j.external_id,
       CASE WHEN j.ok THEN r.status ELSE 'FAILED' END AS status, CASE WHEN j.ok THEN r.response END AS response,
       CASE WHEN j.ok THEN r.error ELSE j.error END AS error,
       CASE WHEN j.ok THEN 1 ELSE 0 END AS attempts, CASE WHEN j.ok THEN r.latency_ms END AS latency_ms
FROM judged j JOIN doc_results r ON j.row_number = r.row_number
""")
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed documents and those rejected at ingest together."""
    # Both sides of the report need the outcome; it is judged once and kept without texts.
    judged = materialise(
        validate(document_items(spark, sf_dir), standard_rules(max_tokens=TOKENS)).drop("prompt"), "judged"
    )
    accepted = judged.where("ok").select("job_id", "row_number")
    processed = document_results(spark, sf_dir).join(accepted, ["job_id", "row_number"], "left_semi")
    return results.full_report(processed, judged)


@query(f"""
WITH {DOCUMENT_RESULTS_SQL}
SELECT job_id, external_id, CASE WHEN quality = 0 THEN 'b.jsonl' ELSE 'a.jsonl' END AS chunk_id,
       CAST(CASE WHEN quality = 0 THEN 2 ELSE 3 END AS INTEGER) AS written, response
FROM doc_results
""")
def replay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of chunks that were processed three times: the committed chunk wins, else the latest."""
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("row_number"), "quality")
    chunk = F.when(F.col("quality") == 1, "a").when(F.col("quality") == 0, "b")
    items = (
        document_items(spark, sf_dir)
        .join(labels, "row_number", "left")
        .select(
            "job_id",
            "external_id",
            F.concat(F.lit("jobs/"), F.col("job_id"), F.lit("/chunks/"), chunk, F.lit(".jsonl")).alias("result_ref"),
        )
    )
    copies = F.array(
        *[F.struct(F.lit(c).alias("chunk_id"), F.lit(n).alias("written")) for c, n in (("a.jsonl", 1), ("b.jsonl", 2), ("a.jsonl", 3))]
    )
    replayed = document_results(spark, sf_dir).select(
        "job_id", "external_id", "response", F.explode(copies).alias("_c")
    ).select("job_id", "external_id", "_c.chunk_id", "_c.written", "response")
    return results.replay_winners(replayed, items, ["written"])
