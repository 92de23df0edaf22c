"""Figures from the attempt log, costs and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions.outcomes import outcome_class, retryable_status, wait_ceiling
from promptloom.functions.text import route_template
from promptloom.operators import reports, sketches, telemetry
from promptloom.operators.results import collapse_attempts
from promptloom.plans.registry import query
from promptloom.plans.tables import (
    DOCUMENT_ITEMS_SQL,
    EVENT_ATTEMPTS_SQL,
    EVENT_REQUESTS_SQL,
    document_items,
    event_attempts,
    event_requests,
    table,
)
from promptloom.session import new_folder

_ROLLED_SQL = f"""
{EVENT_ATTEMPTS_SQL},
rolled AS (
  SELECT job_id, external_id,
         CASE WHEN arg_max(outcome, attempt) = 'success' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
         arg_max(coalesce(response, ''), attempt) AS last_response, arg_max(coalesce(error, ''), attempt) AS last_error,
         CAST(max(attempt) AS INTEGER) AS attempts, (max(ended_us) - min(started_us)) // 1000 AS latency_ms
  FROM attempts GROUP BY 1, 2)
"""


@query(f"""
WITH {_ROLLED_SQL}
SELECT job_id, external_id, status, CASE WHEN status = 'SUCCEEDED' THEN last_response END AS response,
       CASE WHEN status = 'FAILED' THEN last_error END AS error, attempts, latency_ms
FROM rolled
""")
def attempt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per item out of its tries."""
    return collapse_attempts(event_attempts(spark, sf_dir, numbered=True))


@query(f"WITH {_ROLLED_SQL} SELECT status, count(*) AS items FROM rolled GROUP BY 1")
def items_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed items by final status."""
    return reports.items_by_status(collapse_attempts(event_attempts(spark, sf_dir, numbered=True)))


@query(f"WITH {EVENT_ATTEMPTS_SQL} SELECT model, outcome, count(*) AS attempts FROM attempts GROUP BY 1, 2")
def attempts_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tries by model and outcome."""
    return telemetry.attempts_by_outcome(event_attempts(spark, sf_dir))


@query(f"""
WITH {EVENT_ATTEMPTS_SQL}
SELECT model, count(*) FILTER (WHERE outcome = 'retryable_error' AND attempt < 5) AS retries FROM attempts GROUP BY 1
""")
def retries_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries by model."""
    return telemetry.retries_by_model(event_attempts(spark, sf_dir, numbered=True))


def _histogram_sql(source: str, by: str) -> str:
    bounds = ", ".join(f"('{b}', {b}::DOUBLE)" for b in telemetry.LATENCY_BOUNDS)
    return f"""
SELECT {by}, le, count(*) FILTER (WHERE seconds <= bound) AS calls,
       round(sum(seconds), 6) AS total_seconds, count(*) AS all_calls
FROM {source}, (VALUES {bounds}, ('+Inf', 'Infinity'::DOUBLE)) AS b(le, bound) GROUP BY {by}, le
"""


@query(f"WITH {EVENT_ATTEMPTS_SQL} {_histogram_sql("(SELECT * FROM attempts WHERE outcome = 'success') AS s", 'model')}")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative latency buckets of successful tries by model."""
    rows = telemetry.latency_histogram(event_attempts(spark, sf_dir), ["model"])
    return rows.withColumn("total_seconds", F.round("total_seconds", 6))


@query(f"WITH {EVENT_REQUESTS_SQL} {_histogram_sql('requests', 'method, route')}")
def request_latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative latency buckets of requests by method and route."""
    requests = event_requests(spark, sf_dir).withColumn("route", route_template(F.col("path")))
    rows = telemetry.latency_histogram(requests, ["method", "route"], successes_only=False)
    return rows.withColumn("total_seconds", F.round("total_seconds", 6))


@query(f"""
WITH {EVENT_ATTEMPTS_SQL},
q AS (SELECT model, quantile_cont(seconds, [0.5, 0.95, 0.99]) AS v FROM attempts WHERE outcome = 'success' GROUP BY 1)
SELECT model, unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS rank,
       round(unnest(v), 6) AS value FROM q
""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact latency percentiles of successful tries by model."""
    rows = event_attempts(spark, sf_dir).where(F.col("outcome") == "success")
    exact = telemetry.exact_percentiles(rows, ["model"], "seconds", [0.5, 0.95, 0.99])
    return exact.withColumn("value", F.round("value", 6))


RUNS = 3
RANK_ERROR = 0.01


@query(f"""
WITH {EVENT_ATTEMPTS_SQL}
SELECT model, unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS rank, count(*) AS calls, true AS holds
FROM attempts WHERE outcome = 'success' GROUP BY model
""")
def latency_sketch_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from sketches by model and hour of several runs, held against the ranks of all values."""
    path = new_folder(spark, "latency-sketches")
    rows = event_attempts(spark, sf_dir).where(F.col("outcome") == "success")
    for run in range(RUNS):
        own = rows.where(F.pmod(F.xxhash64("job_id", "external_id"), F.lit(RUNS)) == run)
        sketches.store_sketches(sketches.value_sketches(own, ["model", sketches.hour_of("started_at")], "seconds"), path, f"r{run}")
    found = sketches.merged_percentiles(sketches.read_sketches(spark, path), ["model"], [0.5, 0.95, 0.99])
    placed = rows.join(F.broadcast(found), "model").groupBy("model", "rank", "n").agg(
        F.count_if(F.col("seconds") < F.col("value")).alias("below"), F.count_if(F.col("seconds") <= F.col("value")).alias("upto"), F.count("*").alias("calls")
    )
    low, high = F.col("below") / F.col("calls") - RANK_ERROR, F.col("upto") / F.col("calls") + RANK_ERROR
    holds = (F.col("n") == F.col("calls")) & (low <= F.col("rank")) & (F.col("rank") <= high)
    return placed.select("model", "rank", "calls", holds.alias("holds"))


@query(f"""
WITH {EVENT_ATTEMPTS_SQL}
SELECT model, count(*) AS attempts,
       round(count(*) FILTER (WHERE outcome = 'success') / count(*), 9) AS success_share,
       round(count(*) FILTER (WHERE outcome <> 'success') / count(*), 9) AS failure_share,
       round(count(*) FILTER (WHERE outcome = 'retryable_error') / count(*), 9) AS retryable_share
FROM attempts GROUP BY 1
""")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of outcomes by model."""
    rates = telemetry.success_rate(event_attempts(spark, sf_dir), ["model"])
    shares = ("success_share", "failure_share", "retryable_share")
    return rates.withColumns({name: F.round(name, 9) for name in shares})


@query(f"""
WITH {EVENT_ATTEMPTS_SQL},
steps AS (
  SELECT model, started_us AS moment, 1 AS step FROM attempts
  UNION ALL SELECT model, ended_us, -1 FROM attempts),
changes AS (SELECT model, moment, step, sum(step) AS delta FROM steps GROUP BY 1, 2, 3),
levels AS (SELECT model, moment, sum(delta) OVER (PARTITION BY model ORDER BY moment, step) AS open_calls FROM changes),
peaks AS (SELECT model, max(open_calls) AS peak FROM levels GROUP BY 1)
SELECT p.model, CAST(peak AS BIGINT) AS peak, min(moment) AS reached_at_us
FROM peaks p JOIN levels l ON l.model = p.model AND l.open_calls = p.peak GROUP BY 1, 2
""")
def peak_inflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most calls open at one time by model."""
    return telemetry.peak_inflight(event_attempts(spark, sf_dir), ["model"])


@query(f"""
WITH {EVENT_ATTEMPTS_SQL},
paired AS (
  SELECT *, lag(ended_us) OVER (PARTITION BY job_id, external_id ORDER BY attempt) AS before_us FROM attempts)
SELECT job_id, external_id, attempt, (started_us - before_us) / 1000000 AS gap_seconds,
       least(30.0::DOUBLE, pow(2.0::DOUBLE, attempt - 2)) AS ceiling_seconds,
       (started_us - before_us) / 1000000 <= least(30.0::DOUBLE, pow(2.0::DOUBLE, attempt - 2)) AS within
FROM paired WHERE before_us IS NOT NULL
""")
def attempt_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits between tries against the longest allowed wait."""
    gaps = telemetry.attempt_gaps(event_attempts(spark, sf_dir, numbered=True))
    return gaps.select("job_id", "external_id", "attempt", "gap_seconds", "ceiling_seconds", "within")


@query(f"""
WITH {_ROLLED_SQL},
waits AS (SELECT unnest(range(0, attempts - 1)) AS retry FROM rolled WHERE attempts >= 2)
SELECT CAST(retry AS INTEGER) AS retry, least(30.0::DOUBLE, pow(2.0::DOUBLE, retry)) AS ceiling_seconds,
       count(*) AS waits FROM waits GROUP BY 1, 2
""")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits of all items by retry number with their ceilings."""
    results = collapse_attempts(event_attempts(spark, sf_dir, numbered=True))
    return telemetry.wait_schedule(results).groupBy("retry", "ceiling_seconds").agg(F.count("*").alias("waits"))


_CODE = "400 + CAST(json_extract_string(props, '$.k') AS INTEGER) * 3 // 2"


@query(f"""
WITH coded AS (
  SELECT event_id, {_CODE} AS code,
         CASE event_type WHEN 'error' THEN 'status' WHEN 'signup' THEN 'timeout' WHEN 'purchase' THEN 'parse' END AS kind
  FROM events)
SELECT event_id, code IN (429, 500, 502, 503, 504) AS retryable_code,
       CASE WHEN kind IS NULL THEN 'success' WHEN kind = 'timeout' THEN 'retryable_error'
            WHEN kind = 'status' AND (code >= 500 OR code = 429) THEN 'retryable_error'
            WHEN kind = 'status' THEN 'permanent_error' ELSE 'unexpected' END AS outcome
FROM coded
""")
def outcome_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome class of calls that end in a status code, a time-out or something unknown."""
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.lit(400) + F.floor(k * 3 / 2)
    kind = (
        F.when(F.col("event_type") == "error", "status")
        .when(F.col("event_type") == "signup", "timeout")
        .when(F.col("event_type") == "purchase", "parse")
    )
    return table(spark, sf_dir, "events").select(
        "event_id", retryable_status(code).alias("retryable_code"), outcome_class(kind, code).alias("outcome")
    )


@query(f"""
WITH {EVENT_REQUESTS_SQL} SELECT method, route, status, count(*) AS requests FROM requests GROUP BY 1, 2, 3
""")
def traffic_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by method, route and status."""
    return telemetry.traffic_by_route(event_requests(spark, sf_dir))


@query(r"""
WITH paths AS (
  SELECT regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') AS path
  FROM pages),
routes AS (
  SELECT regexp_replace(regexp_replace(path, '/[0-9]+(/|$)', '/{id}\1', 'g'), '/[0-9]+(/|$)', '/{id}\1', 'g') AS route
  FROM paths)
SELECT route, count(*) AS pages FROM routes GROUP BY 1
""")
def route_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the route of their address."""
    routes = table(spark, sf_dir, "pages").select(route_template(F.col("url")).alias("route"))
    return routes.groupBy("route").agg(F.count("*").alias("pages"))


@query(f"""
WITH {EVENT_ATTEMPTS_SQL}
SELECT error, count(*) AS failures, CAST(arg_min(external_id, event_id) AS VARCHAR) AS example_id
FROM attempts WHERE error IS NOT NULL GROUP BY 1
""")
def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by message with an example."""
    failed = event_attempts(spark, sf_dir).where(F.col("error").isNotNull())
    return reports.failure_report(failed.withColumnRenamed("event_id", "row_number"))


PRICES = [("en", 0.5, 1.5), ("fr", 0.75, 2.0), ("de", 1.0, None)]

_TOKENS_SQL = "CASE WHEN length(prompt) = 0 THEN 0 ELSE greatest(1, length(prompt) // 4) END"


@query(f"""
WITH {DOCUMENT_ITEMS_SQL},
totals AS (
  SELECT job_id, model, count(*) AS rows, CAST(sum({_TOKENS_SQL}) AS BIGINT) AS prompt_tokens,
         CAST(count(*) * 5 AS BIGINT) AS output_tokens
  FROM doc_items GROUP BY 1, 2)
SELECT *, round(prompt_tokens / 1000000 * CASE model WHEN 'en' THEN 0.5::DOUBLE WHEN 'fr' THEN 0.75 WHEN 'de' THEN 1.0 ELSE 2.5 END
       + output_tokens / 1000000 * CASE model WHEN 'en' THEN 1.5::DOUBLE WHEN 'fr' THEN 2.0 ELSE 2.5 END, 9) AS cost_usd
FROM totals
""")
def token_cost_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost by batch and model."""
    prices = spark.createDataFrame(PRICES, "model string, input_price double, output_price double")
    costs = reports.token_cost(document_items(spark, sf_dir), prices, 2.5, F.lit(5))
    return costs.withColumn("cost_usd", F.round("cost_usd", 9))


@query(f"""
WITH {DOCUMENT_ITEMS_SQL},
so_far AS (
  SELECT job_id, row_number, sum({_TOKENS_SQL}) OVER w AS p, sum(2048) OVER w AS o
  FROM doc_items WINDOW w AS (PARTITION BY job_id ORDER BY row_number)),
costed AS (SELECT *, p / 1000000 * 0.5::DOUBLE + o / 1000000 * 1.5::DOUBLE AS cost FROM so_far)
SELECT job_id, min(row_number) AS row_number, round(min(cost), 9) AS cost_so_far
FROM costed WHERE cost > 0.1 GROUP BY 1
""")
def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document at which each batch would exceed its budget."""
    cut = reports.budget_cutoff(document_items(spark, sf_dir), 0.1, 0.5, 1.5, F.lit(2048))
    return cut.withColumn("cost_so_far", F.round("cost_so_far", 9))
