"""Views of the given tables as batches, items, jobs, attempts and logs.

Each view has a ``*_SQL`` twin with the same columns for the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions.text import WHITE_SPACE
from promptloom.operators.prefix import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Documents: one batch per source, the document id gives id and position.


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("job_id"),
        (F.col("doc_id") + 1).alias("row_number"),
        F.col("doc_id").cast("string").alias("external_id"),
        F.col("text").alias("prompt"),
        F.col("text").isNull().alias("is_malformed"),
        F.col("lang").alias("model"),
    )


DOCUMENT_ITEMS_SQL = """
doc_items AS (
  SELECT source AS job_id, doc_id + 1 AS row_number, CAST(doc_id AS VARCHAR) AS external_id,
         text AS prompt, text IS NULL AS is_malformed, lang AS model
  FROM documents)
"""


# Conversations: one batch, ids repeat with every turn; system texts stand for malformed rows.


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    system = F.col("role") == "system"
    return number_rows(turns, [], ["conv_id", "turn"], "row_number").select(
        F.lit("conversations").alias("job_id"),
        "row_number",
        F.col("conv_id").cast("string").alias("external_id"),
        F.when(~system, F.col("text")).alias("prompt"),
        (system | F.col("text").isNull()).alias("is_malformed"),
    )


CONVERSATION_ITEMS_SQL = """
conv_items AS (
  SELECT 'conversations' AS job_id, row_number() OVER (ORDER BY conv_id, turn) AS row_number,
         CAST(conv_id AS VARCHAR) AS external_id,
         CASE WHEN role <> 'system' THEN text END AS prompt,
         role = 'system' OR text IS NULL AS is_malformed
  FROM conversations)
"""


def judged_sql(items: str, min_chars: int = 1, max_tokens: int = 120_000) -> str:
    """CTE ``judged``: the rules as SQL over a CTE with the item columns."""
    return f"""
first_rows AS (
  SELECT job_id, external_id, min(row_number) AS first_row FROM {items}
  WHERE NOT is_malformed GROUP BY 1, 2),
ruled AS (
  SELECT i.*, f.first_row,
         CASE WHEN trim(i.external_id, '{WHITE_SPACE}') = '' THEN 'missing or empty external id' END AS e1,
         CASE WHEN length(trim(i.prompt, '{WHITE_SPACE}')) < {min_chars}
              THEN 'prompt shorter than min_chars={min_chars}' END AS e2,
         CASE WHEN length(i.prompt) // 4 > {max_tokens}
              THEN 'prompt ~' || (length(i.prompt) // 4) || ' tokens exceeds max {max_tokens}' END AS e3,
         CASE WHEN i.row_number > f.first_row THEN 'duplicate external id: ' || i.external_id END AS e4
  FROM {items} i LEFT JOIN first_rows f ON i.job_id = f.job_id AND i.external_id = f.external_id),
counted AS (
  SELECT *, CASE WHEN is_malformed THEN 0 ELSE
           (e1 IS NOT NULL)::INT + (e2 IS NOT NULL)::INT + (e3 IS NOT NULL)::INT + (e4 IS NOT NULL)::INT
         END AS messages
  FROM ruled),
judged AS (
  SELECT *, NOT is_malformed AND messages = 0 AS ok,
         CASE WHEN NOT is_malformed AND messages = 0 THEN 'PENDING' ELSE 'FAILED' END AS status,
         CASE WHEN is_malformed THEN 'validation: malformed item (missing/invalid prompt)'
              WHEN messages > 0 THEN 'validation: ' || concat_ws('; ', e1, e2, e3, e4) END AS error
  FROM counted)
"""


def winners_sql(flush_rows: int) -> str:
    """CTE ``won``: which judged row gets each id."""
    return f"""
won AS (
  SELECT *, row_number() OVER (
           PARTITION BY job_id, external_id
           ORDER BY (row_number - 1) // {flush_rows}, status = 'FAILED', row_number) = 1 AS is_winner
  FROM judged)
"""


# Orders as jobs, lineitems as their items.


def _choice(column: str, names: dict[str, str], other: str | None = None) -> Column:
    chosen = F.lit(None).cast("string") if other is None else F.lit(other)
    for value, name in reversed(names.items()):
        chosen = F.when(F.col(column) == value, name).otherwise(chosen)
    return chosen


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("job_id"),
        _choice("o_orderstatus", {"F": "COMPLETED", "O": "RUNNING"}, "INGESTING").alias("state"),
        F.floor(F.col("o_totalprice") / 100_000).cast("int").alias("total_items"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("model"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


ORDER_JOBS_SQL = """
jobs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS job_id,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'INGESTING' END AS state,
         CAST(floor(o_totalprice / 100000) AS INTEGER) AS total_items,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS model,
         o_orderdate AS created_at
  FROM orders)
"""


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    status = (
        F.when(F.col("l_returnflag") == "A", "SUCCEEDED")
        .when(F.col("l_returnflag") == "R", "FAILED")
        .when(F.col("l_linestatus") == "O", "PENDING")
        .otherwise("CLAIMED")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("job_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("external_id"),
        status.alias("status"),
        F.lit(0).alias("attempts"),
        F.col("l_suppkey").cast("string").alias("worker_id"),
        F.col("l_shipdate").cast("timestamp").alias("lease_until"),
        F.lit(None).cast("string").alias("chunk_id"),
        F.lit(None).cast("string").alias("result_ref"),
        F.lit(None).cast("string").alias("error"),
    )


LINE_ITEMS_SQL = """
items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS job_id,
         concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))
           AS external_id,
         CASE WHEN l_returnflag = 'A' THEN 'SUCCEEDED' WHEN l_returnflag = 'R' THEN 'FAILED'
              WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'CLAIMED' END AS status,
         CAST(l_suppkey AS VARCHAR) AS worker_id, l_shipdate AS lease_until,
         l_linenumber, l_discount, l_tax
  FROM lineitem)
"""

AS_OF = "1998-09-02 00:00:00"

OPEN_SQL = f"(status = 'PENDING' OR (status = 'CLAIMED' AND lease_until < TIMESTAMP '{AS_OF}'))"


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


# Events as an attempt log: a user's events of one day are the tries of one item.


def event_attempts(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    started = F.unix_micros(F.col("ts").cast("timestamp"))
    taken = F.round(F.col("value") * 10_000).cast("bigint")
    outcome = _choice("event_type", {"error": "retryable_error", "signup": "permanent_error"}, "success")
    attempts = events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("job_id"),
        F.col("user_id").cast("string").alias("external_id"),
        F.concat(F.lit("model-"), (k % 3).cast("string")).alias("model"),
        outcome.alias("outcome"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("upstream busy "), (k % 5).cast("string")))
        .when(F.col("event_type") == "signup", F.lit("request refused"))
        .alias("error"),
        F.when(
            ~F.col("event_type").isin("error", "signup"), F.concat(F.lit("answer "), F.col("event_id").cast("string"))
        ).alias("response"),
        F.timestamp_micros(started).alias("started_at"),
        F.timestamp_micros(started + taken).alias("ended_at"),
        (F.col("value") / 100).alias("seconds"),
        "event_id",
    )
    if not numbered:
        return attempts
    return number_rows(attempts, ["job_id", "external_id"], ["started_at", "event_id"], "attempt")


EVENT_ATTEMPTS_SQL = """
attempts AS (
  SELECT strftime(ts, '%Y-%m-%d') AS job_id, CAST(user_id AS VARCHAR) AS external_id,
         'model-' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS VARCHAR) AS model,
         CASE event_type WHEN 'error' THEN 'retryable_error' WHEN 'signup' THEN 'permanent_error'
              ELSE 'success' END AS outcome,
         CASE event_type
              WHEN 'error' THEN 'upstream busy ' ||
                CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR)
              WHEN 'signup' THEN 'request refused' END AS error,
         CASE WHEN event_type NOT IN ('error', 'signup')
              THEN 'answer ' || CAST(event_id AS VARCHAR) END AS response,
         epoch_us(ts) AS started_us,
         epoch_us(ts) + CAST(round(value * 10000) AS BIGINT) AS ended_us,
         value / 100 AS seconds, event_id,
         row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id ORDER BY ts, event_id) AS attempt
  FROM events)
"""


# Events as structured log lines; purchases stand for lines that are no JSON.

LOG_LEVELS = {"view": "INFO", "click": "INFO", "error": "ERROR", "signup": "WARNING"}


def event_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    message = (
        F.when(
            kind == "view",
            F.concat(F.lit("row ok ext_id="), user, F.lit(" attempts="), k % 5 + 1, F.lit(" latency_ms="), k * 10),
        )
        .when(
            kind == "click",
            F.concat(
                F.lit("chunk done processed=50 ok="), 50 - k % 7, F.lit(" failed="), k % 7, F.lit(" committed=50")
            ),
        )
        .when(
            kind == "error",
            F.concat(F.lit("row failed ext_id="), user, F.lit(" attempts=5 err=upstream said: \"busy\" "), k % 5),
        )
        .otherwise(F.concat(F.lit("retryable failure ext_id="), user, F.lit(" attempts="), k % 4 + 1, F.lit(" err=slow")))
    )
    line = F.to_json(
        F.struct(
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"),
            _choice("event_type", LOG_LEVELS).alias("level"),
            F.when(kind == "click", "loom.engine").otherwise("loom.rows").alias("logger"),
            message.alias("msg"),
            F.when(kind != "click", F.concat(F.lit("req-"), F.col("event_id").cast("string"))).alias("request_id"),
            F.date_format("ts", "yyyy-MM-dd").alias("job_id"),
            F.concat(F.lit("w"), F.pmod("user_id", F.lit(4)).cast("string")).alias("worker_id"),
            k.alias("k"),
        )
    )
    cut = F.concat(F.lit("{\"ts\": \"line cut off at "), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(kind == "purchase", cut).otherwise(line).alias("value")
    )


EVENT_LOG_SQL = """
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
log AS (
  SELECT event_id, epoch_us(ts) AS at_us,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
         CASE WHEN event_type = 'click' THEN 'loom.engine' ELSE 'loom.rows' END AS logger,
         CASE event_type
           WHEN 'view' THEN 'row ok ext_id=' || user_id || ' attempts=' || (k % 5 + 1) || ' latency_ms=' || (k * 10)
           WHEN 'click' THEN 'chunk done processed=50 ok=' || (50 - k % 7) || ' failed=' || (k % 7) || ' committed=50'
           WHEN 'error' THEN 'row failed ext_id=' || user_id || ' attempts=5 err=upstream said: "busy" ' || (k % 5)
           ELSE 'retryable failure ext_id=' || user_id || ' attempts=' || (k % 4 + 1) || ' err=slow' END AS msg,
         CASE WHEN event_type <> 'click' THEN 'req-' || event_id END AS request_id,
         strftime(ts, '%Y-%m-%d') AS job_id, 'w' || (user_id % 4) AS worker_id, k, event_type, user_id
  FROM raw WHERE event_type <> 'purchase')
"""


# Events as HTTP requests.


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = _choice("event_type", {"view": "/results", "click": "/status"}, "")
    return table(spark, sf_dir, "events").select(
        _choice("event_type", {"purchase": "POST", "signup": "POST"}, "GET").alias("method"),
        F.concat(F.lit("/jobs/"), F.col("user_id").cast("string"), suffix).alias("path"),
        _choice("event_type", {"error": "500", "signup": "404"}, "200").alias("status"),
        (F.col("value") / 100).alias("seconds"),
    )


EVENT_REQUESTS_SQL = """
requests AS (
  SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
         '/jobs/{id}' || CASE event_type WHEN 'view' THEN '/results' WHEN 'click' THEN '/status' ELSE '' END AS route,
         CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '404' ELSE '200' END AS status,
         value / 100 AS seconds
  FROM events)
"""
