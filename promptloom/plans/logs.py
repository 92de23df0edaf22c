"""Log analytics over lines made from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.operators import logs
from promptloom.plans.registry import query
from promptloom.plans.tables import EVENT_LOG_SQL, event_log_lines
from promptloom.session import new_folder
from promptloom.streaming.runs import run_available, stream_table
from promptloom.streaming.sessions import log_sessions

SILENCE, SILENCE_US = "30 seconds", 30_000_000


@query(f"""
WITH {EVENT_LOG_SQL}
SELECT event_id, at_us, level, logger, msg, request_id, job_id, worker_id, k FROM log
""")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed lines with their fields and one extra."""
    good = logs.good_lines(logs.parse_lines(event_log_lines(spark, sf_dir)))
    return good.select(
        "event_id",
        F.unix_micros("at").alias("at_us"),
        "level",
        "logger",
        "msg",
        "request_id",
        "job_id",
        "worker_id",
        F.try_variant_get("extras", "$.k", "int").alias("k"),
    )


@query("""SELECT '{"ts": "line cut off at ' || event_id AS bad_line FROM events WHERE event_type = 'purchase'""")
def log_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no log records."""
    return logs.quarantined(logs.parse_lines(event_log_lines(spark, sf_dir)))


@query(f"""
WITH {EVENT_LOG_SQL}
SELECT event_id,
  CASE WHEN event_type <> 'click' THEN CAST(user_id AS VARCHAR) END AS ext_id,
  CAST(CASE event_type WHEN 'view' THEN k % 5 + 1 WHEN 'error' THEN 5 WHEN 'signup' THEN k % 4 + 1 END AS BIGINT) AS attempts,
  CAST(CASE event_type WHEN 'view' THEN k * 10 END AS BIGINT) AS latency_ms,
  CAST(CASE event_type WHEN 'click' THEN 50 END AS BIGINT) AS processed,
  CAST(CASE event_type WHEN 'click' THEN 50 - k % 7 END AS BIGINT) AS ok,
  CAST(CASE event_type WHEN 'click' THEN k % 7 END AS BIGINT) AS failed,
  CAST(CASE event_type WHEN 'click' THEN 50 END AS BIGINT) AS committed
FROM log
""")
def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key=value fields of every message."""
    good = logs.good_lines(logs.parse_lines(event_log_lines(spark, sf_dir)))
    return logs.message_fields(good).select("event_id", *logs.MESSAGE_FIELDS)


def _worst(by: str) -> str:
    return f"""
SELECT '{by}' AS kind, {by} AS id, count(*) AS lines, min(at_us) AS first_us, max(at_us) AS last_us,
       CASE max(CASE level WHEN 'ERROR' THEN 4 WHEN 'WARNING' THEN 3 ELSE 2 END)
         WHEN 4 THEN 'ERROR' WHEN 3 THEN 'WARNING' ELSE 'INFO' END AS worst_level
FROM log WHERE {by} IS NOT NULL GROUP BY {by}
"""


@query(f"WITH {EVENT_LOG_SQL} {_worst('job_id')} UNION ALL {_worst('worker_id')} UNION ALL {_worst('request_id')}")
def log_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every job, worker and request: how many, from when to when, worst level."""
    good = logs.good_lines(logs.parse_lines(event_log_lines(spark, sf_dir)))
    return logs.correlate(good).select(
        "kind",
        "id",
        "lines",
        F.unix_micros("first_at").alias("first_us"),
        F.unix_micros("last_at").alias("last_us"),
        "worst_level",
    )


@query(f"""
WITH {EVENT_LOG_SQL}
SELECT level, logger, 'upstream said: "busy" ' || (k % 5) AS error, count(*) AS lines
FROM log WHERE level = 'ERROR' GROUP BY 1, 2, 3
""")
def log_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error lines by logger and upstream message."""
    return logs.errors_by_logger(logs.good_lines(logs.parse_lines(event_log_lines(spark, sf_dir))))


@query(f"""
WITH {EVENT_LOG_SQL},
marked AS (
  SELECT worker_id AS id, at_us, level,
         CASE WHEN at_us > lag(at_us) OVER (PARTITION BY worker_id ORDER BY at_us) + {SILENCE_US} THEN 1 ELSE 0 END AS new
  FROM log),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY at_us) AS session FROM marked),
sessions AS (
  SELECT id, session, min(at_us) AS first_us, max(at_us) AS last_us, count(*) AS lines,
         CASE max(CASE level WHEN 'ERROR' THEN 4 WHEN 'WARNING' THEN 3 ELSE 2 END)
           WHEN 4 THEN 'ERROR' WHEN 3 THEN 'WARNING' ELSE 'INFO' END AS worst_level
  FROM numbered GROUP BY 1, 2)
SELECT id, first_us, last_us, lines, worst_level FROM sessions
WHERE last_us + {SILENCE_US} <= (SELECT max(at_us) FROM log) // 1000 * 1000 - 600000000
""")
def stream_log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of lines by worker that silence has closed, each emitted once by a stream."""
    root = new_folder(spark, "log-sessions")
    event_log_lines(spark, sf_dir).select("value").write.parquet(f"{root}/lines.parquet")
    parsed = logs.good_lines(logs.parse_lines(stream_table(spark, root, "lines.parquet")))
    found = log_sessions(parsed, "worker_id", SILENCE)
    run_available(found.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/checkpoint")
    return spark.read.schema(found.schema).parquet(f"{root}/out").select(
        "id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "lines", "worst_level"
    )
