"""Analytics over structured JSON log lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.schemas import LOG_LINE

# Log levels from least to most severe.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")

# Fields that messages carry as key=value, with their types.
MESSAGE_FIELDS = {
    "ext_id": "string",
    "attempts": "bigint",
    "latency_ms": "bigint",
    "processed": "bigint",
    "ok": "bigint",
    "failed": "bigint",
    "committed": "bigint",
}


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Split each line into the known fields and ``extras`` (VARIANT with the whole object).

    A line that is no JSON object with level, logger and msg keeps its text in ``bad_line``.
    """
    # Filters do not pass an explode, so that each line is parsed once and not again per filter.
    parsed = lines.withColumn("extras", F.explode(F.array(F.try_parse_json(column))))
    known = {
        field.name: F.try_variant_get("extras", f"$.{field.name}", "string") for field in LOG_LINE.fields
    }
    whole = known["level"].isNotNull() & known["logger"].isNotNull() & known["msg"].isNotNull()
    rest = [name for name in lines.columns if name != column]
    return parsed.select(
        *rest,
        *[value.alias(name) for name, value in known.items()],
        F.try_to_timestamp(known["ts"]).alias("at"),
        "extras",
        F.when(~whole, F.col(column)).alias("bad_line"),
    )


def good_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("bad_line").isNull())


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("bad_line").isNotNull()).select("bad_line")


def message_fields(parsed: DataFrame, fields: Mapping[str, str] = MESSAGE_FIELDS) -> DataFrame:
    """Add the key=value fields found in ``msg``; absent ones are null."""

    def field(name: str, kind: str):
        text = F.nullif(F.regexp_extract("msg", rf"(?:^|\s){name}=(\S*)", 1), F.lit(""))
        return text if kind == "string" else text.try_cast(kind)

    return parsed.withColumns({name: field(name, kind) for name, kind in fields.items()})


def correlate(parsed: DataFrame, by: Sequence[str] = ("request_id", "job_id", "worker_id")) -> DataFrame:
    """All lines of each request, job or worker: (kind, id, lines, first_at, last_at, worst_level).

    One pass over the lines serves all kinds of ids.
    """
    levels = F.array(*[F.lit(level) for level in LEVELS])
    ids = F.array(*[F.struct(F.lit(name).alias("kind"), F.col(name).alias("id")) for name in by])
    return (
        parsed.select(F.explode(ids).alias("_id"), "at", F.array_position(levels, F.col("level")).alias("_rank"))
        .where(F.col("_id.id").isNotNull())
        .groupBy(F.col("_id.kind").alias("kind"), F.col("_id.id").alias("id"))
        .agg(
            F.count("*").alias("lines"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
            F.max("_rank").alias("_worst"),
        )
        .withColumn("worst_level", F.try_element_at(levels, F.nullif("_worst", F.lit(0)).cast("int")))
        .drop("_worst")
    )


def trace(parsed: DataFrame, by: str, value: str) -> DataFrame:
    """The lines of one request, job or worker in time order."""
    return parsed.where(F.col(by) == value).orderBy("at", "logger", "msg")


def errors_by_logger(parsed: DataFrame) -> DataFrame:
    """ERROR lines by logger and upstream message: the text after ``err=``, unchanged."""
    upstream = F.regexp_extract("msg", r"(?s)\serr=(.*)$", 1)
    return (
        parsed.where(F.col("level") == "ERROR")
        .groupBy("level", "logger", upstream.alias("error"))
        .agg(F.count("*").alias("lines"))
    )
