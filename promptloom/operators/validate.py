"""Validation rules and the accept / reject split.

A rule maps the item columns (``external_id``, ``prompt``) to a message, or null if the row
passes. Every rule looks at every parseable row; messages add up in rule order. Rules of
one's own may be built-in expressions or pandas UDFs, as long as they yield such a column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.text import prompt_size, strip, stripped_shorter_than
from promptloom.operators.normalize import failure_text

Rule = Callable[[], Column]

# Default limits.
MIN_CHARS = 1
MAX_TOKENS = 120_000


def id_present() -> Rule:
    return lambda: F.when(
        strip(F.coalesce(F.col("external_id"), F.lit(""))) == "", F.lit("missing or empty external id")
    )


def prompt_long_enough(min_chars: int = MIN_CHARS) -> Rule:
    return lambda: F.when(
        stripped_shorter_than(F.coalesce(F.col("prompt"), F.lit("")), min_chars),
        F.lit(f"prompt shorter than min_chars={min_chars}"),
    )


def prompt_within(max_tokens: int = MAX_TOKENS) -> Rule:
    def rule() -> Column:
        size = prompt_size(F.col("prompt"))
        text = F.concat(F.lit("prompt ~"), size.cast("string"), F.lit(f" tokens exceeds max {max_tokens}"))
        return F.when(size > max_tokens, text)

    return rule


def standard_rules(min_chars: int = MIN_CHARS, max_tokens: int = MAX_TOKENS) -> list[Rule]:
    return [id_present(), prompt_long_enough(min_chars), prompt_within(max_tokens)]


def row_messages(rules: Sequence[Rule]) -> Column:
    """Messages of the row-local rules; an empty array for a clean or malformed row."""
    none = F.array().cast("array<string>")
    if not rules:
        return none
    found = F.array_compact(F.array(*[rule().cast("string") for rule in rules]))
    return F.when(F.col("is_malformed"), none).otherwise(found)


def first_rows(items: DataFrame) -> DataFrame:
    """First parseable row of every id: (job_id, external_id, row_number).

    Malformed rows do not count; rows that fail other rules do. A minimum is combined on
    the map side, so an id repeated without end costs one row per task.
    """
    return (
        items.where(~F.col("is_malformed"))
        .groupBy("job_id", "external_id")
        .agg(F.min("row_number").alias("row_number"))
    )


def mark_repeats(items: DataFrame) -> DataFrame:
    """Add ``is_repeat``: an earlier parseable row of the job has the same id.

    The first rows are looked up by row number, which is unique in a job, and not by id:
    the copies of one id stay spread over all tasks.
    """
    firsts = first_rows(items).select("job_id", "row_number", F.lit(True).alias("_first"))
    return (
        items.join(firsts, ["job_id", "row_number"], "left")
        .withColumn("is_repeat", ~F.col("is_malformed") & F.col("_first").isNull())
        .drop("_first")
    )


def repeat_message() -> Column:
    return F.when(F.col("is_repeat"), F.concat(F.lit("duplicate external id: "), F.col("external_id")))


def with_outcome(rows: DataFrame) -> DataFrame:
    """Add ``ok, status, error`` to rows that carry their ``errors``."""
    ok = ~F.col("is_malformed") & (F.size("errors") == 0)
    return (
        rows.withColumn("ok", ok)
        .withColumn("status", F.when(F.col("ok"), "PENDING").otherwise("FAILED"))
        .withColumn("error", failure_text(F.col("is_malformed"), F.col("errors")))
    )


def validate(items: DataFrame, rules: Sequence[Rule] | None = None, reject_duplicates: bool = True) -> DataFrame:
    """Judge items: adds ``errors, ok, status, error``.

    Needs ``job_id, row_number, external_id, prompt, is_malformed``.
    """
    messages = row_messages(standard_rules() if rules is None else rules)
    if not reject_duplicates:
        return with_outcome(items.withColumn("errors", messages))
    # Texts are judged before rows move: a plan that needs no prompt does not shuffle any.
    marked = mark_repeats(items.withColumn("errors", messages))
    return with_outcome(
        marked.withColumn("errors", F.array_compact(F.concat("errors", F.array(repeat_message())))).drop("is_repeat")
    )


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("ok")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where("NOT ok")
