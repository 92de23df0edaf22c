"""Checks that concern a whole batch, and row checks that depend on the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.functions.money import cost_usd
from promptloom.functions.text import estimated_tokens
from promptloom.operators.prefix import MOST_BROADCAST_ROWS
from promptloom.operators.validate import Rule

# Default limits.
MAX_ITEMS = 200_000
BUDGET_USD = 50.0
OUTPUT_TOKENS = 2048

# An unfilled placeholder looks like {name}.
PLACEHOLDER = r"\{[A-Za-z_][A-Za-z0-9_]*\}"


def batch_limits(
    items: DataFrame,
    input_price: float,
    output_price: float,
    max_items: int = MAX_ITEMS,
    budget_usd: float = BUDGET_USD,
    output_tokens: int = OUTPUT_TOKENS,
) -> DataFrame:
    """Size and projected cost of each batch against its limits."""
    totals = items.groupBy("job_id").agg(
        F.count("*").alias("items"), F.sum(estimated_tokens(F.col("prompt"))).alias("prompt_tokens")
    )
    cost = cost_usd(
        F.col("prompt_tokens"), F.col("items") * output_tokens, F.lit(input_price), F.lit(output_price)
    )
    return totals.select(
        "job_id",
        "items",
        (F.col("items") > max_items).alias("too_many_items"),
        cost.alias("projected_usd"),
        (cost > budget_usd).alias("over_budget"),
    )


def with_windows(items: DataFrame, windows: DataFrame) -> DataFrame:
    """Items with the context window of their model: ``windows`` is (model, window), of any length.

    Models are few and texts long, so the windows go to the texts if they were counted and
    found small; a hot model would otherwise bring its texts to one task.
    """
    known = windows.select("model", F.col("window").alias("context_window"))
    if known.limit(MOST_BROADCAST_ROWS + 1).count() <= MOST_BROADCAST_ROWS:
        known = F.broadcast(known)
    return items.join(known, "model", "left")


def fits_context(output_tokens: int = OUTPUT_TOKENS, window: int | None = None) -> Rule:
    """Row rule: prompt plus output must fit the context window.

    That is ``window`` for all rows, or the row's ``context_window`` (see ``with_windows``).
    """

    def rule():
        limit = F.col("context_window") if window is None else F.lit(window)
        need = estimated_tokens(F.col("prompt")) + output_tokens
        return F.when(
            need > limit,
            F.concat(
                F.lit("prompt and output need "), need.cast("string"), F.lit(" tokens, window is "), limit.cast("string")
            ),
        )

    return rule


def no_placeholder() -> Rule:
    """Row rule: the prompt holds no unfilled ``{name}`` placeholder."""

    def rule():
        found = F.regexp_extract("prompt", PLACEHOLDER, 0)
        return F.when(found != "", F.concat(F.lit("unfilled placeholder: "), found))

    return rule


def unknown_models(jobs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Jobs whose model is not in the list of allowed ones."""
    return jobs.join(allowed.select("model"), "model", "left_anti")


def batches_with_repeats(items: DataFrame) -> DataFrame:
    """Batches to refuse when repeated ids are not tolerated: (job_id, repeated_ids, surplus_rows)."""
    return (
        items.where(~F.col("is_malformed"))
        .groupBy("job_id", "external_id")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > 1)
        .groupBy("job_id")
        .agg(F.count("*").alias("repeated_ids"), F.sum(F.col("_n") - 1).alias("surplus_rows"))
    )
