"""Status, ingest, cost and failure reports. All are grouped partial aggregations."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.money import cost_usd
from promptloom.functions.text import estimated_tokens
from promptloom.operators.prefix import running_sums


def count_by_status(items: DataFrame) -> DataFrame:
    return items.groupBy("job_id", "status").agg(F.count("*").alias("items"))


def _status_count(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def job_status_report(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Each job with its total and the number of items per status, 0 where it has none.

    Items are counted before the join, so a job of any size brings one row to it.
    """
    names = {"PENDING": "pending", "CLAIMED": "in_progress", "SUCCEEDED": "succeeded", "FAILED": "failed"}
    counts = items.groupBy("job_id").agg(*[_status_count(s).alias(n) for s, n in names.items()])
    return jobs.join(counts, "job_id", "left").select(
        "job_id",
        "state",
        F.coalesce("total_items", F.lit(0)).cast("bigint").alias("total"),
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names.values()],
    )


def ingest_summary(judged: DataFrame) -> DataFrame:
    """Rows read, accepted and rejected per job (accepted is not the same as loaded)."""
    return judged.groupBy("job_id").agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("accepted"),
        F.count_if(~F.col("ok")).alias("rejected"),
    )


def ingest_results(judged: DataFrame) -> DataFrame:
    """Rows by ingest result over all jobs."""
    return judged.groupBy(F.when(F.col("ok"), "accepted").otherwise("rejected").alias("result")).agg(
        F.count("*").alias("items")
    )


def chunk_summary(results: DataFrame) -> DataFrame:
    """Rows, successes, failures and committed rows per chunk."""
    return results.groupBy("job_id", "chunk_no").agg(
        F.count("*").alias("processed"),
        _status_count("SUCCEEDED").alias("ok"),
        F.count_if(F.col("status") != "SUCCEEDED").alias("failed"),
        F.count_if("committed").alias("committed"),
    )


def chunks_per_job(results: DataFrame) -> DataFrame:
    """Distinct chunks per job; chunks are made distinct before they are counted."""
    return results.select("job_id", "chunk_no").distinct().groupBy("job_id").agg(F.count("*").alias("chunks"))


def items_by_status(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("items"))


def failure_report(failures: DataFrame) -> DataFrame:
    """Failures by message with the first failing row of each as an example."""
    return failures.groupBy("error").agg(
        F.count("*").alias("failures"), F.min_by("external_id", "row_number").alias("example_id")
    )


def token_cost(
    rows: DataFrame,
    prices: DataFrame,
    default_price: float,
    output_tokens: Column,
) -> DataFrame:
    """Token and cost totals per job and model. Tokens are summed as whole numbers first.

    ``prices`` is the price table, of any length: (model, input_price, output_price) with one
    row per model. It is joined to the totals, which have one row per job and model.
    """
    totals = rows.groupBy("job_id", "model").agg(
        F.count("*").alias("rows"),
        F.sum(estimated_tokens(F.col("prompt"))).alias("prompt_tokens"),
        F.sum(output_tokens).alias("output_tokens"),
    )
    priced = totals.join(prices.select("model", "input_price", "output_price"), "model", "left")
    input_price, output_price = (F.coalesce(name, F.lit(float(default_price))) for name in ("input_price", "output_price"))
    cost = cost_usd(F.col("prompt_tokens"), F.col("output_tokens"), input_price, output_price)
    return priced.select(*totals.columns, cost.alias("cost_usd"))


def budget_cutoff(
    rows: DataFrame, budget_usd: float, input_price: float, output_price: float, output_tokens: Column
) -> DataFrame:
    """First row of every job at which the summed cost estimate exceeds the budget.

    Works on (job_id, row_number, token counts); texts are measured before rows move.
    """
    sized = rows.select(
        "job_id",
        "row_number",
        estimated_tokens(F.col("prompt")).alias("prompt_tokens"),
        output_tokens.cast("bigint").alias("output_tokens"),
    )
    so_far = running_sums(
        sized,
        ["job_id"],
        ["row_number"],
        {"prompt_tokens_so_far": "prompt_tokens", "output_tokens_so_far": "output_tokens"},
    ).withColumn(
        "cost_so_far",
        cost_usd(
            F.col("prompt_tokens_so_far"), F.col("output_tokens_so_far"), F.lit(input_price), F.lit(output_price)
        ),
    )
    return (
        so_far.where(F.col("cost_so_far") > budget_usd)
        .groupBy("job_id")
        .agg(
            F.min("row_number").alias("row_number"),
            F.min("cost_so_far").alias("cost_so_far"),
        )
    )
