"""Attempt, latency, traffic and load figures from the attempt log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions.outcomes import RETRYABLE, SUCCESS, wait_ceiling
from promptloom.functions.text import route_template
from promptloom.operators.prefix import running_sums

# Upper bounds of the latency buckets in seconds; +Inf comes last.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def attempts_by_outcome(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("model", "outcome").agg(F.count("*").alias("attempts"))


def retries_by_model(attempts: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Retries per model: retryable failures after which another try was allowed."""
    retried = (F.col("outcome") == RETRYABLE) & (F.col("attempt") < max_attempts)
    return attempts.groupBy("model").agg(F.count_if(retried).alias("retries"))


def latency_histogram(
    attempts: DataFrame, by: Sequence[str], seconds: str = "seconds", successes_only: bool = True
) -> DataFrame:
    """Cumulative latency buckets: (…, le, calls, total_seconds, all_calls).

    One scan counts all buckets; the 15 counters of a group become rows afterwards.
    """
    rows = attempts.where(F.col("outcome") == SUCCESS) if successes_only else attempts
    counters = [F.count_if(F.col(seconds) <= bound).alias(f"_le{i}") for i, bound in enumerate(LATENCY_BOUNDS)]
    grouped = rows.groupBy(*by).agg(
        *counters, F.count("*").alias("all_calls"), F.sum(seconds).alias("total_seconds")
    )
    buckets = F.array(
        *[
            F.struct(F.lit(str(bound)).alias("le"), F.col(f"_le{i}").alias("calls"))
            for i, bound in enumerate(LATENCY_BOUNDS)
        ],
        F.struct(F.lit("+Inf").alias("le"), F.col("all_calls").alias("calls")),
    )
    return grouped.select(*by, F.explode(buckets).alias("_b"), "total_seconds", "all_calls").select(
        *by, "_b.le", "_b.calls", "total_seconds", "all_calls"
    )


def exact_percentiles(rows: DataFrame, by: Sequence[str], value: str, ranks: Sequence[float]) -> DataFrame:
    """Interpolated percentiles without holding a group's values in one task.

    Equal values are counted first; the running count over the sorted distinct values then
    tells which of them stand at the two places a percentile lies between.
    """
    counted = (
        rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    )
    placed = running_sums(counted, by, ["_v"], {"_upto": "_n"})
    sizes = counted.groupBy(*by).agg(F.sum("_n").alias("_size"))
    wanted = F.array(*[F.struct(F.lit(r).alias("rank"), (F.lit(r) * (F.col("_size") - 1)).alias("at")) for r in ranks])
    targets = sizes.select(*by, wanted.alias("_targets"))
    # A value answers the ranks that fall on its places; the group's rows are spread by value.
    low, high = F.floor("at"), F.ceil("at")
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    hits = (
        placed.join(targets, list(by))
        .select(*by, "_v", "_n", "_upto", F.explode("_targets").alias("_t"))
        .select(*by, "_v", "_n", "_upto", "_t.rank", "_t.at")
        .where(((low >= first) & (low <= last)) | ((high >= first) & (high <= last)))
    )
    share = F.max(F.col("at") - low)
    return hits.groupBy(*by, "rank").agg(
        (F.min("_v") + (F.max("_v") - F.min("_v")) * share).alias("value")
    )


def approximate_percentiles(rows: DataFrame, by: Sequence[str], value: str, ranks: Sequence[float]) -> DataFrame:
    """Percentiles from a sketch of fixed size, for dashboards."""
    values = F.percentile_approx(value, list(ranks), 10_000)
    named = F.arrays_zip(F.array(*[F.lit(r) for r in ranks]).alias("rank"), values.alias("value"))
    return rows.groupBy(*by).agg(named.alias("_p")).select(*by, F.explode("_p").alias("_p")).select(
        *by, F.col("_p.rank").alias("rank"), F.col("_p.value").alias("value")
    )


def success_rate(attempts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of successes, failures and rate-limit class errors; null without attempts."""
    total = F.count("*")

    def share(condition: Column) -> Column:
        return F.try_divide(F.count_if(condition), total)

    return attempts.groupBy(*by).agg(
        total.alias("attempts"),
        share(F.col("outcome") == SUCCESS).alias("success_share"),
        share(F.col("outcome") != SUCCESS).alias("failure_share"),
        share(F.col("outcome") == RETRYABLE).alias("retryable_share"),
    )


_MOMENTS = 10**18  # above any moment in microseconds that a timestamp can hold


def inflight(calls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Open calls after every moment at which a call starts or ends: (…, at, open_calls).

    An end takes effect before a start at the same moment. Changes at one moment are summed
    before they are put in order.
    """
    steps = F.explode(
        F.array(
            F.struct(F.col("started_at").alias("at"), F.lit(1).alias("change")),
            F.struct(F.col("ended_at").alias("at"), F.lit(-1).alias("change")),
        )
    )
    changes = (
        calls.select(*by, steps.alias("_s"))
        .groupBy(*by, F.col("_s.at").alias("at"), F.col("_s.change").alias("change"))
        .agg(F.sum("_s.change").alias("delta"))
    )
    return running_sums(changes, by, ["at", "change"], {"open_calls": "delta"}).select(*by, "at", "open_calls")


def peak_inflight(calls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest number of open calls and the moment it was first reached."""
    level = inflight(calls, by)
    # Calls and moment in one number: the largest has the most calls, then the earliest moment.
    # Such a number is compared in a hash aggregation; a struct would have to be sorted.
    unit = F.lit(_MOMENTS).cast("decimal(19,0)")
    top = F.max(F.col("open_calls").cast("decimal(18,0)") * unit - F.unix_micros("at")).alias("_top")
    peak = F.ceil(F.col("_top") / unit).cast("bigint")
    return level.groupBy(*by).agg(top).select(
        *by, peak.alias("peak"), (peak.cast("decimal(18,0)") * unit - F.col("_top")).cast("bigint").alias("reached_at_us")
    )


def attempt_gaps(attempts: DataFrame, base: float = 1.0, factor: float = 2.0, cap: float = 30.0) -> DataFrame:
    """Time between a try and the one before it, next to the longest wait allowed there.

    The previous try is found by its number: (item, attempt) is unique, so the tries of one
    item spread over all tasks.
    """
    before = attempts.select(
        "job_id", "external_id", (F.col("attempt") + 1).alias("attempt"), F.col("ended_at").alias("_before")
    )
    retry = F.col("attempt") - 2
    gap = (F.unix_micros("started_at") - F.unix_micros("_before")) / 1_000_000
    return (
        attempts.join(before, ["job_id", "external_id", "attempt"], "inner")
        .withColumn("gap_seconds", gap)
        .withColumn("ceiling_seconds", wait_ceiling(retry, base, factor, cap))
        .withColumn("within", F.col("gap_seconds") <= F.col("ceiling_seconds"))
        .drop("_before")
    )


def wait_schedule(results: DataFrame, base: float = 1.0, factor: float = 2.0, cap: float = 30.0) -> DataFrame:
    """One row per wait of a result: (…, retry, ceiling_seconds). A single try has no wait."""
    waited = results.where(F.col("attempts") >= 2)
    retries = F.explode(F.sequence(F.lit(0), F.col("attempts").cast("int") - 2))
    return waited.withColumn("retry", retries).withColumn(
        "ceiling_seconds", wait_ceiling(F.col("retry"), base, factor, cap)
    )


def traffic_by_route(requests: DataFrame) -> DataFrame:
    """Requests by method, path template and status."""
    return requests.groupBy("method", route_template(F.col("path")).alias("route"), "status").agg(
        F.count("*").alias("requests")
    )
