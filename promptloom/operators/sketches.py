"""Summaries of fixed size that are stored per run and merged later.

A percentile or a distinct count over all runs so far needs no look back at their rows: each
run stores one sketch per group, and sketches of the same group merge into the sketch of all
rows. Values: KLL sketches, whose quantiles lie within a rank error set by ``k``. Distinct
counts: HLL sketches, whose relative error is set by ``lg_k``. Both are built on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KLL_K = 800  # normalised rank error about 0.4 %
HLL_LG_K = 14  # relative standard error about 0.8 %


def hour_of(at: str) -> Column:
    return F.date_trunc("hour", at).alias("hour")


def value_sketches(rows: DataFrame, by: Sequence[str | Column], value: str, k: int = KLL_K) -> DataFrame:
    """One KLL sketch per group: (…, n, sketch). Null values don't count; a group of nulls has no row."""
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch")
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), sketch)


def merged_percentiles(sketches: DataFrame, by: Sequence[str], ranks: Sequence[float]) -> DataFrame:
    """Percentiles over all rows behind the sketches of a group: (…, rank, n, value)."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    # The function takes literal ranks only.
    found = [
        F.struct(F.lit(float(rank)).alias("rank"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(rank))).alias("value"))
        for rank in ranks
    ]
    return merged.select(*by, "n", F.explode(F.array(*found)).alias("_q")).select(*by, "_q.rank", "n", "_q.value")


def distinct_sketches(rows: DataFrame, by: Sequence[str | Column], *columns: str, lg_k: int = HLL_LG_K) -> DataFrame:
    """One HLL sketch per group of the distinct values of ``columns``: (…, n, sketch)."""
    value = F.xxhash64(*columns)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct values over all rows behind the sketches of a group: (…, n, distinct)."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, "n", F.hll_sketch_estimate("sketch").alias("distinct"))


def store_sketches(sketches: DataFrame, path: str, run_id: str) -> None:
    """Store the sketches of a run; storing a run again replaces it."""
    sketches.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The sketches of all runs, with their ``run_id``."""
    return spark.read.option("basePath", path).parquet(f"{path}/run_id=*")
