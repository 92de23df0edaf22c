"""Numbering, running totals, percentiles and hot-key joins against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.operators.jobs import orphan_items
from promptloom.operators.prefix import number_rows, placed_rows, running_sums, running_totals
from promptloom.operators.telemetry import approximate_percentiles, exact_percentiles, inflight, peak_inflight


@pytest.fixture(autouse=True)
def several_partitions(spark):
    """Keep small data in several partitions, so that groups cross their borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def skewed():
    """Rows of (group, place, amount): half of them in one group."""
    draw = random.Random(5)
    rows = [("hot", i, draw.randint(-9, 9)) for i in range(600)]
    rows += [(f"g{draw.randint(0, 40)}", 1000 + i, draw.randint(-9, 9)) for i in range(600)]
    draw.shuffle(rows)
    return rows


def test_numbers_are_gap_free_per_group(spark, skewed):
    frame = spark.createDataFrame(skewed, "g string, p bigint, v bigint")
    got = defaultdict(list)
    for row in number_rows(frame, ["g"], ["p"], last="end").collect():
        got[row.g].append((row.p, row.seq, row.end))
    for rows in got.values():
        rows.sort()
        assert [seq for _, seq, _ in rows] == list(range(1, len(rows) + 1))
        assert [end for _, _, end in rows] == [False] * (len(rows) - 1) + [True]
    assert sum(map(len, got.values())) == len(skewed)


def test_numbers_without_groups_and_ties(spark, skewed):
    frame = spark.createDataFrame(skewed, "g string, p bigint, v bigint")
    rows = number_rows(frame, [], ["v"], last="end").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, len(skewed) + 1))
    assert [r.v for r in rows] == sorted(v for _, _, v in skewed)
    assert [r.end for r in rows] == [False] * (len(rows) - 1) + [True]


def test_hot_group_spans_partitions(spark, skewed):
    frame = spark.createDataFrame(skewed, "g string, p bigint, v bigint")
    spread = placed_rows(frame, ["g"], ["p"]).where("g = 'hot'").select("_part").distinct().count()
    assert spread > 1


@pytest.mark.parametrize("running_totals", [running_totals, running_sums])
def test_running_totals(spark, skewed, running_totals):
    frame = spark.createDataFrame(skewed, "g string, p bigint, v bigint").withColumn("w", F.col("v") * 2)
    got = {(r.g, r.p): (r.a, r.b) for r in running_totals(frame, ["g"], ["p"], {"a": "v", "b": "w"}).collect()}
    sums = defaultdict(int)
    for g, p, v in sorted(skewed):
        sums[g] += v
        assert got[g, p] == (sums[g], 2 * sums[g])


def test_running_sums_take_null_groups_and_any_batch_size(spark):
    rows = [(None if k % 3 == 0 else "g" if k % 3 == 1 else "", k % 2, k, None if k % 11 == 0 else k - 50) for k in range(200)]
    frame = spark.createDataFrame(rows, "g string, h int, p long, v long").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.g, r.h, r.p): r.s for r in running_sums(frame, ["g", "h"], ["p"], {"s": "v"}).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    sums = defaultdict(int)
    for g, h, p, v in rows:
        sums[g, h] += v or 0
        assert got[g, h, p] == sums[g, h]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_sums_move_rows_once(spark, skewed, by):
    frame = spark.createDataFrame(skewed, "g string, p bigint, v bigint")
    plan = running_sums(frame, by, ["p"], {"s": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan.split("Scan parquet")[0]


def test_empty_frames(spark):
    none = spark.createDataFrame([], "g string, p bigint, v bigint")
    assert number_rows(none, ["g"], ["p"], last="end").count() == 0
    assert running_totals(none, [], ["p"], {"t": "v"}).count() == 0
    assert running_sums(none, ["g"], ["p"], {"t": "v"}).count() == 0


def test_exact_percentiles(spark):
    draw = random.Random(6)
    groups = {"a": [draw.randint(0, 30) / 4 for _ in range(501)], "b": [3.5], "c": [draw.random() for _ in range(100)]}
    frame = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    ranks = [0.0, 0.5, 0.95, 1.0]
    got = {(r.g, r.rank): r.value for r in exact_percentiles(frame, ["g"], "v", ranks).collect()}
    for group, values in groups.items():
        for rank in ranks:
            assert got[group, rank] == pytest.approx(np.percentile(values, rank * 100))
    near = {(r.g, r.rank): r.value for r in approximate_percentiles(frame, ["g"], "v", [0.5]).collect()}
    assert near["b", 0.5] == 3.5


def test_ends_come_before_starts(spark):
    rows = [("m", 0, 10), ("m", 10, 20), ("m", 5, 10), ("n", 1, 2)]
    calls = spark.createDataFrame(rows, "model string, s bigint, e bigint").select(
        "model", F.timestamp_micros("s").alias("started_at"), F.timestamp_micros("e").alias("ended_at")
    )
    peaks = {r.model: (r.peak, r.reached_at_us) for r in peak_inflight(calls, ["model"]).collect()}
    assert peaks == {"m": (2, 5), "n": (1, 1)}
    assert inflight(calls, ["model"]).agg(F.min("open_calls")).first()[0] == 0


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_a_hot_key_below_a_thousandth_is_split_while_the_join_runs(spark, how):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        number = F.col("id")
        key = F.when(number % 1100 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (number % 50_000).cast("string")))
        items = spark.range(0, 3_000_000, 1, 16).select(key.alias("job_id"), F.sha2(number.cast("string"), 256).alias("external_id"))
        jobs = spark.createDataFrame([("hot",), ("k3",)], "job_id string")
        left = orphan_items(items, jobs) if how == "left_anti" else items.join(jobs, "job_id", how)
        counts = left.groupBy((F.col("job_id") == "hot").alias("hot")).count()
        found = {r["hot"]: r["count"] for r in counts.collect()}
        assert found == ({False: 3_000_000 - 2728 - 60} if how == "left_anti" else {True: 2728, False: 60})
        assert "skew=true" in counts._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
