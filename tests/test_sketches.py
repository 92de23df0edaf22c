"""Sketches merged over runs against exact answers."""

import numpy as np
from pyspark.sql import functions as F

from promptloom.operators import sketches


def test_merged_percentiles_are_within_the_rank_error(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = [(f"g{k % 3}" if k % 7 else None, k % 5, float(v)) for k, v in enumerate(draw.lognormal(size=6000))] + [("nulls", 1, None)]
    frame = spark.createDataFrame(rows, "g string, h int, v double")
    for run in range(4):
        own = frame.where(F.pmod(F.hash("v", "h"), F.lit(4)) == run)
        for _ in range(2):  # storing a run again replaces it
            sketches.store_sketches(sketches.value_sketches(own, ["g", "h"], "v"), str(tmp_path), f"r{run}")
    stored = sketches.read_sketches(spark, str(tmp_path))
    assert stored.select("run_id").distinct().count() == 4
    found = sketches.merged_percentiles(stored, ["g"], [0.0, 0.5, 0.9, 1.0]).collect()
    assert {r.g for r in found} == {"g0", "g1", "g2", None}
    for r in found:
        values = np.array([v for g, _, v in rows if g == r.g])
        assert r.n == len(values)
        assert (values < r.value).mean() - 0.015 <= r["rank"] <= (values <= r.value).mean() + 0.015


def test_merged_distinct_counts(spark, tmp_path):
    rows = [("a", k % 4000, k % 3) for k in range(12000)] + [("b", 1, 1), ("b", None, 1)]
    frame = spark.createDataFrame(rows, "g string, x long, run int")
    for run in range(3):
        sketches.store_sketches(sketches.distinct_sketches(frame.where(F.col("run") == run), ["g"], "x"), str(tmp_path), f"r{run}")
    found = {r.g: (r.n, r["distinct"]) for r in sketches.merged_distinct(sketches.read_sketches(spark, str(tmp_path)), ["g"]).collect()}
    assert found["a"][0] == 12000 and abs(found["a"][1] - 4000) < 120
    assert found["b"] == (2, 2)


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert sketches.merged_percentiles(sketches.value_sketches(none, ["g"], "v"), ["g"], [0.5]).count() == 0
    assert sketches.merged_distinct(sketches.distinct_sketches(none, ["g"], "v"), ["g"]).count() == 0
