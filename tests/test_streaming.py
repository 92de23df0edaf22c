"""Streams against their batch answers, over several micro-batches and restarts."""

import time

import pytest
from pyspark.sql import functions as F

from promptloom.operators import load
from promptloom.plans.clients import FlakyClient
from promptloom.plans.inference import NO_WAIT, flaky_requests
from promptloom.streaming import duplicates, progress
from promptloom.streaming.inference import infer_stream, read_stream_results
from promptloom.sources.items import known_items, load_items, read_items, read_loads
from promptloom.streaming.ingest import ingest_stream
from promptloom.streaming.runs import run_available, stream_table

ITEMS = "job_id string, row_number bigint, external_id string, prompt string, is_malformed boolean"


@pytest.fixture
def batches(spark, tmp_path):
    """Four files, each a batch with repeats and malformed rows of its own."""
    folder = str(tmp_path / "items.parquet")
    for job in range(4):
        rows = [
            (f"job{job}", n, f"e{n % 7}", None if n % 5 == 0 else f"text {n}", n % 5 == 0) for n in range(1, 31)
        ]
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(folder)
    return tmp_path


def test_ingest_equals_batch_and_is_idempotent(spark, batches):
    source = str(batches)
    path = f"{source}/table"
    stream = stream_table(spark, source, "items.parquet", files_per_trigger=1)
    run_available(ingest_stream(stream, path), f"{source}/ck1")
    stored = read_items(spark, path)
    assert stored.select("run_id", "epoch").distinct().count() == 4
    whole = load.item_rows(load.judge_and_load(spark.read.parquet(f"{source}/items.parquet")))
    expected = sorted(map(tuple, whole.collect()), key=str)
    assert sorted(map(tuple, stored.drop("run_id", "epoch").collect()), key=str) == expected

    run_available(ingest_stream(stream, path), f"{source}/ck1")  # restart: nothing new
    run_available(ingest_stream(stream, path), f"{source}/ck2")  # handed in again
    again = read_items(spark, path)
    assert sorted(map(tuple, again.drop("run_id", "epoch").collect()), key=str) == expected


    loads = read_loads(spark, path)
    assert loads.count() == 2 * 120  # every row handed in has its outcome
    assert loads.where("disposition = 'dropped_existing'").count() == len(expected)


def test_a_load_reads_the_buckets_of_its_batch_and_can_be_repeated(spark, batches):
    path, rows = f"{batches}/stored", spark.read.parquet(f"{batches}/items.parquet")
    first = load_items(rows, path, "a")
    count = read_items(spark, path).count()
    assert first.where("disposition = 'inserted'").count() == count > 0
    again = load_items(rows, path, "a")  # as after a crash: the same load
    assert again.where("disposition = 'inserted'").count() == count == read_items(spark, path).count()
    one = rows.where("job_id = 'job2' AND external_id = 'e3'")
    known = known_items(one, path, "b", 0)
    assert [tuple(r) for r in known.collect()] == [("job2", "e3")]
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(known._jdf.queryExecution(), "formatted")
    pruned = next(line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    assert "job_bucket" in pruned and "id_bucket" in pruned and "disposition" in pruned
    second = load_items(rows, path, "b")
    assert second.where("disposition = 'inserted'").count() == 0 and read_items(spark, path).count() == count


def test_repeats_are_reported_until_their_id_is_forgotten(spark, tmp_path):
    source, rows = f"{tmp_path}/rows.parquet", "job_id string, external_id string, row_number long"

    def run(numbers, keep):
        spark.createDataFrame([("j", x, n) for x, n in numbers], rows).coalesce(1).write.mode("append").parquet(source)
        stream = stream_table(spark, str(tmp_path), "rows.parquet")
        writer = duplicates.repeated_items(stream, keep).writeStream.format("parquet").option("path", f"{tmp_path}/out{keep}")
        run_available(writer, f"{tmp_path}/ck{keep}", spark)
        return sorted(((r.external_id, r.row_number, r.first_row) for r in spark.read.parquet(f"{tmp_path}/out{keep}").collect()), key=str)

    first = [("a", 5, 3), (None, 2, 1)]
    assert run([("a", 5), ("a", 3), ("b", 4), (None, 1), (None, 2)], 3600) == sorted(first, key=str)
    assert run([("a", 9), ("c", 6), ("c", 6)], 3600) == sorted([*first, ("a", 9, 3), ("c", 6, 6)], key=str)
    found = spark.read.parquet(f"{tmp_path}/out3600").where("row_number = 9").first()
    assert found.error == "duplicate external id: a"
    before = run([("d", 1)], 1)  # this stream reads all rows so far at once
    time.sleep(2)
    assert run([("d", 2), ("a", 10)], 1) == before


def test_repeats_of_ids_that_share_a_state(spark, tmp_path):
    rows = "job_id string, external_id string, row_number bigint"
    source, numbers = f"{tmp_path}/rows.parquet", [(f"e{n % 7}" if n % 7 else None, n) for n in range(40)]
    for part in (numbers[:20], numbers[20:]):
        spark.createDataFrame([("j", x, n) for x, n in part], rows).coalesce(1).write.mode("append").parquet(source)
    stream = stream_table(spark, str(tmp_path), "rows.parquet", files_per_trigger=1)
    writer = duplicates.repeated_items(stream, 3600, groups=2).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    run_available(writer, f"{tmp_path}/ck", spark)
    found = {(r.external_id, r.row_number, r.first_row) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {(x, n, n % 7) for x, n in numbers if n >= 7}


def test_distinct_items_over_micro_batches(spark, batches):
    stream = stream_table(spark, str(batches), "items.parquet", files_per_trigger=1).where("NOT is_malformed")
    passed = duplicates.distinct_items(stream.withColumn("job_id", F.lit("one")), fan=3)
    run_available(
        passed.writeStream.format("parquet").option("path", f"{batches}/out"), f"{batches}/ck"
    )
    ids = [r.external_id for r in spark.read.parquet(f"{batches}/out").collect()]
    assert sorted(ids) == [f"e{n}" for n in range(7)]


def test_seen_counts(spark, batches):
    stream = stream_table(spark, str(batches), "items.parquet", files_per_trigger=2).where("NOT is_malformed")
    counts = duplicates.seen_counts(stream.withColumn("job_id", F.lit("one")))
    writer = counts.writeStream.outputMode("update").foreachBatch(progress.changed_rows(f"{batches}/seen"))
    run_available(writer, f"{batches}/ck")
    got = progress.read_latest(spark, f"{batches}/seen", counts.schema, ["job_id", "external_id"])
    whole = spark.read.parquet(f"{batches}/items.parquet").where("NOT is_malformed")
    batch = duplicates.seen_counts(whole.withColumn("job_id", F.lit("one")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "done.parquet")
    # The fourth file holds a row whose window the watermark passed one micro-batch earlier.
    for moments in (["00:00:10", "00:00:20"], ["01:00:00"], ["01:00:05"], ["00:00:30", "01:00:30"], ["03:00:00"]):
        rows = [(f"2024-01-01 {m}", "SUCCEEDED") for m in moments]
        frame = spark.createDataFrame(rows, "at string, status string").withColumn("at", F.to_timestamp("at"))
        frame.coalesce(1).write.mode("append").parquet(folder)
    stream = stream_table(spark, str(tmp_path), "done.parquet", files_per_trigger=1)
    closed = progress.throughput(stream, "at", "1 minute", delay="10 minutes")
    run_available(closed.writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/ck")
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()
    assert [(r.window_start.hour, r["items"]) for r in rows] == [(0, 2), (1, 3)]


def test_watermarked_duplicates(spark, tmp_path):
    rows = [("j", "a", "2024-01-01 00:00:00"), ("j", "a", "2024-01-01 00:00:05"), ("j", "b", "2024-01-01 00:00:01")]
    frame = spark.createDataFrame(rows, "job_id string, external_id string, at string")
    frame.withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in.parquet")
    stream = stream_table(spark, str(tmp_path), "in.parquet")
    passed = duplicates.distinct_items_within(stream, "at", "1 hour")
    run_available(passed.writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/ck")
    assert sorted(r.external_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_inference_survives_a_restart(spark, tmp_path):
    events = spark.range(80).select(
        F.col("id").alias("event_id"), F.to_timestamp(F.lit("2024-01-01")).alias("ts"), F.lit("m").alias("event_type")
    )
    source = f"{tmp_path}/events.parquet"
    events.where("event_id < 40").coalesce(1).write.parquet(source)
    out = f"{tmp_path}/out"

    def run(checkpoint):
        stream = flaky_requests(stream_table(spark, str(tmp_path), "events.parquet", files_per_trigger=1))
        run_available(infer_stream(stream, FlakyClient, out, rule=NO_WAIT), checkpoint)

    run(f"{tmp_path}/ck")
    events.where("event_id >= 40").coalesce(1).write.mode("append").parquet(source)
    run(f"{tmp_path}/ck")
    assert read_stream_results(spark, out).count() == 80
    first = read_stream_results(spark, out).agg(F.max("ended_at")).first()[0]
    run(f"{tmp_path}/lost-checkpoint")  # everything is sent again: the later results count
    rows = read_stream_results(spark, out)
    assert rows.agg(F.min("ended_at")).first()[0] > first
    assert rows.count() == 80
    assert rows.where("status = 'SUCCEEDED'").count() == 50


def test_stored_attempts_are_not_sent_again(spark, tmp_path):
    events = spark.range(20).select(
        F.col("id").alias("event_id"), F.to_timestamp(F.lit("2024-01-01")).alias("ts"), F.lit("m").alias("event_type")
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out, checkpoint = f"{tmp_path}/out", tmp_path / "ck"

    def run():
        stream = flaky_requests(stream_table(spark, str(tmp_path), "events.parquet"))
        run_available(infer_stream(stream, FlakyClient, out, rule=NO_WAIT), str(checkpoint))

    run()
    before = read_stream_results(spark, out).select("external_id", "ended_at").collect()
    for name in ("0", ".0.crc"):  # as after a crash between the writes and the commit
        (checkpoint / "commits" / name).unlink()
    run()
    after = read_stream_results(spark, out).select("external_id", "ended_at").collect()
    assert sorted(before) == sorted(after)
