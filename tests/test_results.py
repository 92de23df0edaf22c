"""Result files, completion, replays, reports, jobs and limits."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from promptloom.operators import chunks, jobs, limits, logs, reports, results
from promptloom.operators.validate import validate
from promptloom.sources import jobs as job_source
from promptloom.sources import results as files

AS_OF = datetime(2024, 1, 2)


def result_rows(spark, count, job="j", status="SUCCEEDED", error=None):
    return spark.range(1, count + 1).select(
        F.lit(job).alias("job_id"),
        F.floor((F.col("id") - 1) / 2).alias("chunk_no"),
        F.concat(F.lit("c"), F.floor((F.col("id") - 1) / 2)).alias("chunk_id"),
        F.col("id").alias("row_number"),
        F.concat(F.lit("e"), "id").alias("external_id"),
        F.lit(status).alias("status"),
        F.lit('say "hi"\n[é],').alias("response"),
        F.lit(error).cast("string").alias("error"),
        F.lit(1).alias("attempts"),
        F.lit(5).cast("bigint").alias("latency_ms"),
    )


def test_files_round_trip_and_rewrite(spark, tmp_path):
    root = str(tmp_path / "r")
    assert files.read_results(spark, root, "j").count() == 0
    files.write_results(result_rows(spark, 10), root, chunks_per_group=2)
    files.write_results(result_rows(spark, 3, job="k"), root, chunks_per_group=2)
    first_group = result_rows(spark, 4, status="FAILED", error="again")
    files.write_results(first_group, root, chunks_per_group=2)
    rows = files.in_input_order(files.read_results(spark, root, "j")).collect()
    assert [r.row_number for r in rows] == list(range(1, 11))
    assert [r.status for r in rows] == ["FAILED"] * 4 + ["SUCCEEDED"] * 6
    assert rows[0].response == 'say "hi"\n[é],' and rows[9].error is None
    assert files.read_results(spark, root).count() == 13
    one_file = next((tmp_path / "r" / "job_id=k").rglob("*.json")).read_text(encoding="utf-8")
    assert json.loads(one_file.splitlines()[0])["error"] is None
    files.write_results(result_rows(spark, 2, status="FAILED"), root, run_id="run-1", chunks_per_group=2)
    assert files.read_results(spark, root, "j").count() == 12
    plan = files.read_results(spark, root, "j")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(job_id" in plan


def test_parquet_storage_behaves_the_same(spark, tmp_path):
    root = str(tmp_path / "p")
    files.write_results(result_rows(spark, 4), root, file_format="parquet")
    assert files.read_results(spark, root, "j", file_format="parquet").count() == 4


def test_array_download(spark, tmp_path):
    files.write_array(result_rows(spark, 25), str(tmp_path / "a"))
    parts = sorted((tmp_path / "a").glob("part-*"))
    array = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))
    assert [r["external_id"] for r in array] == [f"e{n}" for n in range(1, 26)]
    assert set(array[0]) == {"external_id", "status", "response", "error", "attempts", "latency_ms"}
    files.write_array(result_rows(spark, 0), str(tmp_path / "b"))
    assert "".join(p.read_text() for p in (tmp_path / "b").glob("part-*")).strip() == "[]"


ITEM = (
    "job_id string, external_id string, status string, worker_id string, lease_until timestamp, "
    "result_ref string, error string, attempts int, chunk_id string"
)


def claimed(spark):
    late = datetime(2024, 1, 1)
    soon = datetime(2024, 1, 3)
    rows = [
        ("j", "a", "CLAIMED", "w1", late, None, None, 0, None),
        ("j", "b", "CLAIMED", "w2", soon, None, None, 0, None),
        ("j", "c", "SUCCEEDED", "w1", late, "jobs/j/chunks/old.jsonl", None, 1, "old.jsonl"),
        ("k", "a", "PENDING", None, None, None, None, 0, None),
    ]
    return spark.createDataFrame(rows, ITEM)


def test_only_held_claims_are_completed(spark):
    sent = [
        ("j", "a", "w1", "SUCCEEDED", "jobs/j/chunks/n.jsonl", None, 2, 1),
        ("j", "a", "w1", "FAILED", "jobs/j/chunks/m.jsonl", "late", 5, 2),
        ("j", "b", "w1", "SUCCEEDED", "jobs/j/chunks/n.jsonl", None, 1, 1),
        ("j", "c", "w1", "FAILED", "jobs/j/chunks/n.jsonl", "late", 1, 1),
        ("k", "a", "w1", "SUCCEEDED", "jobs/k/chunks/n.jsonl", None, 1, 1),
    ]
    sent = spark.createDataFrame(
        sent,
        "job_id string, external_id string, worker_id string, status string, result_ref string, error string, "
        "attempts int, applied int",
    )
    done = results.guarded_completion(claimed(spark), sent, ["applied"])
    rows = {(r.job_id, r.external_id): r for r in done.collect()}
    assert [k for k, r in rows.items() if r.committed] == [("j", "a")]
    assert rows["j", "a"].chunk_id == "n.jsonl" and rows["j", "a"].attempts == 2
    assert rows["j", "b"].status == "CLAIMED" and rows["k", "a"].status == "PENDING"
    assert rows["j", "c"].status == "SUCCEEDED" and rows["j", "c"].result_ref == "jobs/j/chunks/old.jsonl"


def test_open_work_and_limits(spark):
    items = claimed(spark)
    assert {(r.job_id, r.external_id) for r in chunks.open_work(items, AS_OF).collect()} == {("j", "a"), ("k", "a")}
    order = ["external_id", "job_id"]
    assert [r.job_id for r in chunks.next_open_rows(items, AS_OF, 1, order).collect()] == ["j"]
    assert chunks.next_open_rows(items, AS_OF, 5, order, job_id="k").count() == 1
    every = spark.createDataFrame([("j", "RUNNING"), ("k", "RUNNING"), ("l", "RUNNING")], "job_id string, state string")
    assert {r.job_id for r in jobs.jobs_with_open_work(every, items, AS_OF).collect()} == {"j", "k"}
    report = {r.job_id: r for r in reports.job_status_report(every.withColumn("total_items", F.lit(9)), items).collect()}
    assert (report["l"].total, report["l"].pending) == (9, 0)
    assert (report["j"].in_progress, report["j"].succeeded, report["k"].pending) == (2, 1, 1)


def test_integrity_and_resume(spark):
    items = claimed(spark)
    only_j = spark.createDataFrame([("j", "RUNNING")], "job_id string, state string")
    assert [r.job_id for r in jobs.orphan_items(items, only_j).collect()] == ["k"]
    assert {r.job_id for r in jobs.purge_jobs(items, only_j).collect()} == {"k"}
    finished = spark.createDataFrame([("j", "a", "FAILED")], "job_id string, external_id string, status string")
    states = spark.createDataFrame([("j", "RUNNING"), ("k", "PENDING")], "job_id string, state string")
    assert [r.external_id for r in results.resume_set(states, items, finished).collect()] == ["b"]
    more = results.resume_set(states, items, finished, ["RUNNING", "PENDING"])
    assert {r.job_id for r in more.collect()} == {"j", "k"}


def test_a_resume_sorts_nothing_to_find_active_jobs(spark):
    items, finished = claimed(spark), spark.createDataFrame([("j", "a", "FAILED"), ("j", "a", "FAILED")], "job_id string, external_id string, status string")
    states = spark.createDataFrame([("j", "RUNNING"), ("k", "COMPLETED")], "job_id string, state string")
    left = results.resume_set(states, items, finished)
    assert [(r.job_id, r.external_id) for r in left.collect()] == [("j", "b")]
    plan = left._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2


def test_replays_keep_one_result(spark):
    items = spark.createDataFrame(
        [("j", "a", "jobs/j/chunks/one"), ("j", "b", None)], "job_id string, external_id string, result_ref string"
    )
    rows = [("j", "a", "one", 1, "x"), ("j", "a", "two", 2, "y"), ("j", "b", "one", 1, "x"), ("j", "b", "two", 2, "y")]
    replayed = spark.createDataFrame(
        rows * 3, "job_id string, external_id string, chunk_id string, written int, response string"
    )
    kept = {r.external_id: r.response for r in results.replay_winners(replayed, items, ["written"]).collect()}
    assert kept == {"a": "x", "b": "y"}


def test_full_report_leaves_nothing_out(spark):
    rows = [(1, "a", "text", False), (2, "a", "twin", False), (3, "b", None, True)]
    items = spark.createDataFrame(rows, "row_number bigint, external_id string, prompt string, is_malformed boolean")
    judged = validate(items.withColumn("job_id", F.lit("j")))
    done = result_rows(spark, 1)
    assert sorted(r.row_number for r in results.full_report(done, judged).collect()) == [1, 2, 3]


def test_job_table(spark, tmp_path):
    submitted = spark.createDataFrame(
        [("a", "in.json", "", None, AS_OF), ("b", "in.json", "big", "{}", AS_OF)],
        "job_id string, input_path string, model string, config string, created_at timestamp",
    )
    path = str(tmp_path / "jobs")
    job_source.append_jobs(job_source.job_rows(submitted, "standard"), path)
    moves = spark.createDataFrame(
        [("a", 1, "INGESTING", None), ("a", 2, "FAILED", "bad file"), ("a", 3, "COMPLETED", None)],
        "job_id string, seq int, state string, error string",
    )
    totals = spark.createDataFrame([("a", 16)], "job_id string, total bigint")
    rows = {r.job_id: r for r in job_source.current_jobs(job_source.read_jobs(spark, path), moves, totals).collect()}
    assert (rows["a"].state, rows["a"].error, rows["a"].total_items, rows["a"].model) == ("COMPLETED", None, 16, "standard")
    assert (rows["b"].state, rows["b"].total_items, rows["b"].model) == ("PENDING", 0, "big")
    assert job_source.read_jobs(spark, path, "b").count() == 1
    assert jobs.jobs_by_state(jobs.latest_state(moves, ["seq"])).first().jobs == 1


def test_budget_and_batch_limits(spark):
    items = spark.range(1, 7).select(
        F.lit("j").alias("job_id"), F.col("id").alias("row_number"), F.lit("x" * 400).alias("prompt")
    )
    cut = reports.budget_cutoff(items, 0.00035, 1.0, 0.0, F.lit(0)).first()
    assert cut.row_number == 4
    checked = limits.batch_limits(items, 1.0, 0.0, max_items=5, budget_usd=1.0).first()
    assert checked.too_many_items and not checked.over_budget


def test_row_rules_that_depend_on_the_model(spark):
    rows = [("a", "x" * 40, "small"), ("b", "x" * 40, "large"), ("c", "Hi {name}", "large"), ("d", "{ x } {1}", "none")]
    items = spark.createDataFrame(rows, "external_id string, prompt string, model string").withColumns(
        {"job_id": F.lit("j"), "row_number": F.lit(1), "is_malformed": F.lit(False)}
    )
    windows = [("small", 2050), ("large", 4096)] + [(f"m{i}", 10) for i in range(5000)]
    items = limits.with_windows(items, spark.createDataFrame(windows, "model string, window int"))
    rules = [limits.fits_context(), limits.no_placeholder()]
    got = {r.external_id: r.errors for r in validate(items, rules, reject_duplicates=False).collect()}
    assert got["a"] == ["prompt and output need 2058 tokens, window is 2050"]
    assert got["b"] == [] and got["d"] == []
    assert got["c"] == ["unfilled placeholder: {name}"]
    asked = spark.createDataFrame([("j", "x"), ("k", "y")], "job_id string, model string")
    allowed = spark.createDataFrame([("y",)], "model string")
    assert [r.job_id for r in limits.unknown_models(asked, allowed).collect()] == ["j"]


def test_texts_stay_where_they_are_when_windows_are_looked_up(spark):
    items = spark.range(4).select(F.lit("one").alias("model"), F.lit("text").alias("prompt"))
    windows = spark.createDataFrame([("one", 10), ("two", 20)], "model string, window int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = limits.with_windows(items, windows)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in plan
    assert [r.context_window for r in joined.collect()] == [10] * 4


def test_log_lines(spark):
    lines = [
        {"ts": "2024-01-01T00:00:01+00:00", "level": "INFO", "logger": "w", "msg": "chunk done processed=3 ok=2 failed=1",
         "job_id": "j", "duration_ms": 1.5},
        {"ts": "2024-01-01T00:00:00+00:00", "level": "ERROR", "logger": "w", "msg": "row failed ext_id=a b attempts=2 err=x=1\n y",
         "job_id": "j", "worker_id": "w-1", "exception": "Trace"},
    ]
    frame = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("oops",), ('{"a":1}',), ("[1]",)], "value string")
    parsed = logs.parse_lines(frame)
    assert {r.bad_line for r in logs.quarantined(parsed).collect()} == {"oops", '{"a":1}', "[1]"}
    good = logs.good_lines(parsed)
    fields = {r.level: r for r in logs.message_fields(good).collect()}
    assert (fields["INFO"].processed, fields["INFO"].ok, fields["INFO"].failed, fields["INFO"].attempts) == (3, 2, 1, None)
    assert (fields["ERROR"].ext_id, fields["ERROR"].attempts, fields["ERROR"].exception) == ("a", 2, "Trace")
    assert good.select(F.try_variant_get("extras", "$.duration_ms", "double").alias("d")).agg(F.max("d")).first()[0] == 1.5
    by_id = {(r.kind, r.id): r for r in logs.correlate(good).collect()}
    assert by_id["job_id", "j"].lines == 2 and by_id["job_id", "j"].worst_level == "ERROR"
    assert set(by_id) == {("job_id", "j"), ("worker_id", "w-1")}
    assert [r.level for r in logs.trace(good, "job_id", "j").collect()] == ["ERROR", "INFO"]
    assert logs.errors_by_logger(good).first().error == "x=1\n y"
