"""The whole way of a batch, from a JSON-lines file to its status report."""

from pyspark.sql import functions as F

from promptloom.operators import chunks, infer, load, reports, results
from promptloom.operators.normalize import normalise_elements
from promptloom.plans.clients import EchoClient
from promptloom.session import drop_folders, shared_root
from promptloom.sources import batches
from promptloom.sources.results import read_results, write_results


def test_batch_from_file_to_report(spark, tmp_path):
    batches.sample_batch(spark, 200).select(
        F.to_json(F.struct(F.col("external_id").alias("id"), "prompt"))
    ).write.text(str(tmp_path / "batch"))
    items = normalise_elements(batches.read_json_lines(spark, str(tmp_path / "batch"))).withColumn("job_id", F.lit("job"))
    items = items.withColumn("row_number", F.expr("bigint(substring(external_id, 8))")).drop("path")
    loaded = load.judge_and_load(items)
    summary = reports.ingest_summary(loaded).first()
    assert (summary.total, summary.accepted, summary.rejected) == (200, 200, 0)

    ready = loaded.where("ok AND disposition = 'inserted'").withColumn("model", F.lit(None).cast("string"))
    plan = chunks.plan_chunks(ready.select("job_id", "row_number"))
    requests = infer.request_columns(
        ready.join(plan.select("job_id", "row_number", "chunk_no"), ["job_id", "row_number"]), "standard"
    )
    attempts = infer.run_inference(
        requests, lambda: EchoClient(refuse="DNA"), layout=infer.call_layout(4, 8)
    )
    root = str(tmp_path / "results")
    write_results(results.results_of(attempts), root)
    stored = read_results(spark, root, "job")
    assert {r.status: r["items"] for r in reports.items_by_status(stored).collect()} == {"SUCCEEDED": 190, "FAILED": 10}
    assert stored.select("chunk_id").distinct().count() == 4
    failures = reports.failure_report(stored.where("status = 'FAILED'")).first()
    assert (failures.error, failures.failures, failures.example_id) == ("refused", 10, "prompt-0009")

    job = spark.createDataFrame([("job", "COMPLETED", 200)], "job_id string, state string, total_items int")
    status = reports.job_status_report(job, stored).first()
    assert (status.total, status.succeeded, status.failed, status.pending) == (200, 190, 10, 0)


def test_intermediate_tables_can_be_dropped(spark):
    chunks.plan_chunks(spark.range(10).select(F.lit("j").alias("job_id"), F.col("id").alias("row_number"))).count()
    assert drop_folders(spark) > 0
    assert drop_folders(spark) == 0
    assert shared_root(spark)
