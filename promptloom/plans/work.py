"""Open work, chunks, job status and integrity between jobs and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.operators import chunks, jobs, limits, load, reports, results, sketches
from promptloom.plans.registry import query
from promptloom.plans.tables import (
    DOCUMENT_ITEMS_SQL,
    LINE_ITEMS_SQL,
    OPEN_SQL,
    ORDER_JOBS_SQL,
    as_of,
    document_items,
    line_items,
    order_jobs,
    table,
)
from promptloom.session import new_folder
from promptloom.sources import jobs as job_source

CHUNK = 7


@query(f"""
WITH {DOCUMENT_ITEMS_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY row_number) AS seq FROM doc_items)
SELECT job_id, row_number, external_id, seq, (seq - 1) // {CHUNK} AS chunk_no,
       sha256(job_id || ':' || CAST((seq - 1) // {CHUNK} AS VARCHAR)) AS chunk_id
FROM numbered
""")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each batch divided into chunks."""
    keys = document_items(spark, sf_dir).select("job_id", "row_number", "external_id")
    return chunks.plan_chunks(keys, CHUNK)


@query(f"""
WITH {LINE_ITEMS_SQL}
SELECT job_id, external_id, 100 + row_number() OVER (ORDER BY job_id, external_id) AS id
FROM items
""")
def item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free ids over all items of all jobs."""
    keys = line_items(spark, sf_dir).select("job_id", F.col("external_id").alias("row_number"))
    return load.with_item_ids(keys, after=100).select("job_id", F.col("row_number").alias("external_id"), "id")


_LABELLED_SQL = f"""
{DOCUMENT_ITEMS_SQL},
numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY row_number) - 1) // {CHUNK} AS chunk_no FROM doc_items),
done AS (
  SELECT n.*, CASE WHEN l.quality = 1 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
         l.doc_id IS NOT NULL AS committed
  FROM numbered n LEFT JOIN labels l ON n.row_number = l.doc_id + 1)
"""


def _labelled_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked documents whose label says how they ended; unlabelled ones were not committed."""
    keys = document_items(spark, sf_dir).select("job_id", "row_number", "external_id")
    labels = table(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("row_number"), "quality")
    return (
        chunks.plan_chunks(keys, CHUNK)
        .join(labels, "row_number", "left")
        .withColumn("status", F.when(F.col("quality") == 1, "SUCCEEDED").otherwise("FAILED"))
        .withColumn("committed", F.col("quality").isNotNull())
    )


@query(f"""
WITH {_LABELLED_SQL}
SELECT job_id, chunk_no, count(*) AS processed, CAST(sum((status = 'SUCCEEDED')::INT) AS BIGINT) AS ok,
       CAST(sum((status <> 'SUCCEEDED')::INT) AS BIGINT) AS failed, CAST(sum(committed::INT) AS BIGINT) AS committed
FROM done GROUP BY 1, 2
""")
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, successes, failures and commits per chunk."""
    return reports.chunk_summary(_labelled_results(spark, sf_dir))


@query(f"""
WITH {_LABELLED_SQL} SELECT job_id, count(DISTINCT chunk_no) AS chunks FROM done GROUP BY 1
""")
def chunks_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks handed out per job."""
    return reports.chunks_per_job(_labelled_results(spark, sf_dir))


RUNS = 3
COUNT_ERROR = 0.05


@query(f"""
WITH {_LABELLED_SQL} SELECT job_id, count(*) AS rows, count(DISTINCT chunk_no) AS chunks, true AS holds FROM done GROUP BY 1
""")
def chunks_per_job_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunks per job from the stored sketches of several runs, held against the exact count."""
    path, rows = new_folder(spark, "chunk-sketches"), _labelled_results(spark, sf_dir)
    for run in range(RUNS):
        own = rows.where(F.pmod(F.col("row_number"), F.lit(RUNS)) == run)
        sketches.store_sketches(sketches.distinct_sketches(own, ["job_id"], "chunk_no"), path, f"r{run}")
    found = sketches.merged_distinct(sketches.read_sketches(spark, path), ["job_id"])
    exact = reports.chunks_per_job(rows)
    near = F.abs(F.col("distinct") - F.col("chunks")) <= F.greatest(F.lit(1), F.col("chunks") * COUNT_ERROR)
    return found.join(exact, "job_id").select("job_id", F.col("n").alias("rows"), "chunks", near.alias("holds"))


@query(f"WITH {LINE_ITEMS_SQL} SELECT job_id, external_id, status FROM items WHERE {OPEN_SQL}")
def open_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting and stalled items."""
    return chunks.open_work(line_items(spark, sf_dir), as_of()).select("job_id", "external_id", "status")


@query(f"""
WITH {LINE_ITEMS_SQL}
SELECT job_id, external_id, status FROM items WHERE {OPEN_SQL} ORDER BY job_id, external_id LIMIT 50
""")
def next_open_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next chunk's worth of open items in id order."""
    rows = chunks.next_open_rows(line_items(spark, sf_dir), as_of(), 50, ["job_id", "external_id"])
    return rows.select("job_id", "external_id", "status")


@query(f"""
WITH {LINE_ITEMS_SQL}, {ORDER_JOBS_SQL}
SELECT job_id, state FROM jobs WHERE job_id IN (SELECT job_id FROM items WHERE {OPEN_SQL})
""")
def jobs_with_open_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with at least one open item."""
    open_jobs = jobs.jobs_with_open_work(order_jobs(spark, sf_dir), line_items(spark, sf_dir), as_of())
    return open_jobs.select("job_id", "state")


@query(f"WITH {LINE_ITEMS_SQL} SELECT job_id, status, count(*) AS items FROM items GROUP BY 1, 2")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by job and status."""
    return reports.count_by_status(line_items(spark, sf_dir))


@query(f"""
WITH {LINE_ITEMS_SQL}, {ORDER_JOBS_SQL}
SELECT j.job_id, j.state, CAST(j.total_items AS BIGINT) AS total,
       count(*) FILTER (WHERE i.status = 'PENDING') AS pending,
       count(*) FILTER (WHERE i.status = 'CLAIMED') AS in_progress,
       count(*) FILTER (WHERE i.status = 'SUCCEEDED') AS succeeded,
       count(*) FILTER (WHERE i.status = 'FAILED') AS failed
FROM jobs j LEFT JOIN items i ON i.job_id = j.job_id GROUP BY 1, 2, 3
""")
def job_status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job with its item counts."""
    return reports.job_status_report(order_jobs(spark, sf_dir), line_items(spark, sf_dir))


def _completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results sent for every line item, some by a worker that lost the item, each sent twice."""
    sent = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("job_id"),
        F.concat_ws(
            "-", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")
        ).alias("external_id"),
        F.when(F.col("l_discount") > 0.05, "stale").otherwise(F.col("l_suppkey").cast("string")).alias("worker_id"),
        F.col("l_tax"),
        F.concat(F.lit("jobs/"), F.col("l_orderkey"), F.lit("/chunks/c"), F.col("l_linenumber"), F.lit(".jsonl")).alias(
            "result_ref"
        ),
        F.col("l_linenumber").alias("attempts"),
    )
    good = F.col("l_tax") < 0.05
    once = sent.withColumn("status", F.when(good, "SUCCEEDED").otherwise("FAILED")).withColumn("applied", F.lit(1))
    again = sent.withColumn("status", F.when(good, "FAILED").otherwise("SUCCEEDED")).withColumn("applied", F.lit(2))
    return once.unionByName(again).withColumn("error", F.when(F.col("status") == "FAILED", F.lit("refused")))


@query(f"""
WITH {LINE_ITEMS_SQL},
hit AS (SELECT *, status = 'CLAIMED' AND l_discount <= 0.05 AS committed FROM items)
SELECT job_id, external_id,
       CASE WHEN NOT committed THEN status WHEN l_tax < 0.05 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
       CASE WHEN committed THEN l_linenumber ELSE 0 END AS attempts,
       CASE WHEN committed THEN 'c' || l_linenumber || '.jsonl' END AS chunk_id,
       CASE WHEN committed AND l_tax >= 0.05 THEN 'refused' END AS error, committed
FROM hit
""")
def guarded_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items after the results arrived; only claims that still hold are changed."""
    done = results.guarded_completion(line_items(spark, sf_dir), _completions(spark, sf_dir), ["applied"])
    return done.select("job_id", "external_id", "status", "attempts", "chunk_id", "error", "committed")


@query(f"""
WITH {LINE_ITEMS_SQL}, {ORDER_JOBS_SQL}
SELECT job_id, external_id FROM items WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE state <> 'INGESTING')
""")
def orphan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a job once the jobs still in ingest are missing from the job table."""
    known = order_jobs(spark, sf_dir).where(F.col("state") != "INGESTING")
    return jobs.orphan_items(line_items(spark, sf_dir), known).select("job_id", "external_id")


@query(f"""
WITH {LINE_ITEMS_SQL}, {ORDER_JOBS_SQL}
SELECT job_id, external_id, status FROM items WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE state = 'COMPLETED')
""")
def purge_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items left after the completed jobs were deleted."""
    deleted = order_jobs(spark, sf_dir).where(F.col("state") == "COMPLETED")
    return jobs.purge_jobs(line_items(spark, sf_dir), deleted).select("job_id", "external_id", "status")


@query(f"""
WITH {LINE_ITEMS_SQL}, {ORDER_JOBS_SQL}
SELECT job_id, external_id, status FROM items
WHERE status IN ('PENDING', 'CLAIMED') AND job_id IN (SELECT job_id FROM jobs WHERE state IN ('INGESTING', 'RUNNING'))
  AND NOT l_discount <= 0.05
""")
def resume_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a restart must still process: results of workers that lost their item do not count."""
    results_so_far = _completions(spark, sf_dir).where(F.col("worker_id") != "stale")
    left = results.resume_set(order_jobs(spark, sf_dir), line_items(spark, sf_dir), results_so_far)
    return left.select("job_id", "external_id", "status")


_TRANSITIONS_SQL = """
moves AS (
  SELECT CAST(o_custkey AS VARCHAR) AS job_id, o_orderdate, o_orderkey,
         CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'COMPLETED' ELSE 'RUNNING' END AS state,
         CASE WHEN o_orderstatus = 'F' THEN 'stopped: ' || o_orderpriority END AS error
  FROM orders),
latest AS (
  SELECT * FROM moves QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
"""


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("job_id"),
        F.struct("o_orderdate", "o_orderkey").alias("seq"),
        F.when(status == "F", "FAILED").when(status == "O", "COMPLETED").otherwise("RUNNING").alias("state"),
        F.when(status == "F", F.concat(F.lit("stopped: "), F.col("o_orderpriority"))).alias("error"),
    )


@query(f"WITH {_TRANSITIONS_SQL} SELECT job_id, state, error FROM latest")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and error of every job after its last transition."""
    return jobs.latest_state(_transitions(spark, sf_dir), ["seq"])


@query(f"""
WITH {_TRANSITIONS_SQL}
SELECT state, count(*) AS jobs FROM latest WHERE state IN ('COMPLETED', 'FAILED') GROUP BY 1
""")
def jobs_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished jobs by how they ended."""
    return jobs.jobs_by_state(jobs.latest_state(_transitions(spark, sf_dir), ["seq"]))


@query(f"""
WITH {_TRANSITIONS_SQL},
totals AS (SELECT CAST(o_custkey AS VARCHAR) AS job_id, count(*) AS total FROM orders GROUP BY 1)
SELECT CAST(c.c_custkey AS VARCHAR) AS job_id, coalesce(l.state, 'PENDING') AS state,
       'batches/' || c.c_name AS input_path,
       CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 'standard' ELSE c.c_mktsegment END AS model,
       CAST(coalesce(t.total, 0) AS BIGINT) AS total_items, l.error AS error
FROM customer c
LEFT JOIN latest l ON l.job_id = CAST(c.c_custkey AS VARCHAR)
LEFT JOIN totals t ON t.job_id = CAST(c.c_custkey AS VARCHAR)
""")
def job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs appended to the job table, read back and brought up to date; customers hand them in."""
    submitted = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("job_id"),
        F.concat(F.lit("batches/"), F.col("c_name")).alias("input_path"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).otherwise("").alias("model"),
        F.lit(None).cast("string").alias("config"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("created_at"),
    )
    folder = new_folder(spark, "jobs")
    job_source.append_jobs(job_source.job_rows(submitted, "standard"), folder)
    totals = _transitions(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("total"))
    current = job_source.current_jobs(
        job_source.read_jobs(spark, folder), _transitions(spark, sf_dir), totals
    )
    return current.select("job_id", "state", "input_path", "model", "total_items", "error")


@query(f"""
WITH {ORDER_JOBS_SQL}
SELECT job_id, model FROM jobs WHERE model IS NOT NULL AND model NOT IN ('1-URGENT', '2-HIGH', '5-LOW')
""")
def model_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that ask for a model outside the list."""
    allowed = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("5-LOW",)], "model string")
    asked = order_jobs(spark, sf_dir).where(F.col("model").isNotNull())
    return limits.unknown_models(asked, allowed).select("job_id", "model")
