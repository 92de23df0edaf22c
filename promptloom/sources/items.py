"""The stored item table: one row per (job_id, external_id), and what became of every row loaded.

Rows lie in folders by disposition, then by hash buckets of job and id, then by the load that
wrote them (``run_id``, ``epoch``). A load looks up its ids in the buckets they fall in and
reads two columns there, so its cost follows the batch and not the table. The table proper is
the folder of the inserted rows; the others hold keys and outcomes, without prompts. A
load that is repeated finds its own rows left out and writes the same folders again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.operators.load import FLUSH_ROWS, INSERTED, judge_and_load
from promptloom.operators.validate import Rule
from promptloom.session import path_exists

# Folders per disposition: a job spreads over ID_BUCKETS, a load of one job reads 1/JOB_BUCKETS.
# Both belong to a stored table: raise them for a large one before its first load.
JOB_BUCKETS, ID_BUCKETS = 8, 4

_ITEM = ["job_id", "external_id"]
ROWS = "job_id string, row_number bigint, external_id string, prompt string, status string, error string"
_FOLDERS = "disposition string, job_bucket int, id_bucket int, run_id string, epoch bigint"


def _bucketed(rows: DataFrame) -> DataFrame:
    def bucket(column: str, count: int):
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    return rows.withColumns({"job_bucket": bucket("job_id", JOB_BUCKETS), "id_bucket": bucket("external_id", ID_BUCKETS)})


def read_loads(spark: SparkSession, path: str) -> DataFrame:
    """Every row ever loaded with its ``disposition``; prompts of inserted, accepted rows only."""
    return spark.read.schema(f"{ROWS}, {_FOLDERS}").parquet(path).drop("job_bucket", "id_bucket")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The item table: the inserted rows, with the load that brought them."""
    return read_loads(spark, path).where(F.col("disposition") == INSERTED).drop("disposition")


def known_items(batch: DataFrame, path: str, run_id: str, epoch: int) -> DataFrame | None:
    """The (job_id, external_id) of ``batch`` that earlier loads have inserted.

    Only the folders of the batch's buckets are listed in the plan, at most
    JOB_BUCKETS * ID_BUCKETS of them. This load and later ones of its run don't count.
    """
    spark = batch.sparkSession
    if not path_exists(spark, path):
        return None
    wanted = _bucketed(batch.select(*_ITEM)).select("job_bucket", "id_bucket").distinct().collect()
    stored = spark.read.schema(f"{ROWS}, {_FOLDERS}").parquet(path).where(
        (F.col("disposition") == INSERTED)
        & F.col("job_bucket").isin(sorted({r["job_bucket"] for r in wanted}))
        & F.col("id_bucket").isin(sorted({r["id_bucket"] for r in wanted}))
        & ~((F.col("run_id") == run_id) & (F.col("epoch") >= epoch))
    )
    # The buckets are scanned for this batch's ids only; they are not shuffled if those are few.
    return stored.select(*_ITEM).join(batch.select(*_ITEM).distinct(), _ITEM, "left_semi")


def load_items(
    batch: DataFrame,
    path: str,
    run_id: str,
    epoch: int = 0,
    rules: Sequence[Rule] | None = None,
    flush_rows: int = FLUSH_ROWS,
) -> DataFrame:
    """Judge a batch, insert what the table at ``path`` lacks, and return this load's rows.

    Rows are judged once and written once, each with its disposition. Loading a batch again
    inserts nothing; repeating a load (same ``run_id`` and ``epoch``) changes nothing.
    """
    spark = batch.sparkSession
    loaded = judge_and_load(batch, rules, flush_rows, known_items(batch, path, run_id, epoch))
    prompt = F.when((F.col("disposition") == INSERTED) & (F.col("status") == "PENDING"), F.col("prompt"))
    rows = loaded.select("job_id", "row_number", "external_id", prompt.alias("prompt"), "status", "error", "disposition")
    placed = _bucketed(rows).withColumns({"run_id": F.lit(run_id), "epoch": F.lit(epoch).cast("bigint")})
    (
        placed.repartition("disposition", "job_bucket", "id_bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("disposition", "job_bucket", "id_bucket", "run_id", "epoch")
        .parquet(path)
    )
    return read_loads(spark, path).where((F.col("run_id") == run_id) & (F.col("epoch") == epoch))
