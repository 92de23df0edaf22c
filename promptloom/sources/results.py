"""Result files: JSON lines laid out by job and group of chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions.outcomes import as_json
from promptloom.functions.text import whole_quotient
from promptloom.operators.prefix import number_rows
from promptloom.schemas import RESULT_FIELDS, RESULTS
from promptloom.session import path_exists

# A group of chunks is one folder and about one file: with 50 rows per chunk up to a million rows.
CHUNKS_PER_GROUP = 20_000

LAYOUT = ("job_id", "run_id", "chunk_group")


def write_results(
    results: DataFrame,
    root: str,
    run_id: str = "run-0",
    file_format: str = "json",
    chunks_per_group: int = CHUNKS_PER_GROUP,
) -> None:
    """Write the results of a run below ``root``; writing a run again replaces what it wrote.

    ``root`` may have any path scheme Spark knows. One file per chunk would mean one file
    for 50 rows; a folder holds a group of chunks instead, and ``chunk_id`` is a column. Null
    fields are written. A run that resumes another one takes a ``run_id`` of its own and
    leaves the other's files alone; ``replay_winners`` settles rows that both hold.
    """
    grouped = results.withColumn("run_id", F.lit(run_id)).withColumn(
        "chunk_group", whole_quotient(F.col("chunk_no"), chunks_per_group)
    )
    names = [name for name in RESULTS.fieldNames() if name not in LAYOUT]
    writer = (
        grouped.select(*LAYOUT, *names)
        .repartition(*LAYOUT)
        .write.format(file_format)
        .partitionBy(*LAYOUT)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
    )
    if file_format == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.save(root)


def read_results(spark: SparkSession, root: str, job_id: str | None = None, file_format: str = "json") -> DataFrame:
    """Results below ``root``, of one job or of all; none if nothing was written yet."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], RESULTS)
    rows = spark.read.schema(RESULTS).format(file_format).load(root)
    return rows if job_id is None else rows.where(F.col("job_id") == job_id)


def in_input_order(results: DataFrame) -> DataFrame:
    """Results as they were handed in: a range-partitioned sort by job and row number."""
    return results.orderBy("job_id", "row_number")


def array_lines(results: DataFrame, order: Sequence[str] = ("row_number",)) -> DataFrame:
    """Lines that, put together in (job_id, seq) order, form one JSON array per job.

    The brackets go to the first and last row of a job, so an array of any length is made
    without ever being in one place.
    """
    numbered = number_rows(results, ["job_id"], list(order), last="is_last")
    opening = F.when(F.col("seq") == 1, "[").otherwise("")
    closing = F.when(F.col("is_last"), "]").otherwise(",")
    return numbered.select("job_id", "seq", F.concat(opening, as_json(*RESULT_FIELDS), closing).alias("line"))


def write_array(results: DataFrame, path: str) -> None:
    """Write one job's JSON array as text parts whose names sort in array order.

    Without results the array is ``[]``.
    """
    lines = array_lines(results)
    if lines.isEmpty():
        lines = results.sparkSession.createDataFrame([("", 1, "[]")], lines.schema)
    lines.orderBy("job_id", "seq").select("line").write.text(path)
