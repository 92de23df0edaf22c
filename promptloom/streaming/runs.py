"""Reading tables as streams and running a stream over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getFileStatus(target).isDirectory()


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet table ``folder/name`` as a stream. A table may be a folder or a single file."""
    path = f"{folder}/{name}"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if _is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_folder(spark: SparkSession, epoch: int) -> str:
    """Folder name of a micro-batch: the same when it is repeated, another for every stream.

    The id of a stream is kept in its checkpoint, so it survives restarts.
    """
    stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
    return f"run_id={stream}/epoch={epoch}"


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_available(writer: DataStreamWriter, checkpoint: str, spark: SparkSession | None = None) -> None:
    """Work off everything that is available and stop; a failure of the stream is raised.

    States that expire by the clock ask for one empty micro-batch after the other, so such a
    stream would not stop; with ``spark`` given, it has none. What has expired is noticed all
    the same, as soon as its key comes back. A stream takes its settings as it starts.
    """
    before = spark.conf.get(_EMPTY_BATCHES) if spark else None
    if spark:
        spark.conf.set(_EMPTY_BATCHES, "false")
    try:
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if spark:
            spark.conf.set(_EMPTY_BATCHES, before)
    try:
        query.awaitTermination()
    finally:
        query.stop()

