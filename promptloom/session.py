"""Session settings and the shared folder that jobs use to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, tempfile.TemporaryDirectory] = {}
_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}
_MADE: dict[str, list[str]] = {}


def build_session(app: str = "promptloom", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the settings the library relies on; ``settings`` override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Prompts may be long: keep the batches that go to Python workers small.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):  # local-cluster has executors
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.TemporaryDirectory(prefix="promptloom-", ignore_cleanup_errors=True)
    return _LOCAL_FOLDERS[app].name


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call uses."""
    path = f"{shared_root(spark)}/promptloom/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def qualified_path(spark: SparkSession, path: str) -> str:
    """The path as Spark's file sources name it: with its scheme, without a slash at its end."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def drop_folders(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote; call it when results are stored."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(made)


def drop_table(df: DataFrame) -> None:
    """Delete the table that ``materialise`` returned as ``df``, once no later step reads it."""
    context = df.sparkSession.sparkContext
    made = _MADE.get(context.applicationId, [])
    names = {name.rsplit("/", 2)[-2] for name in df.inputFiles()}
    for path in [path for path in made if path.rsplit("/", 1)[-1] in names]:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        made.remove(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table survives lost executors and pins every value that depends on
    the physical layout, so later branches of a plan all see the same rows.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = tempfile.TemporaryDirectory(prefix="promptloom-", ignore_cleanup_errors=True)
    package = Path(__file__).resolve().parent
    archive = Path(folder.name) / "promptloom.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for module in sorted(package.rglob("*.py")):
            target.write(module, module.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED[app] = folder
