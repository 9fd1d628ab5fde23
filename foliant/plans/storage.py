"""Tables between the stages of a query: where they are kept, and which may be broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers a row may be broadcast.
BROADCAST_ROWS = 1_000_000


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='foliant-')}"
    return _own[context.applicationId]


def stage_folder(spark: SparkSession) -> str:
    """Where this application's stage tables lie, in the shared folder."""
    return f"{shared_folder(spark)}/foliant-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes the stage tables of this application. Only for when no DataFrame that came from a query is read any more."""
    folder = stage_folder(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, *partition_by: str) -> str:
    """Writes the rows of ``df`` to the shared folder; its URI there, which Python on the executors can read too."""
    path = f"{stage_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:///", at.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(at).toString())


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows of ``df`` written once to the shared folder and read back: a short lineage that survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, *partition_by))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have at most ``most`` rows, else as it is, to be shuffled.

    ``df`` should come from ``cut`` or a scan, so that counting is cheap.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scan(spark: SparkSession, path: str, least_bytes: int = 1 << 20) -> DataFrame:
    """A Parquet table, spread over the cores where it has fewer pieces than there are cores and isn't tiny.

    Large tables have more pieces than cores, and are read as they lie.
    """
    df = spark.read.parquet(path)
    cores, pieces = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if pieces >= cores or size < least_bytes else df.repartition(cores)
