"""The folder that the driver and all executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the session names it in spark.checkpoint.dir.

    Where that is unset, a temporary folder takes its place in a local session; on a cluster that is an error, as
    executors don't see one another's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/dossier-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there, wherever Spark can write."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def remove_tables(spark: SparkSession) -> None:
    """Deletes all that this application has written to its part of the shared folder.

    Results of operators read such tables, so call this once the results are written elsewhere.
    """
    remove(spark, application_dir(spark))


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: the plan ends there, and lost executors lose nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores, as of one small file, dealt over all of them; any other as it is.

    Parts are counted without reading a column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.select(F.spark_partition_id().alias("part")).distinct().count()
    return df.repartition(cores) if parts < cores else df
