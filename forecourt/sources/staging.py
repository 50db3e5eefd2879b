"""Intermediate tables, written once and read back.

Later steps then share one computation, do not lose it with an executor, and plan over a
plain scan of known size instead of everything above it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import remove

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder only where it is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not root and app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="forecourt-")
    return (root or _LOCAL[app]).rstrip("/")


def new_folder(spark: SparkSession, name: str, root: str | None = None) -> str:
    """A path below the shared folder (or root) that nothing else uses."""
    return f"{root or shared_dir(spark)}/staging/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    path = new_folder(df.sparkSession, name, root)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, root: str | None = None) -> None:
    """Deletes what this application has staged there; results that were not written elsewhere go with it."""
    remove(f"{root or shared_dir(spark)}/staging/{spark.sparkContext.applicationId}")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan, dealt over the task slots if the scan has fewer partitions.

    A compressed file, or one of a single row group, is one task however large it is,
    and so would be all that is computed from it up to the next shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= slots:
        return df
    # Always true, but not known to be: filters, with all that they compute, are not pushed below it into the scan's few tasks.
    return df.repartition(slots).where(F.spark_partition_id() >= 0)
