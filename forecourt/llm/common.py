"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: the session's spark.checkpoint.dir.

    Only where it is unset and all runs in one process (local tests) a temporary folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="forecourt-")
        root = _LOCAL[app]
    return root.rstrip("/")


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this application's operators have staged; results that were not written elsewhere go with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/forecourt/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/forecourt/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Files of an intermediate table for each of the cluster's task slots, if it is small.
FILES_PER_SLOT = 4


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size: that of the files for a staged table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def files_for(df: DataFrame) -> int:
    """Files to write df into: some for each task slot, and more where the optimizer's estimate has more bytes than the session reads in a task."""
    spark = df.sparkSession
    unit = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(FILES_PER_SLOT * spark.sparkContext.defaultParallelism, min(-(-estimated_bytes(df) // unit), 1 << 20))


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """The rows of df, written once to the shared folder and read back.

    Cuts lineage so that a lost executor never repeats the work above, and gives
    the optimizer the table's real size, by which it chooses how to join. Neighbouring
    partitions are written into one file where there are many more of them than `files_for`
    says, so a task's share does not grow with the table; a table of a few rows takes one file.
    """
    path = new_path(df.sparkSession, name)
    df.coalesce(files or files_for(df)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that go to Python at once: texts can be long, and both sides hold whole batches.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, if they are larger, for plans that pass texts to Python.

    The setting stays: a plan takes it when it runs, which is after the operator has returned.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8(col: str | Column) -> Column:
    """The UTF-8 bytes of a string column; null stays null."""
    return (F.col(col) if isinstance(col, str) else col).cast("binary")


def remainder3(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 3; -1 for a null id. 1 marks held-out rows."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(-1))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
