"""New bronze files as a stream: each micro-batch is checked, and its rejects and valid rows are appended (an addition; the reference only runs in batches)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize as N
from ..operators import validate as V
from ..schemas import SOURCE_A
from ..sources import bronze, generator


def stream_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of source A's batches, in whatever date they land."""
    path = f"{root}/bronze/source={SOURCE_A}"
    return spark.readStream.schema("value string, date string").text(path).select("value", F.coalesce("date", F.lit("")).alias("date"), F.regexp_extract(F.col("_metadata.file_path"), r"(bronze/source=.*)$", 1).alias("batch_id"))


def ingest(spark: SparkSession, root: str, out: str, reference_year: int, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends normalized rows to out/normal and rejects to out/rejected, by micro-batch.

    A micro-batch that is run again overwrites its own folders, so each file counts once.
    """
    dictionary = N.trim_dictionary(spark, generator.trims())

    def batch(lines: DataFrame, number: int) -> None:
        rows = lines.select("value", "batch_id", F.struct(F.lit(0).alias("source"), "date", "batch_id", F.monotonically_increasing_id().alias("row")).alias("ordinal"))
        checked = V.checked(bronze.raw_a(rows), reference_year)
        V.rejected(checked, F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/rejected/micro={number}")
        N.normalize(V.valid(checked), reference_year, dictionary).write.mode("overwrite").parquet(f"{out}/normal/micro={number}")

    return stream_lines(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
