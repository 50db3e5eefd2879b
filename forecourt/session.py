"""Sessions with the settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Partition labels are arbitrary text, times are UTC, skew and small partitions are handled at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "forecourt", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
