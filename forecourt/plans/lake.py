"""The raw view as a lake: feed files, landed, read and run by the engine itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..pipeline import run
from ..schemas import FRENCH, SOURCE_A, SOURCE_B
from ..sources import bronze, generator
from ..sources.staging import new_folder
from .views import Views

#: Order numbers in a file; the day under which each source lands.
ROWS = 4000
DAYS = {SOURCE_A: "2026-01-01", SOURCE_B: "2026-01-02"}
#: Feed columns by their names in the view.
NAMES = {"vin": "vin", "stockNumber": "stock_number", "odometer": "odometer", "make": "make", "model": "model", "year": "year", "trim": "trim", "bodyStyle": "body_style", "fuelType": "fuel_type", "exteriorColor": "exterior_color", "listedAt": "listed_at", "status": "status"}


def feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lines of source A, where null fields are left out and some prices are numbers, and columns of source B, where they are empty."""
    flat = Views(spark, sf_dir).flat().withColumn("row", F.col("ord"))
    fields = [F.col(c).alias(n) for n, c in NAMES.items()]
    text, number = (F.to_json(F.struct(p.alias("price"), *fields)) for p in (F.col("price"), F.col("price").try_cast("long")))
    a = flat.where(F.col("source") == SOURCE_A).select("row", F.when(F.col("price_kind") == "number", number).otherwise(text).alias("value"))
    french = {v: k for k, v in FRENCH.items()}
    b = flat.where(F.col("source") == SOURCE_B).select("row", *(F.coalesce(F.col(c), F.lit("")).alias(french[n]) for n, c in (NAMES | {"price": "price"}).items()))
    return {SOURCE_A: a, SOURCE_B: b}


def landed(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, dict]]:
    """The root of a new lake with both feeds, and their manifests."""
    root = new_folder(spark, "lake")
    manifests = {}
    for source, df in feeds(spark, sf_dir).items():
        generator.write_feed(df, f"{root}/data", source, ROWS)
        manifests[source] = bronze.land(spark, f"{root}/data/{source}", root, source, DAYS[source])
    return root, manifests


def ran(spark: SparkSession, sf_dir: str, year: int, now: str) -> tuple[str, str]:
    """The root of a lake on which the pipeline ran, and the run."""
    root, _ = landed(spark, sf_dir)
    return root, run(spark, root, reference_year=year, observed_at=now)
