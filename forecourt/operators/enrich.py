"""Decoded attributes for vehicles: one decode per VIN prefix, kept in a cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vin import YEAR_CODES, prefix
from ..schemas import DECODED, UNDECODED

#: prefix, vin -> wmi_vds_prefix and decoded columns; called once with the distinct prefixes that the cache lacks.
Decoder = Callable[[DataFrame], DataFrame]


def seed_decoder(spark: SparkSession, seeds: list[tuple]) -> Decoder:
    """A decoder by a table of (wmi, vds, plant, make, model, body, fuel, first year, last year): for feeds made from the same seeds."""
    table = spark.createDataFrame(seeds, "wmi string, vds string, plant string, make string, model string, body_style string, fuel_type string, first_year int, last_year int")

    def decode(missing: DataFrame) -> DataFrame:
        code = F.instr(F.lit(YEAR_CODES), F.substring("vin", 10, 1))
        known = (F.col("wmi") == F.substring("vin", 1, 3)) & (F.col("vds") == F.substring("vin", 4, 5)) & (F.col("plant") == F.substring("vin", 11, 1))
        year = F.when(code + 1979 < F.col("first_year") - 5, code + 2009).otherwise(code + 1979)
        found = missing.join(F.broadcast(table), known, "left").withColumn("year", F.when((code > 0) & F.col("make").isNotNull(), year).cast("int"))
        none = lambda name: F.lit(None).cast("string").alias(name)
        return found.select(
            F.col("prefix").alias("wmi_vds_prefix"), F.col("make").isNotNull().alias("valid"), "make", "model", "year", none("trim"), none("series"), "body_style", "fuel_type", none("drive_type"), none("transmission")
        )

    return decode


def missing_prefixes(vins: DataFrame, cache: DataFrame) -> DataFrame:
    """prefix and one vin (the first by first_ordinal) of every prefix that the cache lacks."""
    wanted = vins.groupBy(prefix(F.col("vin")).alias("prefix")).agg(F.min_by("vin", "first_ordinal").alias("vin"))
    return wanted.join(cache.select(F.col("wmi_vds_prefix").alias("prefix")), "prefix", "left_anti")


def cached(vins: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache's rows for the prefixes of the given VINs."""
    return cache.join(vins.select(prefix(F.col("vin")).alias("wmi_vds_prefix")), "wmi_vds_prefix", "left_semi")


def non_empty(col: str) -> Column:
    t = F.trim(F.col(col))
    return F.when(t != "", t)


def enrich(vehicles: DataFrame, cache: DataFrame, decoded: str = DECODED) -> DataFrame:
    """Survivors with decoded attributes put first, decode_source (`decoded` or undecoded), decoded_year, and whether make and model agree.

    agrees is null unless all four values are there.
    """
    found = vehicles.withColumn("_prefix", prefix(F.col("vin"))).alias("v").join(cache.alias("d"), F.col("_prefix") == F.col("d.wmi_vds_prefix"), "left")
    ok = F.coalesce(F.col("d.valid"), F.lit(False))
    take = lambda name: F.when(ok, non_empty(f"d.{name}"))
    make, model, year = take("make"), take("model"), F.when(ok, F.col("d.year"))
    present = make.isNotNull() & model.isNotNull() & (F.col("v.make") != "") & (F.col("v.model") != "")
    same = (F.lower(make) == F.lower("v.make")) & (F.lower(model) == F.lower("v.model"))
    return found.select(
        "v.vin", F.coalesce(make, "v.make").alias("make"), F.coalesce(model, "v.model").alias("model"), F.coalesce(year, F.col("v.first_year")).cast("double").alias("model_year"),
        F.coalesce(take("trim"), take("series"), "v.trim").alias("trim"), F.coalesce(take("body_style"), "v.body_style").alias("body_style"), F.coalesce(take("fuel_type"), "v.fuel_type").alias("fuel_type"),
        take("drive_type").alias("drive_train"), take("transmission").alias("transmission"), F.when(ok, F.lit(decoded)).otherwise(F.lit(UNDECODED)).alias("decode_source"),
        year.alias("decoded_year"), F.when(present, same).alias("agrees"), "v.first_ordinal",
    )


def enrich_listings(listings: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Normalized records with the vehicle's make, model and year beside them, and year_conflict (never, if undecoded)."""
    own = vehicles.select("vin", F.col("make").alias("vehicle_make"), F.col("model").alias("vehicle_model"), F.col("model_year").alias("vehicle_year"), "decoded_year", "first_ordinal")
    out = listings.join(own, "vin")
    return out.withColumn("year_conflict", F.coalesce(F.col("decoded_year") != F.col("raw_year"), F.lit(False)))


def enrich_metrics(vehicles: DataFrame, listings: DataFrame, decoded: str = DECODED) -> DataFrame:
    """One row: vehicles, decoded, compared, agreeing, and listings with a year conflict."""
    a = vehicles.agg(
        F.count("*").alias("unique_vins"), F.count_distinct(prefix(F.col("vin"))).alias("unique_prefixes"), F.count_if(F.col("decode_source") == decoded).alias("decode_success"),
        F.count("agrees").alias("agreement_checked"), F.count_if("agrees").alias("agreement"),
    )
    return a.crossJoin(listings.agg(F.count_if("year_conflict").alias("year_conflict_listings")))  # one row each
