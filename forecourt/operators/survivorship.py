"""One vehicle per VIN from conflicting records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTRIBUTES = ["make", "model", "trim", "body_style", "fuel_type", "exterior_color", "interior_color", "condition"]


def completeness(attributes: list[str] = ATTRIBUTES) -> Column:
    """How many of the attributes, price and odometer a record has."""
    score = F.lit(0)
    for name in [*attributes, "price_cents", "odometer_km"]:
        score = score + F.col(name).isNotNull().cast("int")
    return score


def survivors(records: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """vin, each attribute, first_year, n_years, year_conflict, first_ordinal.

    Every attribute comes from the first record that has it, by completeness, then
    listed_at (both descending, null listed_at last), then input order. `ordinal` is the
    input order, unique over all records. One shuffle by VIN: the sort within it ranks
    the records, and the aggregation needs no other.
    """
    order = Window.partitionBy("vin").orderBy(completeness(attributes).desc(), F.coalesce("listed_at", F.lit("")).desc(), "ordinal")
    ranked = records.withColumn("_rank", F.row_number().over(order))
    best = [F.min_by(name, F.when(F.col(name).isNotNull(), F.col("_rank"))).alias(name) for name in attributes]
    return ranked.groupBy("vin").agg(
        *best, F.min_by("raw_year", "ordinal").alias("first_year"), F.count_distinct("raw_year").alias("n_years"), F.min("ordinal").alias("first_ordinal")
    ).withColumn("year_conflict", F.col("n_years") > 1)
