"""Prices, odometers, trims and plain fields of valid records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsnum import BLANKS, clean, finite, js_number, js_round, js_trim, let
from ..functions.spelling import KM_PER_MILE, trim_form
from ..schemas import FRENCH, SOURCE_B

#: Fixed value: a smaller yearly distance, in source B, means that miles were given.
LEAST_KM_A_YEAR = 11000


def rename_french(df: DataFrame) -> DataFrame:
    """Canonical names for source B's columns; unknown columns are dropped, absent ones stay absent."""
    return df.select(*(F.col(f"`{c}`").alias(FRENCH[c]) for c in df.columns if c in FRENCH))


def parse_price(text: Column, kind: Column) -> Column:
    """Struct of cents and whether a non-empty text had to be parsed."""
    number = kind == "number"
    cents = lambda t: js_round(js_number(t) * 100)
    parsed = lambda t: F.struct(F.when(t != "", cents(F.translate(t, "$," + BLANKS, ""))).alias("cents"), F.coalesce(t != "", F.lit(False)).alias("malformed"))
    return F.when(number, F.struct(cents(text).alias("cents"), F.lit(False).alias("malformed"))).otherwise(let(js_trim(text), parsed))


def odometer(text: Column, year: Column, reference_year: int, may_be_miles: Column) -> Column:
    """Struct of whole kilometres and whether they were converted from miles."""

    def of(value: Column) -> Column:
        known = value >= 0
        miles = F.coalesce(known & may_be_miles & (value / F.greatest(F.lit(1.0), reference_year - year) < LEAST_KM_A_YEAR), F.lit(False))
        return F.struct(F.when(miles, js_round(value * KM_PER_MILE)).when(known, js_round(value)).alias("km"), miles.alias("from_miles"))

    return let(finite(text), of)


def trim_dictionary(spark: SparkSession, trims: list[tuple[str, str, list[str]]]) -> DataFrame:
    """make, model, form, known of a list of (make, model, trims): the last of equal make and model counts, and its first of equal form."""
    last = {(make, model): known for make, model, known in trims}
    rows = spark.createDataFrame([(*k, i, t) for k, known in last.items() for i, t in enumerate(known)], "make string, model string, place int, known string")
    first = rows.withColumn("form", trim_form(F.col("known"))).groupBy("make", "model", "form")
    return first.agg(F.min_by("known", "place").alias("known"))


def canonical_trim(df: DataFrame, dictionary: DataFrame, trim: str = "trim", make: str = "make", model: str = "model") -> DataFrame:
    """df with `trim` replaced by the known trim of its form, and trim_matched. The dictionary is a fixed list, so it is broadcast."""
    known = dictionary.select(F.col("make").alias("_make"), F.col("model").alias("_model"), F.col("form").alias("_form"), F.col("known").alias("_known"))
    raw = clean(F.col(trim))
    on = (F.col(make) == F.col("_make")) & (F.col(model) == F.col("_model")) & (trim_form(raw) == F.col("_form"))
    out = df.join(F.broadcast(known), on, "left")
    return out.withColumns({trim: F.coalesce("_known", raw), "trim_matched": F.col("_known").isNotNull()}).drop("_make", "_model", "_form", "_known")


def normalize(valid: DataFrame, reference_year: int, dictionary: DataFrame) -> DataFrame:
    """Valid records with typed fields, one row each."""
    text = lambda name: clean(F.col(f"f.{name}.text"), F.col(f"f.{name}.kind"))
    string = lambda name: F.when(F.col(f"f.{name}.kind") == "string", F.col(f"f.{name}.text"))
    price = parse_price(F.col("f.price.text"), F.col("f.price.kind"))
    km = odometer(F.col("f.odometer.text"), F.col("raw_year"), reference_year, F.col("source") == SOURCE_B)
    rows = valid.withColumns({"_price": price, "_km": km}).select(
        "source", "batch_id", "ordinal", "vin", string("sellerId").alias("seller_id"), string("stockNumber").alias("stock_number"),
        F.col("_price.cents").alias("price_cents"), F.col("_price.malformed").alias("price_was_malformed"),
        F.col("_km.km").alias("odometer_km"), F.col("_km.from_miles").alias("odometer_was_converted_from_miles"),
        text("make").alias("make"), text("model").alias("model"), "raw_year", text("trim").alias("trim"), text("bodyStyle").alias("body_style"),
        text("fuelType").alias("fuel_type"), text("exteriorColor").alias("exterior_color"), text("interiorColor").alias("interior_color"),
        text("condition").alias("condition"), text("province").alias("province"), text("city").alias("city"),
        finite(F.col("f.latitude.text")).alias("latitude"), finite(F.col("f.longitude.text")).alias("longitude"), text("listedAt").alias("listed_at"), text("status").alias("status"), "raw_record",
    )
    return canonical_trim(rows, dictionary)
