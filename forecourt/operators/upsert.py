"""Merging a batch into silver tables, and price changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DECODED


def listing_key() -> Column:
    """The stock number, even an empty one; without one, source and VIN."""
    return F.coalesce("stock_number", F.concat_ws("-", "source", "vin"))


def listing_id(source: Column, source_listing_id: Column) -> Column:
    """A surrogate key that replays repeat."""
    return F.sha2(F.concat_ws("\u0001", source, source_listing_id), 256)


def staged_listings(listings: DataFrame) -> DataFrame:
    """One row per (source, source_listing_id): that of the VIN which appeared last, and of it the last record."""
    last = Window.partitionBy("source", "source_listing_id").orderBy(F.desc("first_ordinal"), F.desc("ordinal"))
    keyed = listings.withColumn("source_listing_id", listing_key())
    return keyed.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").select(
        "vin", "source", "source_listing_id", "batch_id", "price_cents", F.lit("CAD").alias("currency"), F.col("odometer_km").cast("int").alias("odometer_km"), F.col("trim").alias("trim_raw"),
        "province", "city", F.col("latitude").cast("decimal(9,6)").alias("latitude"), F.col("longitude").cast("decimal(9,6)").alias("longitude"), F.coalesce("status", F.lit("active")).alias("status"),
        "year_conflict", F.col("listed_at").cast("timestamp").alias("listed_at"), F.col("vehicle_make").alias("make"), F.col("vehicle_model").alias("model"), F.col("vehicle_year").cast("int").alias("model_year"),
    )


def staged_vehicles(vehicles: DataFrame) -> DataFrame:
    return vehicles.select(
        "vin", F.substring("vin", 1, 3).alias("wmi"), "make", "model", F.col("model_year").cast("int").alias("model_year"), "trim", "body_style", "fuel_type", "drive_train", "transmission", "decode_source"
    )


def _merged(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Full join of both on the keys, in the old table's columns; rules give all but the keys, over o.* and n.*."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    both = o.join(n, on, "full")
    cols = [(F.coalesce(f"n.{k}", f"o.{k}") if k in keys else rules[k]).cast(old.schema[k].dataType).alias(k) for k in old.columns]
    return both.select(*cols)


def upsert_vehicles(old: DataFrame, staged: DataFrame, now: Column, decoded: str = DECODED) -> DataFrame:
    """New values where there are any, else the old ones; a decoded vehicle stays so; WMI and first sight are kept."""
    is_old, is_new = F.col("o.vin").isNotNull(), F.col("n.vin").isNotNull()
    fill = lambda c: F.coalesce(f"n.{c}", f"o.{c}")
    keep = lambda c, first: F.when(is_old, F.col(f"o.{c}")).otherwise(first)
    rules = {c: fill(c) for c in ("make", "model", "model_year", "trim", "body_style", "fuel_type", "drive_train", "transmission")}
    rules |= {
        "wmi": keep("wmi", F.col("n.wmi")),
        "decode_source": F.when(~is_old | (F.col("n.decode_source") == decoded), F.col("n.decode_source")).otherwise(F.col("o.decode_source")),
        "first_seen_at": keep("first_seen_at", now),
        "created_at": keep("created_at", now),
        "last_seen_at": F.when(is_new, now).otherwise(F.col("o.last_seen_at")),
        "updated_at": F.when(is_new, now).otherwise(F.col("o.updated_at")),
    }
    return _merged(old, staged, ["vin"], rules)


def upsert_listings(old: DataFrame, staged: DataFrame, now: Column) -> DataFrame:
    """Price (even null), status, batch and conflict are replaced; attributes filled; VIN, currency and listing time kept.

    delisted_at is set when a known listing turns to removed, and never cleared.
    """
    is_old, is_new = F.col("o.source").isNotNull(), F.col("n.source").isNotNull()
    fill = lambda c: F.coalesce(f"n.{c}", f"o.{c}")
    keep = lambda c: F.when(is_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    replace = lambda c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    rules = {c: replace(c) for c in ("batch_id", "price_cents", "status", "year_conflict")}
    rules |= {c: fill(c) for c in ("odometer_km", "trim_raw", "province", "city", "latitude", "longitude", "make", "model", "model_year")}
    rules |= {c: keep(c) for c in ("vin", "currency", "listed_at")}
    delisted = is_old & (F.col("n.status") == "removed") & (F.col("o.status") != "removed")
    rules |= {
        "id": F.when(is_old, F.col("o.id")).otherwise(listing_id(F.col("n.source"), F.col("n.source_listing_id"))),
        "delisted_at": F.when(F.coalesce(delisted, F.lit(False)), now).otherwise(F.col("o.delisted_at")),
        "created_at": F.when(is_old, F.col("o.created_at")).otherwise(now),
        "updated_at": F.when(is_new, now).otherwise(F.col("o.updated_at")),
    }
    return _merged(old, staged, ["source", "source_listing_id"], rules)


def latest_price(history: DataFrame) -> DataFrame:
    """listing_id and the price last observed: a plain aggregation, combined before the shuffle."""
    return history.groupBy("listing_id").agg(F.max_by("price_cents", "observed_at").alias("latest_cents"))


def price_changes(staged: DataFrame, listings: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """History rows for staged prices that differ from the last one, or are the first."""
    known = listings.select(F.col("id").alias("listing_id"), "source", "source_listing_id")
    both = staged.where("price_cents is not null").join(known, ["source", "source_listing_id"]).join(latest_price(history), "listing_id", "left")
    return both.where(~F.col("latest_cents").eqNullSafe(F.col("price_cents"))).select("vin", "listing_id", "price_cents", now.cast("timestamp").alias("observed_at"))


def backfill(listings: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Make, model and year of the vehicle for listings without a make; all others as they are."""
    own = vehicles.select("vin", F.col("make").alias("_make"), F.col("model").alias("_model"), F.col("model_year").alias("_year"), F.lit(True).alias("_met"))
    out = listings.join(own, "vin", "left")
    bare = F.col("make").isNull() & F.coalesce("_met", F.lit(False))
    filled = {c: F.when(bare, F.col(f)).otherwise(F.col(c)) for c, f in (("make", "_make"), ("model", "_model"), ("model_year", "_year"))}
    return out.withColumns(filled).select(*listings.columns)
