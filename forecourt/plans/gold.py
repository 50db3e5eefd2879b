"""Gold tables and the listing queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pg import asc, desc, rounded_ratio, whole
from ..operators.medians import with_medians


GROUP = ["make", "model", "model_year", "province"]


def _stats(listings: DataFrame) -> DataFrame:
    """Active priced listings of a make by group: n, total, low, high (the middle prices), n_also and total_also (of kilometres)."""
    return with_medians(listings.where("status = 'active' and price_cents is not null and make is not null"), GROUP, "price_cents", "odometer_km")


def market_cents(listings: DataFrame) -> DataFrame:
    """Counts, mean and median price in cents (the median doubled, so that it is whole), mean kilometres."""
    return _stats(listings).select(
        *GROUP, F.col("n").alias("listing_count"), rounded_ratio(F.col("total"), F.col("n")).alias("avg_price_cents"), (F.col("low") + F.col("high")).alias("median_price_cents_x2"),
        rounded_ratio(F.col("total_also"), F.col("n_also")).alias("avg_odometer_km"),
    )


def market_stats(listings: DataFrame) -> DataFrame:
    """gold_market_stats: prices in dollars with two places."""
    dollars = lambda total, n: F.round(total.cast("decimal(38,0)") / n / 100, 2).cast("decimal(20,2)")
    return _stats(listings).select(
        *GROUP, F.col("n").alias("listing_count"), dollars(F.col("total"), F.col("n")).alias("avg_price_cad"), dollars(F.col("low") + F.col("high"), F.lit(2)).alias("median_price_cad"),
        rounded_ratio(F.col("total_also"), F.col("n_also")).alias("avg_odometer_km"),
    )


def _drop_pct(drop: Column, previous: Column, places: int) -> Column:
    """100 * drop / previous, rounded once, halves away from zero; null if the previous price is 0."""
    units = rounded_ratio(F.signum(previous).cast("long") * drop.cast("decimal(20,0)") * 10 ** (2 + places), F.abs(previous.cast("decimal(20,0)")))
    return (units.cast("decimal(20,0)") / 10**places).cast(f"decimal(20,{places})")


def price_drops(history: DataFrame) -> DataFrame:
    """gold_price_drops: every observation below the one before it, by listing; unknown times last."""
    w = Window.partitionBy("listing_id").orderBy(asc("observed_at"))
    rows = history.withColumns({"previous_price_cents": F.lag("price_cents").over(w), "previous_observed_at": F.lag("observed_at").over(w)})
    drop = F.col("previous_price_cents") - F.col("price_cents")
    pct = _drop_pct(drop, F.col("previous_price_cents"), 2)
    return rows.where("price_cents < previous_price_cents").select(
        "listing_id", "vin", "previous_price_cents", F.col("price_cents").alias("current_price_cents"), drop.alias("price_drop_cents"), pct.alias("price_drop_pct"), "previous_observed_at", F.col("observed_at").alias("current_observed_at")
    )


def browse(listings: DataFrame, make: str | None, model: str | None, years: tuple[int, int], province: str, n: int = 50) -> DataFrame:
    """The cheapest active listings of a make and model (None: any), years and province; null prices last, ties by id."""
    own = F.col("model_year").between(*years) & (F.col("province") == province) & (F.col("status") == "active")
    for name, value in (("make", make), ("model", model)):
        own = own if value is None else own & (F.col(name) == value)
    return listings.where(own).orderBy(asc("price_cents"), "id").limit(n).select("id", "vin", "price_cents", "odometer_km", "city")


def make_stats(listings: DataFrame, make: str, n: int = 20) -> DataFrame:
    """The largest groups of one make, with mean and median as whole cents."""
    mean, median = rounded_ratio(F.col("total"), F.col("n")), whole((F.col("low") + F.col("high")) / 2)
    own = _stats(listings.where(F.col("make") == make)).select(*GROUP, "n", mean.alias("avg_price_cents"), median.alias("median_price_cents"))
    return own.orderBy(desc("n"), *(asc(c) for c in GROUP)).limit(n)


def vin_history(listings: DataFrame, history: DataFrame, vin: Column | None = None) -> DataFrame:
    """Listings of a VIN (default: the smallest active one) with every price observed, by time, unobserved ones last."""
    if vin is None:
        first = listings.where("status = 'active'").agg(F.min("vin").alias("vin"))
        own = listings.join(F.broadcast(first), "vin", "left_semi")  # one row
    else:
        own = listings.where(F.col("vin") == vin)
    seen = history.select("listing_id", F.col("price_cents").alias("history_price"), "observed_at")
    return own.join(seen, own["id"] == seen["listing_id"], "left").select("source", "price_cents", "status", "history_price", "observed_at").orderBy(asc("observed_at"))


def recent(listings: DataFrame, province: str, n: int = 50) -> DataFrame:
    own = listings.where((F.col("status") == "active") & (F.col("province") == province))
    return own.orderBy(desc("listed_at"), "id").limit(n).select("id", "vin", "make", "model", "price_cents", "listed_at")


def largest_drops(history: DataFrame, n: int = 20) -> DataFrame:
    """The largest drops in percent, with one place; ties by VIN, listing and time."""
    rows = price_drops(history)
    pct = _drop_pct(F.col("price_drop_cents"), F.col("previous_price_cents"), 1)
    rows = rows.withColumn("pct_drop", pct).orderBy(desc("pct_drop"), "vin", "listing_id", "current_observed_at").limit(n)
    return rows.select("vin", F.col("previous_price_cents").alias("prev_price"), F.col("current_price_cents").alias("price_cents"), "pct_drop")
