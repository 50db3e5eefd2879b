"""Measures of data quality and of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_conflict(records: DataFrame) -> DataFrame:
    """One row: VINs, and how many have several records in one source, several sources, several years; with their rates."""
    per_source = records.groupBy("vin", "source").agg(F.count("*").alias("n"), F.min("raw_year").alias("low"), F.max("raw_year").alias("high"))
    per_vin = per_source.groupBy("vin").agg(F.max("n").alias("most"), F.count("*").alias("sources"), (F.min("low") < F.max("high")).alias("conflict"))
    out = per_vin.agg(
        F.count("*").alias("unique_vins"), F.count_if(F.col("most") > 1).alias("within_source_duplicate"), F.count_if(F.col("sources") > 1).alias("cross_source_duplicate"), F.count_if("conflict").alias("year_conflict")
    )
    names = ("within_source_duplicate", "cross_source_duplicate", "year_conflict")
    return out.withColumns({f"{c}_rate": F.try_divide(F.col(c), F.col("unique_vins")) for c in names})


def price_outliers(records: DataFrame, least: int = 5, sigmas: float = 3.0) -> DataFrame:
    """One row: outliers and scored, by distance from the mean price of make and model.

    Means and deviations are aggregated before the shuffle; the one row a group that
    they leave is joined back, by broadcast if it is small.
    """
    scored = price_distances(records.select("make", "model", "price_cents"), least)
    return scored.agg(F.count_if(F.abs("z") > sigmas).alias("outliers"), F.count("*").alias("scored"))


def price_distances(records: DataFrame, least: int = 5) -> DataFrame:
    """Priced records of makes and models with `least` of them and different prices, with z, the distance from their mean in deviations."""
    priced = records.where("price_cents is not null and make <> '' and model <> ''")
    stats = priced.groupBy(F.col("make").alias("_make"), F.col("model").alias("_model")).agg(F.count("*").alias("_n"), F.avg("price_cents").alias("_mean"), F.stddev_pop("price_cents").alias("_dev"))
    stats = stats.where((F.col("_n") >= least) & (F.col("_dev") > 0))
    met = priced.join(stats, (F.col("make") == F.col("_make")) & (F.col("model") == F.col("_model")))
    return met.withColumn("z", (F.col("price_cents") - F.col("_mean")) / F.col("_dev")).drop("_make", "_model", "_n", "_mean", "_dev")


def completeness(checked: DataFrame, normalized: DataFrame) -> DataFrame:
    """Per source: rows in, valid, set aside, and shares of prices, odometers and known trims."""
    read = checked.groupBy("source").agg(F.count("*").alias("rows_in"), F.count_if(F.size("reason_codes") == 0).alias("valid"), F.count_if(F.size("reason_codes") > 0).alias("quarantined"))
    kept = normalized.groupBy("source").agg(F.count("price_cents").alias("priced"), F.count("odometer_km").alias("with_odometer"), F.count("trim").alias("with_trim"), F.count_if("trim_matched").alias("known_trim"))
    out = read.join(kept, "source", "left").na.fill(0, ["priced", "with_odometer", "with_trim", "known_trim"])
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumns({"price_completeness": rate("priced", "rows_in"), "odometer_completeness": rate("with_odometer", "rows_in"), "trim_coverage": rate("known_trim", "with_trim")})


def rejection_rate(checked: DataFrame) -> DataFrame:
    """Per batch: rows, rows set aside, and their share."""
    out = checked.groupBy("source", "batch_id").agg(F.count("*").alias("rows_in"), F.count_if(F.size("reason_codes") > 0).alias("rejects"))
    return out.withColumn("rejection_rate", F.coalesce(F.try_divide("rejects", "rows_in"), F.lit(0.0)))


def reason_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.select(F.explode("reason_codes").alias("reason"), "source").groupBy("reason", "source").agg(F.count("*").alias("n"))


def stage_rollup(runs: DataFrame) -> DataFrame:
    """Sums by stage and source of one run."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("rows_in", "rows_out", "rejects")]
    return runs.groupBy("stage", "source").agg(*sums, F.sum("duration_ms").cast("long").alias("total_ms"), F.count("*").alias("batches"))


def latest_run(runs: DataFrame) -> DataFrame:
    """One row: the run that started last."""
    return runs.where("run_id is not null").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def run_metrics(metrics: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    own = runs.where(F.col("run_id") == run_id).select(F.col("id").alias("run_id"))
    return metrics.join(own, "run_id").select("source", "metric_name", "metric_value")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def formatted(value: float) -> str:
    """Whole numbers as they are, fractions below one as a percentage, others with two places."""
    if float(value).is_integer():
        return str(int(value))
    return f"{value * 100:.2f}%" if value < 1 else f"{value:.2f}"


def outlier_rows(records: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Records with their distance from the mean in deviations (an addition: the reference only counts them)."""
    return price_distances(records).where(F.abs("z") > sigmas)
