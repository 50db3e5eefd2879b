"""Times a bulk load against single-row inserts, in tables that are dropped afterwards."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import generator
from ..sources.staging import new_folder
from ..sources.store import Store

BULK, SINGLE = "benchmark_bulk", "benchmark_single"


def generated(spark: SparkSession, n: int, as_of: str, seed: int = 1234) -> DataFrame:
    """n generated listings in the columns of the load benchmark."""
    rows, _ = generator.listings(spark, seed, n, 0, 0.0, as_of)
    return rows.select("vin", "make", "model", F.col("year").alias("model_year"), (F.col("price") * 100).cast("long").alias("price_cents"), F.col("odometer").alias("odometer_km"))


def loaded(store: Store, rows: DataFrame) -> dict[str, float]:
    """Loads rows both ways, and gives the seconds that each took. `rows` should be staged: both read it."""
    begun = time.time()
    store.commit(**{BULK: rows})
    between = time.time()
    store.commit(**{SINGLE: rows.limit(0)})
    store.insert(SINGLE, rows)
    return {BULK: between - begun, SINGLE: time.time() - between}


def benchmark(spark: SparkSession, n: int, as_of: str) -> str:
    """Milliseconds and rows a second of both ways, and how many times the one is faster."""
    store = Store(spark, new_folder(spark, "load"))
    rows = store.stage("rows", generated(spark, n, as_of))
    took = loaded(store, rows)
    store.drop(BULK, SINGLE)
    store.drop_stages()
    lines = [f"{label}: {1000 * took[name]:.0f} ms ({n / took[name]:.0f} rows/sec)" for label, name in (("Bulk load", BULK), ("Row by row", SINGLE))]
    return "\n".join([*lines, f"Speedup: {took[SINGLE] / took[BULK]:.1f}x"])
