"""Listing-shaped views over the driver's star-schema tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FIELDS
from ..sources.staging import spread

LISTING = """
SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '-' || CAST(l.l_partkey AS STRING) || '-' || CAST(l.l_suppkey AS STRING) || '-' || CAST(CAST(floor(l.l_extendedprice * 100 + 0.5) AS BIGINT) AS STRING) AS id,
       'V' || CAST(l.l_partkey AS STRING) AS vin,
       CASE WHEN l.l_linestatus = 'O' THEN 'dealer-feed-a' ELSE 'marketplace-b' END AS source,
       p.p_brand AS make, p.p_type AS model, CAST(year(o.o_orderdate) AS INT) AS model_year, n.n_name AS province, c.c_mktsegment AS city,
       CASE WHEN l.l_linenumber = 4 AND l.l_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(l.l_extendedprice * 100 + 0.5) AS BIGINT) END AS price_cents,
       CASE WHEN l.l_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(l.l_quantity * 1000) AS BIGINT) END AS odometer_km,
       CASE WHEN l.l_returnflag = 'R' THEN 'removed' ELSE 'active' END AS status, o.o_orderdate AS listed_at
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

#: Every user is a listing, of which ten share a VIN, and every event an observed price.
HISTORY = """
SELECT 'V' || CAST(user_id % 50 AS STRING) AS vin, CAST(user_id AS STRING) AS listing_id, CAST(floor(value * 100 + 0.5) AS BIGINT) AS price_cents, ts AS observed_at FROM {events}
"""
OWNER = """
SELECT DISTINCT CAST(user_id AS STRING) AS id, 'V' || CAST(user_id % 50 AS STRING) AS vin, CASE WHEN user_id % 2 = 0 THEN 'dealer-feed-a' ELSE 'marketplace-b' END AS source,
       CAST(user_id * 100 AS BIGINT) AS price_cents, CASE WHEN user_id % 3 = 0 THEN 'removed' ELSE 'active' END AS status
FROM {events}
"""

#: A raw feed: every customer is a vehicle, every order a listing of it, with faults by remainders of the order's number.
_DIGITS = """
SELECT o_orderkey AS ord, o_custkey AS cust, o_custkey % 10 AS a, (o_custkey % 100 - o_custkey % 10) / 10 AS b, (o_custkey % 1000 - o_custkey % 100) / 100 AS c, o_custkey % 9 + 1 AS y,
       CAST(floor(o_totalprice) AS BIGINT) AS dollars, o_orderdate FROM {orders}
"""
RAW = f"""
SELECT ord, CASE WHEN ord % 2 = 0 THEN 'dealer-feed-a' ELSE 'marketplace-b' END AS source, 'batch-' || CAST(ord % 7 AS STRING) AS batch_id,
       CASE WHEN ord % 19 = 0 THEN '  ' WHEN ord % 17 = 0 THEN substr(whole, 1, 16) WHEN ord % 13 = 0 THEN substr(whole, 1, 8) || 'Z' || substr(whole, 10, 8) WHEN ord % 5 = 0 THEN lower(whole) WHEN ord % 7 = 0 THEN ' ' || whole || ' ' ELSE whole END AS vin,
       CASE WHEN ord % 23 = 0 THEN '' WHEN ord % 29 = 0 THEN '1899' WHEN ord % 31 = 0 THEN '2003.5' WHEN ord % 37 = 0 THEN '  ' WHEN ord % 41 = 0 THEN '12d' WHEN ord % 10 = 3 THEN CAST(2001 + y AS STRING) ELSE CAST(2000 + y AS STRING) END AS year,
       CASE WHEN ord % 43 = 0 THEN 'call for price' WHEN ord % 47 = 0 THEN '$' WHEN ord % 11 = 0 THEN '' WHEN ord % 2 = 0 THEN CAST(dollars AS STRING)
            WHEN ord % 4 = 1 THEN '$' || spaced ELSE replace(spaced, ',', ' ') || ' $' END AS price,
       CASE WHEN ord % 2 = 0 AND ord % 11 <> 0 AND ord % 43 <> 0 AND ord % 47 <> 0 THEN 'number' ELSE 'string' END AS price_kind,
       CASE WHEN ord % 21 = 0 THEN 'n/a' WHEN ord % 27 = 0 THEN '-5' WHEN ord % 33 = 0 THEN '' ELSE CAST(dollars AS STRING) END AS odometer,
       CASE WHEN ord % 14 = 1 THEN ' ' WHEN cust % 4 < 2 THEN 'Honda' WHEN cust % 4 = 2 THEN 'Volkswagen' ELSE 'Yugo' END AS make,
       CASE WHEN ord % 15 = 1 THEN NULL WHEN cust % 4 = 0 THEN 'Accord' WHEN cust % 4 = 1 THEN 'CR-V' WHEN cust % 4 = 2 THEN 'Golf' ELSE 'GV' END AS model,
       CASE WHEN ord % 9 = 0 THEN 'EX-L' WHEN ord % 9 = 1 THEN 'exl' WHEN ord % 9 = 2 THEN 'EX L' WHEN ord % 9 = 3 THEN 'EX AWD NAVI' WHEN ord % 9 = 4 THEN 'EX NAVI AWD' WHEN ord % 9 = 5 THEN 'gti awd' WHEN ord % 9 = 6 THEN '' WHEN ord % 9 = 7 THEN NULL ELSE ' Touring ' END AS trim,
       CASE WHEN ord % 4 = 0 THEN NULL ELSE 'sedan' END AS body_style, CASE WHEN ord % 6 = 0 THEN NULL ELSE 'gasoline' END AS fuel_type,
       CASE WHEN ord % 8 = 0 THEN NULL ELSE 'c' || CAST(ord % 3 AS STRING) END AS exterior_color,
       CASE WHEN ord % 16 = 5 THEN NULL ELSE CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-01T00:00:00.000Z' END AS listed_at,
       CASE WHEN ord % 12 = 7 THEN NULL WHEN ord % 10 = 0 THEN 'removed' ELSE 'active' END AS status,
       CASE WHEN ord % 18 = 5 THEN NULL ELSE 'STK' || CAST(ord - ord % 5 AS STRING) END AS stock_number
FROM (
    SELECT *, '1HGCM' || body || substr('0123456789X', CAST(sum11 % 11 AS INT) + 1, 1) || CAST(y AS STRING) || 'A' || serial AS whole,
           CASE WHEN dollars >= 1000 THEN CAST(CAST((dollars - dollars % 1000) / 1000 AS BIGINT) AS STRING) || ',' || lpad(CAST(dollars % 1000 AS STRING), 3, '0') ELSE CAST(dollars AS STRING) END AS spaced
    FROM (
        SELECT *, lpad(CAST(cust % 1000 AS STRING), 3, '0') AS body, lpad(CAST(cust % 1000000 AS STRING), 6, '0') AS serial,
               145 + 3 * c + 2 * b + 10 * a + 9 * y + 7 * (cust % 1000000 - cust % 100000) / 100000 + 6 * (cust % 100000 - cust % 10000) / 10000 + 5 * (cust % 10000 - cust % 1000) / 1000 + 4 * c + 3 * b + 2 * a AS sum11
        FROM ({_DIGITS}) d
    ) e
) f
"""
RECORD = """'{"vin":"' || vin || '","year":"' || year || '","price":"' || price || '"}'"""

#: What a decoder knows of some prefixes.
CACHE = """
SELECT wmi_vds_prefix, n % 5 <> 0 AS valid, CASE WHEN n % 4 = 0 THEN ' ' WHEN n % 3 = 1 THEN 'HONDA' ELSE 'Volkswagen' END AS make, CASE WHEN n % 7 = 0 THEN NULL ELSE 'accord' END AS model,
       CASE WHEN n % 11 = 0 THEN NULL ELSE CAST(2000 + y AS INT) END AS year, CASE WHEN n % 2 = 0 THEN '' ELSE 'Base' END AS trim, CASE WHEN n % 6 = 0 THEN NULL ELSE 'Series' END AS series,
       'coupe' AS body_style, CAST(NULL AS STRING) AS fuel_type, 'FWD' AS drive_type, 'manual' AS transmission
FROM (SELECT DISTINCT substr(vin, 1, 11) AS wmi_vds_prefix, CAST(substr(vin, 6, 3) AS INT) AS n, CAST(substr(vin, 10, 1) AS INT) AS y FROM {vins}) q WHERE n % 3 <> 2
"""

#: Silver rows before a batch: one for every order, of which a fifth have a stock number that the batch may use.
OLD_LISTINGS = """
SELECT CAST(o_orderkey AS STRING) AS id, 'OLD' || CAST(o_custkey AS STRING) AS vin, CASE WHEN o_orderkey % 2 = 0 THEN 'dealer-feed-a' ELSE 'marketplace-b' END AS source, 'STK' || CAST(o_orderkey AS STRING) AS source_listing_id, 'old' AS batch_id,
       CAST(floor(o_totalprice) AS BIGINT) * 100 AS price_cents, 'CAD' AS currency, CAST(o_orderkey % 1000 AS INT) AS odometer_km, 'old' AS trim_raw, 'ON' AS province, 'Ottawa' AS city, CAST(1.5 AS DECIMAL(9, 6)) AS latitude, CAST(NULL AS DECIMAL(9, 6)) AS longitude,
       CASE WHEN o_orderkey % 5 = 0 THEN 'removed' ELSE 'active' END AS status, FALSE AS year_conflict, TIMESTAMP '2020-01-01 00:00:00' AS listed_at, CAST(NULL AS TIMESTAMP) AS delisted_at,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'OldMake' END AS make, 'OldModel' AS model, 1999 AS model_year, TIMESTAMP '2020-01-01 00:00:00' AS created_at, TIMESTAMP '2020-01-01 00:00:00' AS updated_at
FROM {orders}
"""
OLD_VEHICLES = """
SELECT vin, substr(vin, 1, 3) AS wmi, 'OldMake' AS make, CAST(NULL AS STRING) AS model, 1999 AS model_year, 'old' AS trim, CAST(NULL AS STRING) AS body_style, 'diesel' AS fuel_type, 'AWD' AS drive_train, CAST(NULL AS STRING) AS transmission,
       CASE WHEN CAST(substr(vin, 6, 3) AS INT) % 2 = 0 THEN 'decoded' ELSE 'undecoded' END AS decode_source, TIMESTAMP '2020-01-01 00:00:00' AS first_seen_at, TIMESTAMP '2020-01-01 00:00:00' AS last_seen_at, TIMESTAMP '2020-01-01 00:00:00' AS created_at, TIMESTAMP '2020-01-01 00:00:00' AS updated_at
FROM (SELECT DISTINCT vin FROM {vins}) q WHERE CAST(substr(vin, 6, 3) AS INT) % 3 <> 1
"""
RUNS = """
SELECT CAST(event_id AS STRING) AS id, 'run-' || CAST(user_id % 3 AS STRING) AS run_id, event_type AS stage, CASE WHEN event_id % 2 = 0 THEN 'dealer-feed-a' ELSE 'marketplace-b' END AS source, CAST(event_id % 100 AS BIGINT) AS rows_in,
       CAST(event_id % 90 AS BIGINT) AS rows_out, CAST(event_id % 10 AS BIGINT) AS rejects, ts AS started_at, CAST(event_id % 1000 AS BIGINT) AS duration_ms
FROM {events}
"""
METRICS = "SELECT CAST(event_id AS STRING) AS run_id, 'all' AS source, 'm' || CAST(event_id % 5 AS STRING) AS metric_name, CAST(event_id % 17 AS DOUBLE) AS metric_value FROM {events}"
#: Vehicles from which listings are filled in.
OWN_VEHICLES = "SELECT DISTINCT 'OLD' || CAST(c_custkey AS STRING) AS vin, 'M' || CAST(c_custkey % 7 AS STRING) AS make, 'X' AS model, 2010 AS model_year FROM {customer} WHERE c_acctbal > 0"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


class Views:
    """The views as DataFrames over the Parquet tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if f"{{{t}}}" in text}
        return self.spark.sql(text, **used, **more)

    def listing(self) -> DataFrame:
        return self.sql(LISTING)

    def dealt_listing(self) -> DataFrame:
        """The same for plans that read and sum up most of it: line items may be one file, and are dealt over the cluster."""
        return self.spark.sql(LISTING, **{t: spread(self.table(t)) if t == "lineitem" else self.table(t) for t in TABLES if f"{{{t}}}" in LISTING})

    def history(self) -> DataFrame:
        return self.sql(HISTORY)

    def flat(self) -> DataFrame:
        """The raw feed's columns. The table may be one file: it is dealt over the cluster as landed files are."""
        return self.spark.sql(RAW, orders=spread(self.table("orders")))

    def raw(self) -> DataFrame:
        """Raw records as the bronze reader gives them."""
        flat = self.flat()
        own = {"bodyStyle": "body_style", "fuelType": "fuel_type", "exteriorColor": "exterior_color", "listedAt": "listed_at", "stockNumber": "stock_number"}
        kinds = lambda c: F.col("price_kind") if c == "price" else F.when(F.col(own.get(c, c)).isNull(), "missing").otherwise("string")
        none = F.struct(F.lit(None).cast("string").alias("text"), F.lit("missing").alias("kind"))
        f = [(F.struct(F.col(own.get(c, c)).alias("text"), kinds(c).alias("kind")) if own.get(c, c) in flat.columns else none).alias(c) for c in FIELDS]
        return flat.select("source", "batch_id", F.col("ord").alias("ordinal"), F.expr(RECORD).alias("raw_record"), F.struct(*f).alias("f"))
