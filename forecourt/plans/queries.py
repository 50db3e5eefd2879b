"""The engine's operators as queries over the driver's tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spelling, vin
from ..operators import enrich, normalize, quality, survivorship, upsert, validate
from ..pipeline import refresh_gold
from ..schemas import SOURCE_A, SOURCE_B
from ..sources import bronze, generator
from ..sources.staging import new_folder, staged
from ..sources.store import Store
from ..streaming.ingest import ingest
from . import gold, lake, load, views
from .views import Views

YEAR = 2026
NOW = "2026-01-01 00:00:00"
MAKE = "Brand#12"


def now():
    return F.lit(NOW).cast("timestamp")


class Steps:
    """The pipeline's steps over the raw view; what several of them read is staged, as the pipeline does."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.v = spark, Views(spark, sf_dir)
        self.checked = validate.checked(self.v.raw(), YEAR)

    @cached_property
    def normal(self) -> DataFrame:
        dictionary = normalize.trim_dictionary(self.spark, generator.trims())
        return staged(normalize.normalize(validate.valid(self.checked), YEAR, dictionary), "normal")

    @cached_property
    def survivors(self) -> DataFrame:
        return survivorship.survivors(self.normal)

    @cached_property
    def cache(self) -> DataFrame:
        return self.v.sql(views.CACHE, vins=self.normal)

    @cached_property
    def vehicles(self) -> DataFrame:
        return staged(enrich.enrich(self.survivors, self.cache), "vehicles")

    @cached_property
    def listings(self) -> DataFrame:
        return enrich.enrich_listings(self.normal, self.vehicles)

    @cached_property
    def batch(self) -> DataFrame:
        return staged(upsert.staged_listings(self.listings), "batch")

    def old_listings(self) -> DataFrame:
        return self.v.sql(views.OLD_LISTINGS)

    def old_vehicles(self) -> DataFrame:
        return self.v.sql(views.OLD_VEHICLES, vins=self.normal)


def market_stats(spark, sf_dir):
    return gold.market_cents(Views(spark, sf_dir).dealt_listing())


def browse_topk(spark, sf_dir):
    return gold.browse(Views(spark, sf_dir).listing(), MAKE, "LARGE", (1993, 1997), "NATION_3", 50)


def browse_wide(spark, sf_dir):
    """Browsing without make and model: enough rows for the limit to cut."""
    return gold.browse(Views(spark, sf_dir).listing(), None, None, (1993, 1997), "NATION_3", 50)


def gold_market_stats(spark, sf_dir):
    """The gold table itself, its dollars as cents."""
    out = gold.market_stats(Views(spark, sf_dir).dealt_listing())
    return out.withColumns({c: (F.col(c) * 100).cast("long") for c in ("avg_price_cad", "median_price_cad")})


def make_stats_topk(spark, sf_dir):
    return gold.make_stats(Views(spark, sf_dir).dealt_listing(), MAKE, 20)


def vin_history(spark, sf_dir):
    v = Views(spark, sf_dir)
    return gold.vin_history(v.sql(views.OWNER), v.history())


def recent_topk(spark, sf_dir):
    return gold.recent(Views(spark, sf_dir).listing(), "NATION_7", 50)


def price_drops(spark, sf_dir):
    out = gold.price_drops(Views(spark, sf_dir).history())
    return out.withColumn("price_drop_pct", (F.col("price_drop_pct") * 100).cast("long"))


def price_drops_top20(spark, sf_dir):
    out = gold.largest_drops(Views(spark, sf_dir).history(), 20)
    return out.withColumn("pct_drop", (F.col("pct_drop") * 10).cast("long"))


def latest_price(spark, sf_dir):
    return upsert.latest_price(Views(spark, sf_dir).history())


def price_changes(spark, sf_dir):
    s = Steps(spark, sf_dir)
    old = s.old_listings()
    history = old.where("status <> 'removed'").select("vin", F.col("id").alias("listing_id"), "price_cents", F.lit("2020-01-01 00:00:00").cast("timestamp").alias("observed_at"))
    return upsert.price_changes(s.batch, old, history, now())


def check_digit(spark, sf_dir):
    v = F.trim(F.col("f.vin.text"))
    return Views(spark, sf_dir).raw().select("ordinal", vin.check_digit(v).alias("digit"), vin.is_valid(v).alias("is_valid"))


def build_vin(spark, sf_dir):
    o = Views(spark, sf_dir).table("orders")
    serial = F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0")
    year = (F.lit(1980) + F.col("o_custkey") % 55).cast("int")
    return o.select("o_orderkey", vin.year_code(year).alias("code"), vin.build(F.lit("1VW"), F.lit("BH7A3"), year, F.lit("C"), serial).alias("vin"))


def validate_split(spark, sf_dir):
    return Steps(spark, sf_dir).checked.select("ordinal", "source", F.array_join("reason_codes", ",").alias("reasons"), F.when(F.size("reason_codes") == 0, F.col("vin")).alias("vin"))


def reason_counts(spark, sf_dir):
    return quality.reason_counts(validate.rejected(Steps(spark, sf_dir).checked, now()))


def quarantine_hash(spark, sf_dir):
    """Rejects whose hash is not in a quarantine that already holds the batches 0 to 2."""
    new = validate.rejected(Steps(spark, sf_dir).checked, now())
    held = new.where(F.col("batch_id").isin("batch-0", "batch-1", "batch-2"))
    out = validate.new_rows(new, held, ["source", "batch_id", "content_hash"])
    return out.select("source", "batch_id", "content_hash", F.array_join("reason_codes", ",").alias("reasons"))


def quarantine_age(spark, sf_dir):
    q = Views(spark, sf_dir).table("events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("quarantined_at"), F.when(F.col("event_id") % 3 == 0, now()).alias("resolved_at"))
    return validate.quarantine_age(q, now())


def rejection_rate(spark, sf_dir):
    out = quality.rejection_rate(Steps(spark, sf_dir).checked)
    return out.withColumn("rejection_rate", F.round(F.col("rejection_rate") * 1000000).cast("long"))


def parse_price(spark, sf_dir):
    p = normalize.parse_price(F.col("f.price.text"), F.col("f.price.kind"))
    return Views(spark, sf_dir).raw().select("ordinal", p["cents"].alias("cents"), p["malformed"].alias("malformed"))


def odometer_units(spark, sf_dir):
    return Steps(spark, sf_dir).normal.select("ordinal", "odometer_km", "odometer_was_converted_from_miles")


def trim_canonical(spark, sf_dir):
    return Steps(spark, sf_dir).normal.select("ordinal", "make", "model", "trim", "trim_matched")


def normalized(spark, sf_dir):
    return Steps(spark, sf_dir).normal.select("ordinal", "vin", "make", "model", (F.col("raw_year") * 10).cast("long").alias("year_x10"), "body_style", "fuel_type", "exterior_color", "listed_at", "status", "stock_number")


def french_names(spark, sf_dir):
    o = Views(spark, sf_dir).table("orders")
    rows = o.select(F.col("o_orderkey").cast("string").alias("numero_stock"), F.col("o_orderstatus").alias("statut"), F.col("o_orderpriority").alias("champ_inconnu"))
    return normalize.rename_french(rows)


def spellings(spark, sf_dir):
    o = Views(spark, sf_dir).table("orders")
    price = F.floor("o_totalprice")
    trim = F.concat(F.lit("EX-"), "o_orderstatus")
    own = [F.element_at(spelling.trim_variants(trim), i + 1).alias(f"v{i + 1}") for i in range(6)]
    return o.select("o_orderkey", spelling.dollars(price).alias("dollars"), spelling.dollars_quebec(price).alias("quebec"), *own, spelling.km_to_miles(price).alias("miles"), spelling.trim_form(F.element_at(spelling.trim_variants(trim), 5)).alias("form"))


def survivors(spark, sf_dir):
    return Steps(spark, sf_dir).survivors.select("vin", "make", "model", "trim", "body_style", "fuel_type", "exterior_color", (F.col("first_year") * 10).cast("long").alias("first_year_x10"), "n_years", "year_conflict", "first_ordinal")


def completeness_score(spark, sf_dir):
    return Steps(spark, sf_dir).normal.select("ordinal", survivorship.completeness().alias("score"))


def decode_misses(spark, sf_dir):
    s = Steps(spark, sf_dir)
    return enrich.missing_prefixes(s.survivors.select("vin", "first_ordinal"), s.cache)


def enrich_vehicles(spark, sf_dir):
    out = Steps(spark, sf_dir).vehicles
    return out.withColumn("model_year", (F.col("model_year") * 10).cast("long")).drop("first_ordinal")


def enrich_listings(spark, sf_dir):
    return Steps(spark, sf_dir).listings.select("ordinal", "vehicle_make", "vehicle_model", "year_conflict")


def enrich_metrics(spark, sf_dir):
    s = Steps(spark, sf_dir)
    return enrich.enrich_metrics(s.vehicles, s.listings)


def listing_keys(spark, sf_dir):
    return Steps(spark, sf_dir).batch.select("source", "source_listing_id", "vin", "price_cents", "batch_id", "status")


def upsert_listings(spark, sf_dir):
    s = Steps(spark, sf_dir)
    out = upsert.upsert_listings(s.old_listings(), s.batch, now())
    return out.select("source", "source_listing_id", "vin", "batch_id", "price_cents", "odometer_km", "trim_raw", "province", "status", "year_conflict", "make", "model", "model_year", F.col("delisted_at").isNotNull().alias("delisted"), (F.col("updated_at") == now()).alias("touched"))


def upsert_vehicles(spark, sf_dir):
    s = Steps(spark, sf_dir)
    out = upsert.upsert_vehicles(s.old_vehicles(), upsert.staged_vehicles(s.vehicles), now())
    return out.select("vin", "wmi", "make", "model", "model_year", "trim", "body_style", "fuel_type", "drive_train", "transmission", "decode_source", (F.col("first_seen_at") == now()).alias("is_new"), (F.col("last_seen_at") == now()).alias("seen"))


def backfill(spark, sf_dir):
    s = Steps(spark, sf_dir)
    return upsert.backfill(s.old_listings(), s.v.sql(views.OWN_VEHICLES)).select("id", "make", "model", "model_year")


def dup_conflict(spark, sf_dir):
    out = quality.duplicate_conflict(Steps(spark, sf_dir).normal)
    rates = ("within_source_duplicate", "cross_source_duplicate", "year_conflict")
    return out.select("unique_vins", *rates, *(F.round(F.col(f"{c}_rate") * 1000000).cast("long").alias(f"{c}_rate_ppm") for c in rates))


def price_outliers(spark, sf_dir):
    return quality.price_outliers(Views(spark, sf_dir).listing(), sigmas=1.75)


def price_outliers_3s(spark, sf_dir):
    """At the default of three deviations, over observed prices by kind of event: their tails are long enough."""
    rows = Views(spark, sf_dir).table("events").select(F.col("event_type").alias("make"), F.lit("all").alias("model"), F.floor(F.col("value") * F.col("value")).cast("long").alias("price_cents"))
    return quality.price_outliers(rows)


def completeness(spark, sf_dir):
    s = Steps(spark, sf_dir)
    out = quality.completeness(s.checked, s.normal)
    return out.select("source", "rows_in", "valid", "quarantined", "priced", "with_odometer", "with_trim", "known_trim", F.round(F.col("trim_coverage") * 1000000).cast("long").alias("trim_coverage_ppm"))


def stage_rollup(spark, sf_dir):
    return quality.stage_rollup(Views(spark, sf_dir).sql(views.RUNS).where("run_id = 'run-1'"))


def latest_run(spark, sf_dir):
    return quality.latest_run(Views(spark, sf_dir).sql(views.RUNS))


def run_metrics(spark, sf_dir):
    v = Views(spark, sf_dir)
    return quality.run_metrics(v.sql(views.METRICS), v.sql(views.RUNS), "run-1")


def table_counts(spark, sf_dir):
    v = Views(spark, sf_dir)
    return quality.table_counts({t: v.table(t) for t in views.TABLES})


def both_sources(spark, sf_dir):
    """Bag union of two feeds, by source and batch."""
    raw = Views(spark, sf_dir).raw()
    both = bronze.both([raw.where(F.col("source") == s) for s in (SOURCE_A, SOURCE_B)])
    return both.groupBy("source", "batch_id").agg(F.count("*").alias("n"))


def landed_batches(spark, sf_dir):
    """Batches as the manifests of a landing name them, with their rows."""
    _, manifests = lake.landed(spark, sf_dir)
    rows = [(m["source"], m["date"], b["key"], b["rows"], m["totalRows"], m["totalObjects"], b["compressedBytes"] > 0) for m in manifests.values() for b in m["batches"]]
    return spark.createDataFrame(rows, "source string, date string, key string, n long, total_rows long, total_objects long, compressed boolean")


def manifest_rollup(spark, sf_dir):
    """Rows and batches by source, as the manifests hold them."""
    root, _ = lake.landed(spark, sf_dir)
    return spark.createDataFrame(bronze.list_bronze(root), "source string, total_objects long, dates long, total_rows long")


def bronze_read(spark, sf_dir):
    """Records as they are read from landed files: texts and kinds of some fields."""
    root, _ = lake.landed(spark, sf_dir)
    own = [F.col(f"f.{c}.{x}").alias(f"{c.lower()}_{x}") for c in ("vin", "price", "stockNumber", "trim", "interiorColor") for x in ("text", "kind")]
    return bronze.read(spark, root).select("source", "batch_id", *own)


def bronze_read_date(spark, sf_dir):
    """Records of one date, of which another source has none."""
    root, _ = lake.landed(spark, sf_dir)
    return bronze.read(spark, root, lake.DAYS[SOURCE_B]).groupBy("source", "batch_id").agg(F.count("*").alias("n"))


def lake_run(spark, sf_dir):
    """What a run of the pipeline leaves: rows by stage, by table, by reason of rejection, and its measures in millionths."""
    root, run_id = lake.ran(spark, sf_dir, YEAR, NOW)
    store = Store(spark, f"{root}/silver")
    runs = store.table("pipeline_runs")
    none = F.lit(None).cast("long")
    stages = quality.stage_rollup(runs.where(F.col("run_id") == quality.latest_run(runs).first().run_id)).select(F.lit("stage").alias("section"), F.col("stage").alias("name"), "source", F.col("rows_in").alias("n"), "rows_out", "rejects", "batches")
    tables = quality.table_counts({t: store.table(t) for t in ("vehicles", "listings", "price_history", "quarantine", "decode_cache")})
    reasons = quality.reason_counts(store.table("quarantine"))
    metrics = quality.run_metrics(store.table("quality_metrics"), runs, run_id).where("source = 'all'").where(~F.col("metric_name").isin("decode_success_rate", "make_model_agreement_rate", "year_conflict_listings", "price_outlier_rate"))
    more = [
        tables.select(F.lit("table").alias("section"), F.col("table_name").alias("name"), F.lit("").alias("source"), "n"), reasons.select(F.lit("reason").alias("section"), F.col("reason").alias("name"), "source", "n"),
        metrics.select(F.lit("metric").alias("section"), F.col("metric_name").alias("name"), "source", F.round(F.col("metric_value") * 1000000).cast("long").alias("n")),
    ]
    for df in more:
        stages = stages.unionByName(df.withColumns(dict.fromkeys(("rows_out", "rejects", "batches"), none)))
    return stages


def lake_gold(spark, sf_dir):
    """The refreshed gold table of a lake on which the pipeline ran, its dollars as cents."""
    root, _ = lake.ran(spark, sf_dir, YEAR, NOW)
    out = refresh_gold(spark, root)["gold_market_stats"]
    return out.withColumns({c: (F.col(c) * 100).cast("long") for c in ("avg_price_cad", "median_price_cad")})


def stream_ingest(spark, sf_dir):
    """Landed batches taken in as a stream: rows that were kept, and rejects."""
    root, _ = lake.landed(spark, sf_dir)
    out = new_folder(spark, "stream")
    ingest(spark, root, f"{out}/rows", YEAR, f"{out}/checkpoint").awaitTermination()
    kept, rejected = (spark.read.parquet(f"{out}/rows/{x}") for x in ("normal", "rejected"))
    return quality.table_counts({"normal": kept, "rejected": rejected})


def store_append(spark, sf_dir):
    """A table committed, added to, and written without a commit: readers see the first two."""
    store = Store(spark, new_folder(spark, "silver"))
    rows = Views(spark, sf_dir).history()
    rows = rows.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    store.commit(price_history=rows)
    store.append(price_history=rows.where("price_cents > 5000"))
    store.write("price_history", rows)
    store.vacuum()
    return store.table("price_history").groupBy("listing_id").agg(F.count("*").alias("n"), F.sum("price_cents").alias("cents"))


def load_both_ways(spark, sf_dir):
    """All regions loaded in bulk and row by row, in one table each."""
    store = Store(spark, new_folder(spark, "load"))
    load.loaded(store, Views(spark, sf_dir).table("region"))
    both = [store.table(name).withColumn("load", F.lit(name)) for name in (load.BULK, load.SINGLE)]
    return both[0].unionByName(both[1])


def ensure_tables(spark, sf_dir):
    """Silver tables made where one is there already: columns and rows of each."""
    store = Store(spark, new_folder(spark, "silver"))
    store.commit(price_history=Views(spark, sf_dir).history().withColumn("observed_at", F.col("observed_at").cast("timestamp")))
    store.ensure_tables()
    store.ensure_tables()
    counts = quality.table_counts({name: store.table(name) for name in store.current()})
    columns = spark.createDataFrame([(name, len(store.table(name).columns)) for name in store.current()], "table_name string, columns long")
    return counts.join(columns, "table_name")


def cached_prefixes(spark, sf_dir):
    """Cache rows of the prefixes that a run asks for."""
    s = Steps(spark, sf_dir)
    return enrich.cached(s.survivors.where("trim is not null"), s.cache).select("wmi_vds_prefix", "valid", "year")


def seed_decode(spark, sf_dir):
    """VINs built from the generator's seeds, decoded by the default decoder; prefixes of no seed stay undecoded."""
    rows = generator.decoder_rows()
    seeds = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, wmi string, vds string, plant string, make string, model string, body_style string, fuel_type string, first_year int, last_year int")
    o = Views(spark, sf_dir).table("orders").withColumn("i", (F.col("o_custkey") % (len(rows) + 1)).cast("int"))
    year = (F.col("first_year") + F.col("o_orderkey") % (F.col("last_year") - F.col("first_year") + 1)).cast("int")
    serial = F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0")
    known = vin.build(F.col("wmi"), F.col("vds"), year, F.col("plant"), serial)
    other = vin.build(F.lit("9ZZ"), F.lit("00000"), F.lit(2020), F.lit("Z"), serial)
    vins = o.join(F.broadcast(seeds), "i", "left").select("o_orderkey", F.coalesce(known, other).alias("vin"))
    decoded = enrich.seed_decoder(spark, rows)(vins.groupBy(vin.prefix(F.col("vin")).alias("prefix")).agg(F.min("vin").alias("vin")))
    return vins.join(decoded, vin.prefix(F.col("vin")) == F.col("wmi_vds_prefix")).select("o_orderkey", "valid", "make", "model", "year", "body_style", "fuel_type")


def broken_vins(spark, sf_dir):
    """VINs with a wrong digit, and of a wrong length: what is left of the right one."""
    o = Views(spark, sf_dir).table("orders")
    whole = vin.build(F.lit("1VW"), F.lit("BH7A3"), F.lit(2015), F.lit("C"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"))
    rows = o.select("o_orderkey", whole.alias("whole"))
    for name, rate in (("digit", {"vin_length": 0.0, "vin_digit": 1.0}), ("length", {"vin_length": 1.0, "vin_digit": 0.0}), ("neither", {"vin_length": 0.0, "vin_digit": 0.0})):
        rows = rows.withColumn(name, generator.broken_vin(F.col("whole"), generator.Draws(42, F.col("o_orderkey"), name), rate))
    same = lambda a, b: (F.substring(a, 1, 8) == F.substring(b, 1, 8)) & (F.substring(a, 10, 8) == F.substring(b, 10, 8))
    return rows.select(
        "o_orderkey", (same("digit", "whole") & ~vin.is_valid(F.col("digit")) & (F.length("digit") == 17)).alias("digit_is_wrong"),
        (F.length("length").isin(16, 18) & (F.substring("length", 1, 16) == F.substring("whole", 1, 16))).alias("length_is_wrong"), (F.col("neither") == F.col("whole")).alias("neither_is_whole"),
    )


def generated_rows(spark, sf_dir):
    """As many generated listings of either source as there are orders, each against the seeds and rules that it is made by."""
    n = Views(spark, sf_dir).table("orders").count()
    a, b = generator.listings(spark, 42, n, n // 2, 0.1, "2026-01-01")
    seeds = spark.createDataFrame([(s[0], s[1], s[2], s[3], s[4], s[5], s[6], s[7], s[8], s[9], s[10]) for s in generator.SEEDS], "wmi string, vds string, plant string, s_make string, s_model string, body string, fuel string, trims array<string>, low int, high int, base int")
    cities = spark.createDataFrame(generator.CITIES, "s_province string, s_city string, lat double, lon double")
    v = F.col("vin")
    out = a.unionByName(b).join(F.broadcast(seeds), (F.substring(v, 1, 3) == F.col("wmi")) & (F.substring(v, 4, 5) == F.col("vds")) & (F.substring(v, 11, 1) == F.col("plant")), "left")
    out = out.join(F.broadcast(cities), (F.col("province") == F.col("s_province")) & (F.col("city") == F.col("s_city")), "left")
    return out.select(
        F.col("row"), vin.is_valid(v).alias("vin_ok"), ((F.col("make") == F.col("s_make")) & (F.col("model") == F.col("s_model")) & (F.col("bodyStyle") == F.col("body")) & (F.col("fuelType") == F.col("fuel"))).alias("seed_ok"),
        (F.array_contains("trims", F.col("trim")) & F.col("year").between(F.col("low") - 1, F.col("high") + 1)).alias("range_ok"),
        ((F.col("price") % 100 == 0) & F.col("price").between(F.floor(F.col("base") * 0.35 * 0.85) - 1500, F.floor(F.col("base") * 1.15) + 1900)).alias("price_ok"),
        ((F.abs(F.col("latitude") - F.col("lat")) <= 0.0501) & (F.abs(F.col("longitude") - F.col("lon")) <= 0.0501)).alias("place_ok"), F.col("status").isin("active", "removed").alias("status_ok"),
    )


def formatted_measures(spark, sf_dir):
    """Values of measures as the report writes them: whole numbers, shares, and others."""
    values = Views(spark, sf_dir).sql(views.METRICS).select((F.col("metric_value") / 4).alias("v")).distinct().collect()  # 17 values
    return spark.createDataFrame([(int(4 * r.v), quality.formatted(r.v)) for r in values], "quarters long, text string")


def date_label(spark, sf_dir):
    return Views(spark, sf_dir).table("orders").groupBy(bronze.date_label(F.col("o_orderdate")).alias("label")).agg(F.count("*").alias("n"))


def outlier_rows(spark, sf_dir):
    return quality.outlier_rows(Views(spark, sf_dir).listing(), sigmas=1.75).groupBy("make").agg(F.count("*").alias("n"))


NAMES = [
    market_stats, browse_topk, browse_wide, make_stats_topk, vin_history, recent_topk, price_drops, price_drops_top20, latest_price, price_changes, check_digit, build_vin, validate_split, reason_counts,
    quarantine_hash, quarantine_age, rejection_rate, parse_price, odometer_units, trim_canonical, normalized, french_names, spellings, survivors, completeness_score, decode_misses, enrich_vehicles, enrich_listings,
    enrich_metrics, listing_keys, upsert_listings, upsert_vehicles, backfill, dup_conflict, price_outliers, completeness, stage_rollup, latest_run, run_metrics, table_counts, both_sources, manifest_rollup,
    cached_prefixes, date_label, outlier_rows, gold_market_stats, price_outliers_3s, landed_batches, bronze_read, bronze_read_date, lake_run, lake_gold, stream_ingest, store_append, seed_decode, broken_vins,
    generated_rows, formatted_measures, ensure_tables, load_both_ways,
]
QUERIES = {f.__name__: f for f in NAMES}
