import random
from statistics import median

from pyspark.sql import functions as F

from forecourt.functions.pg import rounded_ratio
from forecourt.operators import enrich, medians, quality, survivorship, upsert
from forecourt.plans import gold
from forecourt.schemas import SILVER

NORMAL = "ordinal long, source string, batch_id string, vin string, stock_number string, price_cents long, odometer_km long, make string, model string, raw_year double, trim string, body_style string, fuel_type string, exterior_color string, interior_color string, condition string, province string, city string, latitude double, longitude double, listed_at string, status string"
V1 = "1VWBH7A30DC104945"


def record(ordinal, **more):
    base = {"ordinal": ordinal, "source": "dealer-feed-a", "batch_id": "b", "vin": V1, "stock_number": f"STK{ordinal}", "raw_year": 2013.0} | more
    return [base.get(c.split()[0]) for c in NORMAL.split(", ")]


def frame(spark, *records):
    return spark.createDataFrame(list(records), NORMAL)


def test_survivorship_takes_each_field_from_the_best_record(spark):
    df = frame(spark, record(1, make="Thin", trim="LX"), record(2, make="Rich", model="M", fuel_type="g", listed_at="2020"), record(3, make="Late", model="N", fuel_type="g", listed_at="2021"))
    row = survivorship.survivors(df).first()
    assert (row.make, row.model, row.trim, row.body_style) == ("Late", "N", "LX", None)
    assert (row.n_years, row.year_conflict, row.first_ordinal) == (1, False, 1)


def test_survivorship_ties_go_to_input_order_whatever_the_partitions(spark):
    df = frame(spark, *(record(i, make=f"m{i}", raw_year=2000.0 + i) for i in range(20, 0, -1)))
    for n in (1, 3, 7):
        row = survivorship.survivors(df.repartition(n)).first()
        assert (row.make, row.first_year, row.n_years, row.year_conflict) == ("m1", 2001.0, 20, True)


CACHE = SILVER["decode_cache"][0]


def cache(spark, valid=True, **more):
    base = {"wmi_vds_prefix": V1[:11], "valid": valid} | more
    return spark.createDataFrame([[base.get(c.split()[0]) for c in CACHE.split(", ")]], CACHE)


def test_enrichment_prefers_the_decode_unless_it_is_empty(spark):
    survivors = survivorship.survivors(frame(spark, record(1, make="Toyota", model="Corolla", trim="LE", raw_year=2015.0)))
    row = enrich.enrich(survivors, cache(spark, make="Toyota", model=" ", trim="", series="S", year=2013)).first()
    assert (row.make, row.model, row.trim, row.model_year, row.decode_source, row.agrees) == ("Toyota", "Corolla", "S", 2013, "decoded", None)
    row = enrich.enrich(survivors, cache(spark, make="TOYOTA", model="Prius", year=2013)).first()
    assert (row.model, row.agrees) == ("Prius", False)
    row = enrich.enrich(survivors, cache(spark, valid=False, make="X", year=1999)).first()
    assert (row.make, row.model_year, row.decode_source, row.agrees) == ("Toyota", 2015, "undecoded", None)
    row = enrich.enrich(survivors, cache(spark, make="Toyota", model="corolla")).first()
    assert row.agrees is True


def test_no_year_conflict_without_a_decoded_year(spark):
    df = frame(spark, record(1), record(2, raw_year=2014.0))
    survivors = survivorship.survivors(df)
    none = enrich.enrich_listings(df, enrich.enrich(survivors, cache(spark, valid=False)))
    some = enrich.enrich_listings(df, enrich.enrich(survivors, cache(spark, year=2013)))
    assert [r.year_conflict for r in none.orderBy("ordinal").collect()] == [False, False]
    assert [r.year_conflict for r in some.orderBy("ordinal").collect()] == [False, True]


def test_missing_prefixes_are_decoded_once(spark):
    df = frame(spark, record(5, vin=V1[:11] + "999999"), record(2), record(3, vin="2" + V1[1:]))
    vins = survivorship.survivors(df).select("vin", "first_ordinal")
    got = enrich.missing_prefixes(vins, cache(spark).limit(0)).orderBy("prefix").collect()
    assert [(r.prefix, r.vin) for r in got] == [(V1[:11], V1), ("2" + V1[1:11], "2" + V1[1:])]
    assert enrich.missing_prefixes(vins, cache(spark)).count() == 1


def batch(spark, df, **decoded):
    vehicles = enrich.enrich(survivorship.survivors(df), cache(spark, **decoded))
    return upsert.staged_vehicles(vehicles), upsert.staged_listings(enrich.enrich_listings(df, vehicles))


def test_upserts_and_price_history(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    empty = {t: spark.createDataFrame([], SILVER[t][0]) for t in SILVER}
    first = frame(spark, record(1, price_cents=100, status="active", province="ON", make="Honda"), record(2, price_cents=200, status="removed", stock_number=None))
    vehicles, listings = batch(spark, first, year=2013)
    v = upsert.upsert_vehicles(empty["vehicles"], vehicles, at("2026-01-01"))
    li = upsert.upsert_listings(empty["listings"], listings, at("2026-01-01"))
    h = upsert.price_changes(listings, li, empty["price_history"], at("2026-01-01"))
    rows = {r.source_listing_id: r for r in li.collect()}
    assert set(rows) == {"STK1", f"dealer-feed-a-{V1}"} and all(r.delisted_at is None for r in rows.values()) and h.count() == 2
    again = upsert.upsert_listings(li, listings, at("2026-01-02"))
    assert again.count() == 2 and upsert.price_changes(listings, again, h, at("2026-01-02")).count() == 0

    second = frame(spark, record(1, price_cents=None, status="removed"), record(3, price_cents=5, stock_number="STK3"))
    vehicles2, listings2 = batch(spark, second, valid=False)
    v2 = upsert.upsert_vehicles(v, vehicles2, at("2026-01-03")).first()
    assert (v2.decode_source, v2.make, str(v2.first_seen_at)[:10], str(v2.last_seen_at)[:10]) == ("decoded", "Honda", "2026-01-01", "2026-01-03")
    li2 = upsert.upsert_listings(li, listings2, at("2026-01-03"))
    r = li2.where("source_listing_id = 'STK1'").first()
    assert (r.price_cents, r.province, r.status, str(r.delisted_at)[:10]) == (None, "ON", "removed", "2026-01-03")
    assert upsert.price_changes(listings2, li2, h, at("2026-01-03")).count() == 1


def test_blank_stock_numbers_are_one_listing_and_the_last_vin_wins(spark):
    df = frame(spark, record(1, stock_number="", price_cents=1), record(2, stock_number="", vin="2" + V1[1:], price_cents=2), record(3, stock_number="", price_cents=3))
    _, listings = batch(spark, df)
    row = listings.collect()
    assert [(r.source_listing_id, r.price_cents) for r in row] == [("", 2)]


def test_outliers_need_five_prices_that_differ(spark):
    four = [record(i, make="A", model="B", price_cents=i) for i in range(4)]
    same = [record(i, make="C", model="D", price_cents=7) for i in range(9)]
    many = [record(i, make="E", model="F", price_cents=100 + i % 3) for i in range(30)] + [record(99, make="E", model="F", price_cents=9999)]
    assert tuple(quality.price_outliers(frame(spark, *four, *same, *many)).first()) == (1, 31)


def test_duplicate_and_conflict_counts(spark):
    df = frame(spark, record(1), record(2), record(3, vin="x"), record(4, vin="x", source="marketplace-b", raw_year=2014.0), record(5, vin="y"))
    row = quality.duplicate_conflict(df).first()
    assert (row.unique_vins, row.within_source_duplicate, row.cross_source_duplicate, row.year_conflict) == (3, 1, 1, 1)


def test_market_stats_keep_null_groups_and_interpolate(spark):
    li = spark.createDataFrame([("A", None, 2013, None, 101, 10, "active"), ("A", None, 2013, None, 200, 15, "active"), ("A", None, 2013, None, None, 1, "active"), ("A", None, 2013, None, 1, 1, "removed")], "make string, model string, model_year int, province string, price_cents long, odometer_km int, status string")
    row = gold.market_stats(li).first()
    assert (row.listing_count, str(row.avg_price_cad), str(row.median_price_cad), row.avg_odometer_km) == (2, "1.51", "1.51", 13)


def test_medians_are_brute_force(spark):
    draw = random.Random(5)
    sizes = {"a": 4000, "b": 7, None: 100, "one": 1, "even": 2}
    rows = [(k, "x" if k else None, int(draw.choice((1, -1)) * 10 ** draw.uniform(0, 12)) if draw.random() < 0.7 else 5000, draw.choice((None, 3, 4))) for k, n in sizes.items() for _ in range(n)]
    rows += [("a", "x", None, 9), ("none", "x", None, 1), ("bits", None, 2047, None), ("bits", None, 2048, None), ("zero", None, 0, 1), ("zero", None, -1, 1)]
    got = medians.with_medians(spark.createDataFrame(rows, "k string, g string, v long, a int"), ["k", "g"], "v", "a").collect()
    want = {}
    for k, g, v, a in rows:
        if v is not None:
            want.setdefault((k, g), []).append((v, a))
    assert {(r.k, r.g) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        values, also = [v for v, _ in want[r.k, r.g]], [a for _, a in want[r.k, r.g] if a is not None]
        assert (r.low + r.high) / 2 == median(values), r
        assert (r.n, r.total, r.n_also, r.total_also) == (len(values), sum(values), len(also), sum(also) if also else None)


def test_bins_are_in_order(spark):
    numbers = [*range(-5000, 5000), *(s * (1 << e) + d for e in range(12, 62) for s in (1, -1) for d in (-1, 0, 1))]
    df = spark.createDataFrame([(x,) for x in sorted(set(numbers))], "v long").select("v", medians.bin_of("v").alias("bin"))
    bins = [r.bin for r in df.orderBy("v").collect()]
    assert bins == sorted(bins)


def test_medians_of_nothing(spark):
    assert medians.with_medians(spark.createDataFrame([], "k string, v long, a long"), ["k"], "v", "a").collect() == []


def test_price_drops_guard_against_zero(spark):
    h = spark.createDataFrame([("v", "l", 0, "2026-01-01"), ("v", "l", -5, "2026-01-02"), ("v", "l", -5, "2026-01-03"), ("v", "l", -10, "2026-01-04")], "vin string, listing_id string, price_cents long, observed_at string").withColumn("observed_at", F.to_timestamp("observed_at"))
    got = [(r.price_drop_cents, None if r.price_drop_pct is None else float(r.price_drop_pct)) for r in gold.price_drops(h).orderBy("current_observed_at").collect()]
    assert got == [(5, None), (5, -100.0)]


def history(spark, *rows):
    return spark.createDataFrame(list(rows), "vin string, listing_id string, price_cents long, observed_at string").withColumn("observed_at", F.to_timestamp("observed_at"))


def test_price_drops_are_rounded_once(spark):
    """92.55499975... and 33.3499999500... percent come to a half if they are cut to six places first."""
    pairs = [(20591, 1533), (100003, 66652), (800, 799), (-800, -801), (90_000_000_000_000_000, 1)]
    h = history(spark, *(("v", str(i), p, f"2026-01-0{d}") for i, pair in enumerate(pairs) for d, p in enumerate(pair, 1)))
    got = [str(r.price_drop_pct) for r in gold.price_drops(h).orderBy("listing_id").collect()]
    assert got == ["92.55", "33.35", "0.13", "-0.13", "100.00"]
    top = {r.prev_price: str(r.pct_drop) for r in gold.largest_drops(h).collect()}
    assert top == {20591: "92.6", 100003: "33.3", 800: "0.1", -800: "-0.1", 90_000_000_000_000_000: "100.0"}


def test_price_drops_take_unknown_times_last(spark):
    h = history(spark, ("v", "l", 7, None), ("v", "l", 10, "2026-01-01"), ("v", "l", 9, "2026-01-02"))
    assert [(r.previous_price_cents, r.current_price_cents) for r in gold.price_drops(h).orderBy("price_drop_cents").collect()] == [(10, 9), (9, 7)]


def test_rounded_ratio_of_many(spark):
    """A ratio just below a half is not taken for one, however many it is shared by."""
    df = spark.createDataFrame([(1_500_000, 3_000_001), (-1_500_000, 3_000_001), (1_500_001, 3_000_001), (5, 2), (-5, 2), (5, 0), (None, 3)], "t long, n long")
    assert [r.x for r in df.select(rounded_ratio(F.col("t"), F.col("n")).alias("x")).collect()] == [0, 0, 1, 3, -3, None, None]


def test_formats():
    assert [quality.formatted(x) for x in (3, 0.5, 2.25, 0)] == ["3", "50.00%", "2.25", "0"]
