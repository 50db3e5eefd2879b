"""Synthetic listings of two sources, with the faults that the pipeline has to handle.

Every draw is a hash of seed, row and slot, so that rows can be made anywhere, in any order,
and always alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vin as V
from ..functions.jsnum import js_round
from ..functions.spelling import dollars, dollars_quebec, km_to_miles, trim_variants
from ..schemas import FRENCH, SOURCE_A, SOURCE_B

#: WMI, VDS, plant, make, model, body, fuel, trims, first and last year, base price.
SEEDS = [
    ("1VW", "BH7A3", "C", "Volkswagen", "Passat", "sedan", "gasoline", ["Comfortline", "Highline", "Trendline"], 2012, 2019, 24000),
    ("1HG", "CM826", "A", "Honda", "Accord", "sedan", "gasoline", ["LX", "EX", "EX-L", "Touring"], 2013, 2024, 31000),
    ("2HG", "FC2F5", "H", "Honda", "Civic", "sedan", "gasoline", ["LX", "Sport", "EX", "Touring"], 2016, 2024, 25500),
    ("5J6", "RM4H7", "L", "Honda", "CR-V", "suv", "gasoline", ["LX", "EX", "EX-L", "Touring"], 2015, 2024, 33500),
    ("1FT", "FW1ET", "D", "Ford", "F-150", "pickup", "gasoline", ["XL", "XLT", "Lariat", "Platinum"], 2013, 2024, 48000),
    ("1FM", "CU9GD", "U", "Ford", "Escape", "suv", "gasoline", ["S", "SE", "SEL", "Titanium"], 2014, 2024, 30000),
    ("1FA", "6P8TH", "J", "Ford", "Mustang", "coupe", "gasoline", ["EcoBoost", "GT", "GT Premium"], 2015, 2024, 42000),
    ("1G1", "ZE5ST", "8", "Chevrolet", "Malibu", "sedan", "gasoline", ["LS", "LT", "Premier"], 2013, 2023, 27000),
    ("1GN", "SKBKC", "5", "Chevrolet", "Tahoe", "suv", "gasoline", ["LS", "LT", "Premier", "High Country"], 2015, 2024, 62000),
    ("3GN", "AXUEV", "7", "Chevrolet", "Equinox", "suv", "gasoline", ["LS", "LT", "Premier"], 2016, 2024, 29500),
    ("1C4", "RJFAG", "0", "Jeep", "Grand Cherokee", "suv", "gasoline", ["Laredo", "Limited", "Overland", "Trailhawk"], 2014, 2024, 46000),
    ("1C6", "RR7LT", "0", "Ram", "1500", "pickup", "gasoline", ["Tradesman", "Big Horn", "Laramie", "Rebel"], 2015, 2024, 51000),
    ("JTD", "KN3DU", "8", "Toyota", "Corolla", "sedan", "gasoline", ["L", "LE", "SE", "XSE"], 2014, 2024, 23500),
    ("4T1", "BF1FK", "5", "Toyota", "Camry", "sedan", "gasoline", ["LE", "SE", "XLE", "XSE"], 2013, 2024, 30000),
    ("2T1", "BURHE", "0", "Toyota", "Corolla", "sedan", "gasoline", ["L", "LE", "SE"], 2014, 2019, 21500),
    ("JHL", "RE387", "9", "Honda", "CR-V", "suv", "gasoline", ["LX", "EX"], 2012, 2016, 26000),
    ("JN1", "AZ4EH", "M", "Nissan", "Altima", "sedan", "gasoline", ["S", "SV", "SL", "Platinum"], 2013, 2023, 27500),
    ("1N4", "AL3AP", "J", "Nissan", "Altima", "sedan", "gasoline", ["S", "SV", "SR"], 2013, 2018, 24000),
    ("5N1", "AT2MV", "8", "Nissan", "Rogue", "suv", "gasoline", ["S", "SV", "SL", "Platinum"], 2014, 2024, 31500),
    ("5NP", "E24AF", "9", "Hyundai", "Sonata", "sedan", "gasoline", ["GL", "GLS", "Sport", "Limited"], 2015, 2023, 28000),
    ("KMH", "DH4AE", "0", "Hyundai", "Elantra", "sedan", "gasoline", ["Essential", "Preferred", "Ultimate"], 2014, 2024, 22500),
    ("KND", "PB3AC", "5", "Kia", "Sorento", "suv", "gasoline", ["LX", "EX", "SX"], 2015, 2024, 37000),
    ("3KP", "FK4A7", "5", "Kia", "Forte", "sedan", "gasoline", ["LX", "EX", "GT"], 2016, 2023, 21000),
    ("WBA", "3B5C5", "0", "BMW", "3 Series", "sedan", "gasoline", ["330i", "330i xDrive", "M340i"], 2013, 2024, 48000),
    ("WDD", "GF4HB", "6", "Mercedes-Benz", "C-Class", "sedan", "gasoline", ["C300", "C300 4MATIC", "AMG C43"], 2014, 2024, 51000),
    ("WVW", "ZZZ1K", "Z", "Volkswagen", "Golf", "hatchback", "gasoline", ["Trendline", "Comfortline", "GTI", "R"], 2015, 2023, 26000),
    ("WAU", "AFAFL", "3", "Audi", "A4", "sedan", "gasoline", ["Komfort", "Progressiv", "Technik"], 2013, 2024, 47000),
    ("YV1", "RS58H", "6", "Volvo", "XC60", "suv", "gasoline", ["Momentum", "Inscription", "R-Design"], 2014, 2024, 45000),
    ("2C3", "CDXHG", "H", "Dodge", "Charger", "sedan", "gasoline", ["SXT", "GT", "R/T", "Scat Pack"], 2015, 2023, 39000),
    ("5YJ", "3E26A", "7", "Tesla", "Model 3", "sedan", "electric", ["Standard Range", "Long Range", "Performance"], 2018, 2024, 52000),
]
#: Province, city, latitude, longitude.
CITIES = [
    ("ON", "Toronto", 43.6532, -79.3832), ("ON", "Ottawa", 45.4215, -75.6972), ("ON", "Hamilton", 43.2557, -79.8711),
    ("QC", "Montreal", 45.5019, -73.5674), ("QC", "Quebec City", 46.8139, -71.208),
    ("BC", "Vancouver", 49.2827, -123.1207), ("BC", "Kelowna", 49.888, -119.496),
    ("AB", "Calgary", 51.0447, -114.0719), ("AB", "Edmonton", 53.5461, -113.4938),
    ("MB", "Winnipeg", 49.8951, -97.1384), ("SK", "Regina", 50.4452, -104.6189), ("NS", "Halifax", 44.6488, -63.5752), ("NB", "Moncton", 46.0878, -64.7782),
]
#: Colours outside and inside.
EXTERIOR = ["Black", "White", "Grey", "Silver", "Blue", "Red"]
INTERIOR = ["Black", "Grey", "Beige"]
#: Fault rates, and what chaos multiplies them by and caps them at.
RATES = {"vin_digit": 0.07, "vin_length": 0.01, "no_price": 0.03, "outlier": 0.002, "trim_variant": 0.35, "no_field": 0.04, "miles": 0.12}
CHAOS = {"vin_digit": (3, 0.5), "vin_length": (3, 0.3), "no_price": (3, 0.5), "outlier": (5, 0.1), "trim_variant": (1.5, 0.9), "no_field": (3, 0.5), "miles": (2, 0.5)}


def rates(chaos: bool = False) -> dict[str, float]:
    return {k: min(CHAOS[k][1], v * CHAOS[k][0]) for k, v in RATES.items()} if chaos else dict(RATES)


def trims() -> list[tuple[str, str, list[str]]]:
    return [(s[3], s[4], s[7]) for s in SEEDS]


def decoder_rows() -> list[tuple]:
    return [(*s[:7], s[8], s[9]) for s in SEEDS]


class Draws:
    """Independent uniform numbers by slot for the row whose number is in a column."""

    def __init__(self, seed: int, row: Column, stream: str):
        self.seed, self.row, self.stream, self.slot = seed, row, stream, 0

    def uniform(self) -> Column:
        self.slot += 1
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(self.stream), self.row, F.lit(self.slot)), 11) / F.lit(float(1 << 53))

    def whole(self, low, high) -> Column:
        return F.floor(self.uniform() * (F.lit(1) + high - low)).cast("int") + low

    def real(self, low: float, high: float) -> Column:
        return self.uniform() * (high - low) + low

    def happens(self, rate: float) -> Column:
        return self.uniform() < rate

    def choice(self, values: Column) -> Column:
        return F.get(values, F.floor(self.uniform() * F.size(values)).cast("int"))


def canonical(rows: DataFrame, seed: int, as_of: str, reference_year: int = 2026) -> DataFrame:
    """A consistent listing for every `row` number."""
    d = Draws(seed, F.col("row"), "listing")
    seeds = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("wmi", "vds", "plant", "make", "model", "body", "fuel"), s[:7], strict=True)), F.array(*map(F.lit, s[7])).alias("trims"), F.lit(s[8]).alias("low"), F.lit(s[9]).alias("high"), F.lit(s[10]).alias("base")) for s in SEEDS))
    provinces = list(dict.fromkeys(c[0] for c in CITIES))
    cities = F.array(*(F.array(*(F.struct(F.lit(p).alias("province"), F.lit(c).alias("city"), F.lit(a).alias("lat"), F.lit(o).alias("lon")) for p, c, a, o in CITIES if p == q)) for q in provinces))
    first = rows.withColumn("s", d.choice(seeds)).withColumn("c", d.choice(cities))
    first = first.withColumn("year", d.whole(F.col("s.low"), F.col("s.high"))).withColumn("c", d.choice(F.col("c"))).withColumn("age", F.greatest(F.lit(0), F.lit(reference_year) - F.col("year")))
    price = js_round((F.col("s.base") * F.greatest(F.lit(0.35), 1 - F.col("age") * 0.09) + d.real(-1500, 1500)) / 100) * 100
    day = F.timestamp_add("DAY", -d.whole(F.lit(0), F.lit(60)), F.lit(as_of).cast("timestamp"))
    return first.select(
        "row", V.build(F.col("s.wmi"), F.col("s.vds"), F.col("year"), F.col("s.plant"), d.whole(F.lit(100000), F.lit(999999)).cast("string")).alias("vin"),
        F.concat(F.lit("seller-"), d.whole(F.lit(1000), F.lit(9999))).alias("sellerId"), F.concat(F.lit("STK"), "row", d.whole(F.lit(100), F.lit(999))).alias("stockNumber"),
        price.alias("price"), js_round(d.real(8000, 24000) * F.col("age") + d.real(0, 5000)).alias("odometer"), F.col("s.make").alias("make"), F.col("s.model").alias("model"), "year",
        d.choice(F.col("s.trims")).alias("trim"), F.col("s.body").alias("bodyStyle"), F.col("s.fuel").alias("fuelType"),
        d.choice(F.array(*map(F.lit, EXTERIOR))).alias("exteriorColor"), d.choice(F.array(*map(F.lit, INTERIOR))).alias("interiorColor"), F.lit("used").alias("condition"),
        F.col("c.province").alias("province"), F.col("c.city").alias("city"), F.round(F.col("c.lat") + d.real(-0.05, 0.05), 6).alias("latitude"), F.round(F.col("c.lon") + d.real(-0.05, 0.05), 6).alias("longitude"),
        F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("listedAt"), F.when(d.happens(0.9), "active").otherwise("removed").alias("status"),
    )


def broken_vin(vin: Column, d: Draws, rate: dict[str, float]) -> Column:
    others = F.filter(F.array(*(F.lit(c) for c in "0123456789X")), lambda c: c != F.substring(vin, 9, 1))
    digit = F.concat(F.substring(vin, 1, 8), d.choice(others), F.substring(vin, 10, 8))
    length = F.when(d.happens(0.5), F.substring(vin, 1, 16)).otherwise(F.concat(vin, d.whole(F.lit(0), F.lit(9)).cast("string")))
    return F.when(d.happens(rate["vin_length"]), length).when(d.happens(rate["vin_digit"]), digit).otherwise(vin)


def _faulty(rows: DataFrame, seed: int, rate: dict[str, float], source: str) -> tuple[Draws, DataFrame, Column]:
    d = Draws(seed, F.col("row"), source)
    outlier = F.when(d.happens(0.5), d.whole(F.lit(999_000), F.lit(9_999_999))).otherwise(d.whole(F.lit(1), F.lit(50))).cast("long")
    trim = F.when(d.happens(rate["trim_variant"]), d.choice(trim_variants(F.col("trim")))).otherwise(F.col("trim"))
    return d, rows.withColumns({"vin": broken_vin(F.col("vin"), d, rate), "trim": trim}), F.when(d.happens(rate["outlier"]), outlier)


def source_a(rows: DataFrame, seed: int, rate: dict[str, float]) -> DataFrame:
    """NDJSON records: typed, null price where it is missing, some fields left out."""
    d, out, outlier = _faulty(rows, seed, rate, "a")
    out = out.withColumn("price", F.when(outlier.isNotNull(), outlier).when(~d.happens(rate["no_price"]), F.col("price")))
    out = out.withColumns({c: F.when(~d.happens(rate["no_field"]), F.col(c)) for c in ("trim", "exteriorColor", "interiorColor", "bodyStyle")})
    fields = [c for c in FRENCH.values() if c not in ("price", "currency")]
    record = F.to_json(F.struct(*fields))
    price = F.concat(F.lit('"price":'), F.coalesce(F.col("price").cast("string"), F.lit("null")), F.lit(',"currency":"CAD",'))
    return out.select("row", F.concat(F.lit("{"), price, F.substring(record, 2, 1 << 20)).alias("value"))


def source_b(rows: DataFrame, seed: int, rate: dict[str, float]) -> DataFrame:
    """CSV records: French names, priced as text, some odometers secretly in miles, some fields empty."""
    d, out, outlier = _faulty(rows, seed, rate, "b")
    text = F.when(d.happens(0.5), dollars_quebec(F.col("price"))).otherwise(dollars(F.col("price")))
    price = F.when(outlier.isNotNull(), dollars(outlier)).when(~d.happens(rate["no_price"]), text).otherwise(F.lit(""))
    out = out.withColumns({"price": price, "currency": F.lit("CAD"), "odometer": F.when(d.happens(rate["miles"]), km_to_miles(F.col("odometer"))).otherwise(F.col("odometer"))})
    out = out.withColumns({c: F.when(d.happens(rate["no_field"]), F.lit("")).otherwise(F.col(c)) for c in ("trim", "exteriorColor", "interiorColor", "bodyStyle")})
    return out.select("row", *(F.col(c).cast("string").alias(f) for f, c in FRENCH.items()))


def listings(spark: SparkSession, seed: int = 42, count_a: int = 650_000, count_b: int = 350_000, overlap: float = 0.02, as_of: str = "2026-01-01", reference_year: int = 2026) -> tuple[DataFrame, DataFrame]:
    """Canonical listings of A and B. A share `overlap` of B reuses the VIN of an A row, with another year, price and stock number."""
    a = canonical(spark.range(count_a).withColumnRenamed("id", "row"), seed, as_of, reference_year)
    numbers = spark.range(count_a, count_a + count_b).withColumnRenamed("id", "row")
    d = Draws(seed, F.col("row"), "overlap")
    marked = numbers.withColumn("base", F.when(d.happens(overlap if count_a else 0.0), F.floor(d.uniform() * count_a)))
    fresh = canonical(marked.where("base is null").select("row"), seed, as_of, reference_year)
    # The rows that are reused are made again from their numbers.
    base = marked.where("base is not null")
    made = canonical(base.select(F.col("base").cast("long").alias("row")).distinct(), seed, as_of, reference_year)
    over = base.select(F.col("base").cast("long").alias("base"), F.col("row").alias("own")).join(made, F.col("base") == made["row"])
    d = Draws(seed, F.col("own"), "conflict")
    over = over.withColumns({
        "stockNumber": F.concat(F.lit("STK"), "own", d.whole(F.lit(100), F.lit(999))), "year": F.col("year") + F.when(d.happens(0.5), 1).otherwise(-1), "price": js_round(F.col("price") * d.real(0.85, 1.15) / 100) * 100, "row": F.col("own"),
    }).drop("base", "own")
    return a, fresh.unionByName(over)


def write(spark: SparkSession, out_dir: str, chaos: bool = False, rows_per_file: int = 50_000, **options) -> None:
    """Both sources' files below out_dir: plain NDJSON and CSV, at most rows_per_file rows each."""
    a, b = listings(spark, **options)
    seed, rate = options.get("seed", 42), rates(chaos)
    write_feed(source_a(a, seed, rate), out_dir, SOURCE_A, rows_per_file)
    write_feed(source_b(b, seed, rate), out_dir, SOURCE_B, rows_per_file, options.get("count_a", 650_000))


def write_feed(df: DataFrame, out_dir: str, source: str, rows_per_file: int = 50_000, first: int = 0) -> None:
    """Files of a source, one for each rows_per_file numbers from `first` on: lines of `value` for A, a header and the columns for B, by `row`."""
    files = df.withColumn("_batch", F.floor((F.col("row") - first) / rows_per_file).cast("int"))
    files.groupBy("_batch").applyInArrow(_file(out_dir, source, "ndjson" if source == SOURCE_A else "csv"), "path string").collect()


def _file(out_dir: str, name: str, suffix: str):
    def run(key, table):
        import csv
        import io

        import pyarrow as pa

        from .files import write_bytes

        rows = table.sort_by("row").drop_columns(["row", "_batch"])
        path = f"{out_dir}/{name}/batch-{key[0].as_py():04d}.{suffix}"
        if suffix == "ndjson":
            data = "".join(f"{v}\n" for v in rows.column("value").to_pylist())
        else:
            text = io.StringIO()
            out = csv.writer(text, lineterminator="\n")
            out.writerow(rows.column_names)
            out.writerows(zip(*(c.to_pylist() for c in rows.columns), strict=True))
            data = text.getvalue()
        write_bytes(path, data.encode())
        return pa.table({"path": [path]})

    return run
