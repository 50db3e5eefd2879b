
import pytest
from pyspark.sql import functions as F

from forecourt.functions import jsnum, pg, spelling, vin
from forecourt.operators import normalize, validate


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(expr).collect()]


def test_js_numbers(spark):
    rows = ["", "  ", "12", " 12.5 ", "12d", "12f", "abc", "Infinity", "NaN", "0x10", "0b11", "0o17", "1e3", "1e999", "-7", ".5", "5.", None]
    assert values(spark, rows, jsnum.js_number(F.col("x"))) == [0, 0, 12, 12.5, None, None, None, None, None, 16, 3, 15, 1000, None, -7, 0.5, 5, None]


def test_js_rounding_goes_up_at_halves(spark):
    assert values(spark, [2.5, -2.5, 0.49, -0.5], jsnum.js_round(F.col("x")), "x double") == [3, -2, 0, 0]


def test_check_digit(spark):
    v = ["1VWBH7A30DC104945", "1VWBH7A31DC104945", "1M8GDM9AXKP042788", "1m8gdm9axkp042788", "1VWBH7AI0DC104945", "1VWBH7A30DC10494", "1VWBH7A30DC1049455", "", None]
    assert values(spark, v, vin.check_digit(F.col("x"))) == ["0", "0", "X", "X", None, None, None, None, None]
    assert values(spark, v, vin.is_valid(F.col("x"))) == [True, False, True, True, False, False, False, False, False]


def test_year_codes_repeat(spark):
    got = values(spark, [2013, 1990, 2020, 1979, 2039], vin.year_code(F.col("x")), "x int")
    assert got == ["D", "L", "L", None, "9"]


def test_built_vins_are_valid(spark):
    df = spark.range(50).select(vin.build(F.lit("1VW"), F.lit("BH7A3"), (F.lit(2013) + F.col("id") % 15).cast("int"), F.lit("D"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("v"))
    assert df.where((F.length("v") == 17) & vin.is_valid(F.col("v"))).count() == 50
    short = df.limit(1).select(vin.build(F.lit("1V"), F.lit("BH7A3"), F.lit(2013), F.lit("D"), F.lit("000001"))).first()[0]
    assert short is None


@pytest.mark.parametrize(
    ("text", "kind", "cents", "malformed"),
    [
        ("24999", "number", 2499900, False), ("24999", "string", 2499900, True), ("$34,999", "string", 3499900, True), ("35 995 $", "string", 3599500, True), ("35 995 $", "string", 3599500, True),
        ("", "string", None, False), ("  ", "string", None, False), (None, "null", None, False), ("call for price", "string", None, True), ("$", "string", 0, True), ("12d", "string", None, True), ("9999999", "number", 999999900, False), ("-5", "string", -500, True),
    ],
)
def test_prices(spark, text, kind, cents, malformed):
    got = spark.createDataFrame([(text, kind)], "t string, k string").select(normalize.parse_price(F.col("t"), F.col("k")).alias("p")).first().p
    assert (got.cents, got.malformed) == (cents, malformed)


@pytest.mark.parametrize(
    ("text", "year", "b", "km", "miles"),
    [("90000", 2018.0, False, 90000, False), ("24855", 2018.0, True, 40000, True), ("124274", 2018.0, True, 124274, False), ("120000", 2018.0, True, 120000, False), (None, 2018.0, True, None, False), ("n/a", 2018.0, True, None, False), ("-5", 2018.0, True, None, False), ("0", 2018.0, True, 0, True), ("", 2018.0, True, None, False)],
)
def test_odometers(spark, text, year, b, km, miles):
    got = spark.createDataFrame([(text, year, b)], "t string, y double, b boolean").select(normalize.odometer(F.col("t"), F.col("y"), 2026, F.col("b")).alias("o")).first().o
    assert (got.km, got.from_miles) == (km, miles)


def test_trims(spark):
    from forecourt.sources import generator

    d = normalize.trim_dictionary(spark, generator.trims())
    rows = [("EX-L", "Honda", "Accord"), ("exl", "Honda", "Accord"), ("EX L", "Honda", "Accord"), ("EX AWD NAVI", "Honda", "Accord"), ("EX NAVI AWD", "Honda", "Accord"), ("EX-L", "Honda", "CR-V"), ("Some Trim", "Yugo", "GV"), (None, "Honda", "Accord"), ("", "Honda", "Accord"), ("XSE", "Toyota", "Corolla"), ("EX", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, trim string, make string, model string")
    got = [(r.trim, r.trim_matched) for r in normalize.canonical_trim(df, d).orderBy("i").collect()]
    assert got == [("EX-L", True), ("EX-L", True), ("EX-L", True), ("EX", True), ("EX NAVI AWD", False), ("EX-L", False), ("Some Trim", False), (None, False), (None, False), ("XSE", False), ("EX", False)]
    variants = spark.createDataFrame([("EX-L",)], "t string").select(F.explode(spelling.trim_variants(F.col("t"))).alias("trim"), F.lit("Honda").alias("make"), F.lit("Accord").alias("model"))
    assert normalize.canonical_trim(variants, d).where("trim = 'EX-L' and trim_matched").count() == 6


def test_spellings(spark):
    assert values(spark, [34999.0], spelling.dollars(F.col("x")), "x double") == ["$34,999"]
    assert values(spark, [35995.0], spelling.dollars_quebec(F.col("x")), "x double") == ["35 995 $"]
    assert values(spark, [100000], spelling.km_to_miles(F.col("x")), "x int") == [62137]


def test_reasons(spark):
    rows = [("1VWBH7A30DC104945", "2013"), ("", "2013"), (None, None), ("1VWBH7A31DC104945", "  "), ("bad", "1899"), ("1VWBH7A30DC104945", "2013.5"), (" 1vwbh7a30dc104945 ", "2027"), ("1VWBH7A30DC104945", "2028")]
    df = spark.createDataFrame(rows, "v string, y string")
    got = [tuple(r) for r in df.select(validate.vin_reason(F.col("v")), validate.year_reason(F.col("y"), 2026)).collect()]
    assert got == [(None, None), ("vin_missing", None), ("vin_missing", "year_missing"), ("vin_bad_check_digit", "year_out_of_range"), ("vin_wrong_length", "year_out_of_range"), (None, None), (None, None), (None, "year_out_of_range")]


def test_postgres_rules(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r.x for r in df.orderBy(pg.asc("x")).collect()] == [1, 2, None]
    assert [r.x for r in df.orderBy(pg.desc("x")).collect()] == [None, 2, 1]
    assert [values(spark, [(t, n)], pg.rounded_ratio(F.col("t"), F.col("n")), "t long, n long")[0] for t, n in ((3, 2), (-3, 2), (4, 3), (5, 0), (None, 0))] == [2, -2, 1, None, None]
    assert values(spark, [2.5, 3.5], pg.whole(F.col("x")), "x double") == [2, 4]


def test_french_names(spark):
    df = spark.createDataFrame([("a", "b", "c")], "vin string, prix string, champ_inconnu string")
    assert normalize.rename_french(df).columns == ["vin", "price"]
