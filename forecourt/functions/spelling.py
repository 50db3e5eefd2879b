"""Spellings of prices and trims as the feeds write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsnum import js_round

#: Fixed values.
MILES_PER_KM = 0.621371
KM_PER_MILE = 1.60934


def dollars(price: Column) -> Column:
    """`$34,999`"""
    return F.concat(F.lit("$"), F.format_number(js_round(price), 0))


def dollars_quebec(price: Column) -> Column:
    """`35 995 $`"""
    return F.concat(F.regexp_replace(F.format_number(js_round(price), 0), ",", " "), F.lit(" $"))


def trim_variants(trim: Column) -> Column:
    """The six spellings of a trim, as an array."""
    return F.array(
        F.regexp_replace(trim, "-", ""), F.regexp_replace(trim, "-", " "), F.upper(trim), F.lower(trim), F.concat(trim, F.lit(" Navi")), F.concat(trim, F.lit(" AWD"))
    )


def km_to_miles(km: Column) -> Column:
    return js_round(km * MILES_PER_KM)


def trim_form(trim: Column) -> Column:
    """What spellings of one trim have in common: upper case, one NAVI and then one AWD at the end dropped, letters and digits only."""
    t = F.regexp_replace(F.regexp_replace(F.upper(trim), " NAVI$", ""), " AWD$", "")
    return F.regexp_replace(t, "[^A-Z0-9]", "")
