"""Vehicle identification numbers as column expressions: check digit, year code, prefix, building."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsnum import let

#: Fixed values of the standard: letters and the digits they stand for, weights by position, year codes from 1980.
LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
DIGITS = "12345678123457923456789"
WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
YEAR_CODES = "ABCDEFGHJKLMNPRSTVWXY123456789"
SHAPE = "^[A-HJ-NPR-Z0-9]{17}$"


def _digit(vin: Column) -> Column:
    """For upper-case text: the digit by the weighted sum, null unless it is 17 permitted characters."""
    plain = F.translate(vin, LETTERS, DIGITS)
    value = lambda p: reduce(lambda a, b: a + b, [F.substring(p, i + 1, 1).cast("int") * w for i, w in enumerate(WEIGHTS) if w])
    return F.when(vin.rlike(SHAPE), F.substring(F.lit("0123456789X"), let(plain, value) % 11 + 1, F.lit(1)))


def check_digit(vin: Column) -> Column:
    """The digit that belongs at position 9; null unless the text is 17 permitted characters."""
    return let(F.upper(vin), _digit)


def is_valid(vin: Column) -> Column:
    return let(F.upper(vin), lambda v: F.coalesce(_digit(v) == F.substring(v, 9, 1), F.lit(False)))


def year_code(year: Column) -> Column:
    """The code of a model year, repeating every 30 years; null before 1980."""
    return F.when(year >= 1980, F.substring(F.lit(YEAR_CODES), (year - 1980) % 30 + 1, F.lit(1)))


def prefix(vin: Column) -> Column:
    """The first 11 characters: all that a decode depends on."""
    return F.substring(vin, 1, 11)


def build(wmi: Column, vds: Column, year: Column, plant: Column, serial: Column) -> Column:
    """A VIN with its check digit from parts of 3, 5, 1 and 6 characters; null if a part has another length."""
    body = lambda digit: F.concat(wmi, vds, digit, year_code(year), plant, serial)
    fits = (F.length(wmi) == 3) & (F.length(vds) == 5) & (F.length(plant) == 1) & (F.length(serial) == 6)
    return F.when(fits, body(check_digit(body(F.lit("0")))))
