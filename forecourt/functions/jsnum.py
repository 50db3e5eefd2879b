"""JavaScript's coercion rules as column expressions.

Feed values are read as text with a kind (`string`, `number`, `boolean`, `null`,
`missing`, `other`); numbers are kept in the text in which they came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that JavaScript trims and matches as white space.
BLANKS = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated (and standing in the plan) once.

    Long chains that use a value many times would otherwise be copied into each other
    until the optimizer chokes on them.
    """
    return F.get(F.transform(F.array(value), body), 0)


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _number(t: Column) -> Column:
    radix = lambda base: F.conv(F.substring(t, 3, 1 << 20), base, 10).cast("double")
    plain = F.when(t == "", F.lit(0.0)).when(t.rlike(DECIMAL), t.try_cast("double"))
    return plain.when(t.rlike("^0[xX][0-9a-fA-F]+$"), radix(16)).when(t.rlike("^0[oO][0-7]+$"), radix(8)).when(t.rlike("^0[bB][01]+$"), radix(2))


def js_number(text: Column) -> Column:
    """The number that a text is coerced to; null where that is not finite. Blank text is 0."""
    return let(let(js_trim(text), _number), lambda x: F.when(F.abs(x) != float("inf"), x))


def js_round(number: Column) -> Column:
    """Nearest whole number, halves upward, as a long."""
    return F.floor(number + 0.5).cast("long")


def clean(text: Column, kind: Column | None = None) -> Column:
    """Trimmed text; null if it is blank or (by kind) not a string."""
    t = F.nullif(js_trim(text), F.lit(""))
    return t if kind is None else F.when(kind == "string", t)


def finite(text: Column) -> Column:
    """The finite number of a text, null for null and empty text."""
    return F.when(text != "", js_number(text))
