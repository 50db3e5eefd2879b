"""PostgreSQL's ordering of nulls and rounding of casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def asc(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).asc_nulls_last()


def desc(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).desc_nulls_first()


def rounded_ratio(total: Column, n: Column) -> Column:
    """(total / n)::bigint of whole numbers: exact, halves away from zero; null if n is 0.

    By `div`: a quotient of wide decimals is itself rounded to six places, and a ratio just below a half would come to one.
    """
    sign = F.signum(total).cast("long")
    double = F.abs(total) * 2 + n
    return F.when(n > 0, sign * F.call_function("div", double.cast("decimal(38,0)"), F.nullif(n * 2, F.lit(0)).cast("decimal(20,0)")))


def whole(col: Column) -> Column:
    """double::bigint: halves to even."""
    return F.rint(col).cast("long")
