"""Exact medians of groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(value: str) -> Column:
    """The number's eleven leading bits and how many follow: whole numbers in order give bins in order, none wider than a 1024th of its values."""
    more = f"greatest(length(bin(abs({value}))) - 11, 0)"
    return F.expr(f"sign({value}) * ({more} * 2048 + shiftright(abs({value}), {more}))").cast("int")


def with_medians(rows: DataFrame, keys: list[str], value: str, also: str) -> DataFrame:
    """keys, n, total, low and high (the two middle values, equal if n is odd), n_also and total_also of each group.

    `value` and `also` are whole numbers; rows without a value are left out, null keys are a
    group. Equal values are added up before any shuffle by group alone; a group's bins
    (some thousands) are then ranked, and only the values of the bins in the middle after them. No
    task holds more of a group than its bins, or than the distinct values of a bin.
    """
    own = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("value"), F.col(also).cast("long").alias("also"))
    each = own.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.count("also").alias("n_also"), F.sum("also").alias("total_also")).withColumn("bin", bin_of("value"))
    sums = ["n", "total", "n_also", "total_also"]
    bins = each.withColumn("total", F.col("value") * F.col("n")).groupBy(*keys, "bin").agg(*(F.sum(c).alias(c) for c in sums))
    group = Window.partitionBy(*keys)
    before = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    bins = bins.select(*keys, "bin", F.col("n").alias("held"), before.alias("before"), *(F.sum(c).over(group).alias(c) for c in sums))
    first, second = F.expr("(n - 1) div 2"), F.expr("n div 2")
    middle = bins.where((F.col("before") <= second) & (F.col("before") + F.col("held") > first))

    # Always true, but not known to be: both sides then read the same columns, and one exchange of `each` serves them.
    whole = each.where((F.col("n_also") <= F.col("n")) & (F.col("total_also").isNull() | (F.col("n_also") > 0)))
    found = whole.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("bin").alias("of_bin"), "value", F.col("n").alias("times"))
    same = F.col("bin") == F.col("of_bin")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    within = Window.partitionBy(*keys, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = found.join(middle, same).withColumn("upto", F.col("before") + F.sum("times").over(within))
    at = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("times") <= place), F.col("value")))
    return met.groupBy(*keys).agg(at(first).alias("low"), at(second).alias("high"), *(F.max(c).alias(c) for c in sums))
