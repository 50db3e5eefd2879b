"""Checks of raw records, reason codes, and the quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsnum import js_number, js_trim, let
from ..functions.vin import is_valid

FIRST_YEAR = 1980


def vin_reason(text: Column) -> Column:
    """Why a VIN text (null: not a string) is rejected; null if it is not."""
    reason = lambda vin: F.when(vin == "", "vin_missing").when(F.length(vin) != 17, "vin_wrong_length").when(~is_valid(vin), "vin_bad_check_digit")
    return let(F.coalesce(js_trim(text), F.lit("")), reason)


def year_reason(text: Column, reference_year: int) -> Column:
    fits = let(js_number(text), lambda year: F.coalesce(year.between(FIRST_YEAR, reference_year + 1), F.lit(False)))
    return F.when(text.isNull() | (text == ""), "year_missing").when(~fits, "year_out_of_range")


def checked(raw: DataFrame, reference_year: int) -> DataFrame:
    """raw with reason_codes, and with vin and raw_year as later stages use them.

    raw has source, batch_id, ordinal, raw_record and a struct `f` of every field's
    text and kind (see sources.bronze).
    """
    vin_text = F.when(F.col("f.vin.kind") == "string", F.col("f.vin.text"))
    reasons = F.array_compact(F.array(vin_reason(vin_text), year_reason(F.col("f.year.text"), reference_year)))
    return raw.withColumns({"reason_codes": reasons, "vin": F.upper(js_trim(vin_text)), "raw_year": js_number(F.col("f.year.text"))})


def valid(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("reason_codes") == 0).drop("reason_codes")


def rejected(rows: DataFrame, quarantined_at: Column) -> DataFrame:
    """Quarantine rows: one for each source, batch and content hash."""
    out = rows.where(F.size("reason_codes") > 0).select(
        "source", "batch_id", "raw_record", "reason_codes", content_hash(F.col("raw_record"), F.col("reason_codes")).alias("content_hash"),
        quarantined_at.cast("timestamp").alias("quarantined_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    return out.dropDuplicates(["source", "batch_id", "content_hash"])


def content_hash(raw_record: Column, reason_codes: Column) -> Column:
    return F.md5(F.concat(raw_record, F.lit("|"), F.array_join(reason_codes, ",")))


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose key is not in existing yet (insert, ignoring conflicts)."""
    return rows.join(existing.select(*keys), keys, "left_anti")


def quarantine_age(quarantine: DataFrame, now: Column) -> DataFrame:
    """Unresolved rows by source and whole days since they were set aside (an addition to the reference's reports)."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp("quarantined_at")) / 86400).alias("days")
    return quarantine.where("resolved_at is null").groupBy("source", days).agg(F.count("*").alias("n"))
