"""Unix seconds to days and back (F4, F5, F6); none of these depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def day_number(seconds: Column) -> Column:
    """Days since 1970-01-01."""
    return F.call_function("div", seconds, F.lit(86400)).cast("int")


def date_text(seconds: Column) -> Column:
    """UTC date as YYYY-MM-DD."""
    return F.date_from_unix_date(day_number(seconds)).cast("string")


def iso_seconds(text: Column) -> Column:
    """ISO time text to unix seconds, null when it is not one; text without a zone counts as UTC."""
    clean = F.trim(text)
    zoned = F.when(clean.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$"), clean).otherwise(F.concat(clean, F.lit("Z")))
    return F.when(clean.rlike(r"\d[T ]\d"), F.unix_timestamp(F.try_to_timestamp(zoned))).otherwise(
        F.unix_date(F.try_to_date(clean, "yyyy-MM-dd")).cast("long") * 86400
    )
