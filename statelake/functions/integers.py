"""Decimal text of integers wider than any Spark number type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed value: 2^127, the first integer with more than 127 bits
SURROGATE_FROM = "170141183460469231731687303715884105728"


def canonical_int(column: Column) -> Column:
    """Decimal text without blanks, plus sign or leading zeros; null stays null, and text that is no integer is an error."""
    text = column.cast("string")
    # one look for text that is canonical already; the rest is only evaluated for other text
    canonical = text.rlike("^(?:0|-?[1-9][0-9]*)$")
    valid = text.rlike(r"^\s*[+-]?[0-9]+\s*$")
    digits = F.regexp_replace(text, r"^\s*[+-]?0*|\s+$", "")
    sign = F.when(text.rlike(r"^\s*-") & (digits != ""), "-").otherwise("")
    whole = F.when(digits == "", "0").otherwise(F.concat(sign, digits))
    bad = F.raise_error(F.concat(F.lit("not an integer: '"), text, F.lit("'")))
    return F.when(text.isNull() | canonical, text).when(valid, whole).otherwise(bad)


def is_surrogate(column: Column) -> Column:
    """True for canonical decimal text of 2^127 or more."""
    width = len(SURROGATE_FROM)
    wide = (F.length(column) > width) | ((F.length(column) == width) & (column >= SURROGATE_FROM))
    return wide & ~column.startswith("-")
