"""Trade item numbers: padding, check digit, restricted numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_gtin(raw: Column) -> Column:
    """Digits only, padded to 14; null if there are none or more than 14."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when((F.length(digits) > 0) & (F.length(digits) <= 14), F.lpad(digits, 14, "0"))


def check_digit_ok(gtin14: Column) -> Column:
    """Whether the weighted digit sum (3, 1, 3, ... from the left) is a multiple of ten."""
    total = sum((F.substring(gtin14, i + 1, 1).cast("int") * (3 if i % 2 == 0 else 1) for i in range(14)), F.lit(0))
    return (F.length(gtin14) == 14) & (total % 10 == 0)


def is_restricted(gtin14: Column) -> Column:
    """Numbers that stores give out themselves: 2 as the second of 14 digits."""
    return F.substring(gtin14, 2, 1) == "2"


def matchable_gtin(raw: Column) -> Column:
    """The 14 digits if they identify a product everywhere, else null."""
    g = normalize_gtin(raw)
    return F.when(check_digit_ok(g) & ~is_restricted(g) & (g != "0" * 14), g)
