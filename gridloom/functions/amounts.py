"""Measured doubles as decimals, so that sums do not depend on order; nothing is dropped without a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_of(value: Column, precision: int, scale: int) -> Column:
    """value at scale digits, rounded half up; null and NaN are null, and a value with more digits before the point than fit raises an error."""
    fits = F.abs(value) < F.lit(10.0 ** (precision - scale))
    return F.when(value.isNull() | F.isnan(value), F.lit(None)).when(fits, value.try_cast(f"decimal({precision},{scale})")).otherwise(F.raise_error(F.concat(F.lit("too large for a sum: "), value.cast("string"))).cast(f"decimal({precision},{scale})"))
