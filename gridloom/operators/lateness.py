"""Problem 5: aggregates by event time, corrected as late records arrive, with a cut-off: Lambda views.

The fast layer adds the messages that are new to the provisional totals of their window. A scheduled batch recomputes the windows that are
still open from the full log and replaces what the fast layer had; a window whose cut-off has passed at a batch is frozen, and
neither layer reads or changes it again. A view is the last batch's totals plus the fast layer's increments since. Here is what
both layers compute; `LambdaStore` (streaming/lambda_store.py) keeps them as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.amounts import decimal_of
from gridloom.functions.timeparse import floor_to

#: Exact, so that sums do not depend on the order of arrival.
ENERGY = "decimal(38,9)"


def exact(value: Column) -> Column:
    """A measured value for summing: null and NaN add nothing, infinities and values of 10^29 or more raise an error."""
    return F.coalesce(decimal_of(value, 38, 9), F.lit(0).cast(ENERGY))


def last_batch(as_of: int, every: int) -> int:
    """The last scheduled batch not after as_of."""
    return as_of - as_of % every


def first_open(now: int, window: int, cutoff: int) -> int:
    """The start of the first window that is still open at a batch: earlier ones had their cut-off."""
    return (now - window - cutoff) // window * window + window


def window_totals(messages: DataFrame, keys: list[str], event_at: str, published_at: str, sums: dict[str, str], window: int, cutoff: int) -> DataFrame:
    """keys, window_at (microseconds), the sums and counted, of windows with counted messages.

    Counted are messages with non-null keys, event time and publication time that were published no later than cutoff after their
    event (that may lie ahead of publication). sums maps output names to columns. Each message must come once. Hot windows and keys are
    summed on the map side first.
    """
    counted = F.col(published_at) - F.col(event_at) <= F.lit(cutoff)
    for k in keys:
        counted = counted & F.col(k).isNotNull()
    grouped = messages.filter(counted).groupBy(*keys, floor_to(F.col(event_at), window).alias("window_at"))
    return grouped.agg(*[F.sum(exact(F.col(c))).cast(ENERGY).alias(n) for n, c in sums.items()], F.count(F.lit(1)).alias("counted"))


def windows_to_correct(views: DataFrame, published: DataFrame, keys: list[str], sums: dict[str, str], tolerance: float) -> DataFrame:
    """keys and window_at of the published rows that are off, and of windows with counted records but no row.

    published has keys, window_at and, for each sum, the column that sums maps it to; a null total is off. Without counted
    records the right sum is 0.
    """
    right = views.filter("counted > 0").select(*keys, "window_at", *sums, F.lit(True).alias("_right"))
    left = published.select(*keys, "window_at", *[F.col(c).alias("_was_" + n) for n, c in sums.items()], F.lit(True).alias("_there"))
    both = left.join(right, [*keys, "window_at"], "full")
    off = F.lit(False)
    for n in sums:
        # decimals are compared as decimals
        off = off | F.coalesce(F.abs(F.col("_was_" + n).cast(ENERGY) - F.coalesce(n, F.lit(0).cast(ENERGY))) > F.lit(str(tolerance)).cast(ENERGY), F.lit(True))
    return both.filter(F.col("_there").isNull() | off).select(*keys, "window_at")
