"""ISO 8601 texts and timestamps as microseconds of UTC, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3_600 * SECOND
DAY = 24 * HOUR

#: A date, a time of day and (optionally) an offset. A date alone is not a time.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$"
#: What a cast reads as it is.
_USUAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"


def iso_micros(text: Column) -> Column:
    """Microseconds since 1970 UTC of an ISO 8601 text; null if it is null or no valid ISO time. Without an offset it counts as UTC.

    The expression is kept small: code beyond what the JVM compiles runs several times as long.
    """
    read = lambda c: F.unix_micros(F.try_to_timestamp(c))
    t = F.upper(F.trim(text))
    # seconds where there are none, a colon in the offset, Z where there is no offset
    whole = F.regexp_replace(t, r"^(.{10})[T ](\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})?$", "$1T$2:00$3")
    whole = F.regexp_replace(F.regexp_replace(whole, r"^(.{16,}[+-]\d{2})(\d{2})$", "$1:$2"), r"^(.{10}[T ][\d:.]+)$", "$1Z")
    return F.coalesce(F.when(text.rlike(_USUAL), read(text)), F.when(t.rlike(ISO_TIME), read(whole)))


def micros(col: Column, dtype: str) -> Column:
    """Microseconds since 1970 of a column of the given type name: timestamp, timestamp_ntz, date or ISO text."""
    if dtype == "string":
        return iso_micros(col)
    if dtype == "date":
        return F.unix_date(col).cast("bigint") * F.lit(DAY)
    if dtype == "timestamp_ntz":
        # through text and an explicit offset, so that the session's zone plays no part
        return F.unix_micros(F.try_to_timestamp(F.concat(col.cast("string"), F.lit("Z"))))
    return F.unix_micros(col)


def div(a: Column, b: int) -> Column:
    """Whole quotient, towards zero."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def floor_to(micros_col: Column, step: int) -> Column:
    """The greatest multiple of step not above, for negative values too."""
    return micros_col - F.pmod(micros_col, F.lit(step).cast("bigint"))


def bucket_of(micros_col: Column, step: int) -> Column:
    """The number of the half-open bucket of this width that holds the instant."""
    return div(floor_to(micros_col, step), step)


def micros_text(micros_col: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' in UTC."""
    day = F.date_from_unix_date(bucket_of(micros_col, DAY).cast("int"))
    rest = div(F.pmod(micros_col, F.lit(DAY).cast("bigint")), SECOND)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit(" "), two(div(rest, 3600)), F.lit(":"), two(div(F.pmod(rest, F.lit(3600)), 60)), F.lit(":"), two(F.pmod(rest, F.lit(60))))
