"""Deterministic readings for tests and demonstrations, as Column expressions: the same on every run and cluster size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: hour of the peak, height and width of the humps of a day's load
HUMPS = ((7.5, 0.7, 1.5), (19.0, 1.3, 2.2))
BASE = 0.55


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def load_factor(hour: Column) -> Column:
    """The day's load curve: a floor and two Gaussian humps."""
    out = F.lit(BASE)
    for at, height, width in HUMPS:
        # the nearest way round the clock
        d = F.pmod(hour - F.lit(at) + 12.0, F.lit(24.0)) - 12.0
        out = out + F.lit(height) * F.exp(-(d * d) / F.lit(2 * width * width))
    return out


def solar_factor(hour: Column, sunrise: float = 6.0, sunset: float = 18.0) -> Column:
    """A half sine between sunrise and sunset, nought outside."""
    return F.when((hour > sunrise) & (hour < sunset), F.sin(F.lit(math.pi) * (hour - sunrise) / (sunset - sunrise))).otherwise(0.0)


def solar_index(cloud: Column) -> Column:
    """The share of clear-sky generation under a cloud cover in [0, 1]."""
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(0.9) * cloud)


def generate(spark: SparkSession, meters: int, hours: int, start_micros: int, seed: int = 1) -> DataFrame:
    """Hourly readings of so many meters, in the columns of the raw log."""
    n = spark.range(meters * hours).withColumns({"m": (F.col("id") % meters).cast("int"), "h": F.floor(F.col("id") / meters)})
    jitter = uniform(F.lit(seed), F.col("id"), F.lit("t"))
    at = F.lit(start_micros) + F.col("h") * 3_600_000_000 + (jitter * 3_000_000_000).cast("bigint")
    hour = F.pmod(at, F.lit(86_400_000_000)) / 3_600_000_000
    base = 0.2 + 2 * uniform(F.lit(seed), F.col("m"), F.lit("b"))
    capacity = F.when(F.col("m") % 5 < 3, 2 + 6 * uniform(F.lit(seed), F.col("m"), F.lit("c"))).otherwise(0.0)
    iso = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    name = lambda p: F.concat(F.lit(p), F.lpad(F.col("m").cast("string"), 4, "0"))
    return n.select(
        F.md5(F.concat_ws("|", F.lit(seed), "id")).alias("event_id"),
        name("M-").alias("meter_id"),
        name("H-").alias("household_id"),
        F.concat(F.lit("Z-"), (F.col("m") % 5).cast("string")).alias("grid_zone"),
        F.round(base * load_factor(hour) * (0.8 + 0.4 * uniform(F.lit(seed), F.col("id"), F.lit("n"))), 6).alias("power_consumption_kwh"),
        F.round(capacity * 0.8 * solar_factor(hour) * solar_index(uniform(F.lit(seed), F.col("h"), F.lit("w"))), 6).alias("solar_generation_kwh"),
        iso(at).alias("event_timestamp"),
        F.date_format(F.timestamp_micros(at), "yyyy-MM-dd").alias("sim_date"),
        iso(at + 5_000_000).alias("producer_emitted_at"),
        F.lit("c").alias("correlation_id"),
        F.lit(1).alias("schema_version"),
        capacity.alias("solar_capacity_kw"),
    )


#: fault and the share of records that have it; at most one each, duplicates aside
FAULTS = (("null_field", 0.002), ("negative", 0.002), ("solar_spike", 0.002), ("future", 0.002), ("late", 0.01))
DUPLICATES = 0.01
#: Fields that a record may lack.
NULL_FIELDS = ("household_id", "grid_zone", "event_timestamp")


def inject(readings: DataFrame, seed: int = 1, faults: tuple[tuple[str, float], ...] = FAULTS, duplicates: float = DUPLICATES, late_minutes: int = 4) -> DataFrame:
    """The readings with faults: column `fault` names the one that a record got. Duplicates are appended. late_minutes are simulated ones, as
    are the 30 of `future`; to be dropped behind a watermark they must exceed it."""
    u = uniform(F.lit(seed), F.col("event_id"), F.lit("fault"))
    fault, upto = F.lit(None).cast("string"), sum(s for _, s in faults)
    for name, share in reversed(faults):
        fault = F.when(u < upto, name).otherwise(fault)
        upto -= share
    # built from the last on, so that each fault has its own interval
    f = F.col("fault")
    which = F.floor(3 * uniform(F.lit(seed), F.col("event_id"), F.lit("which")))
    shifted = lambda minutes: F.date_format(F.to_timestamp("event_timestamp") + F.make_dt_interval(mins=F.lit(minutes)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    out = readings.withColumn("fault", fault).withColumns(
        {
            **{c: F.when((f == "null_field") & (which == k), None).otherwise(F.col(c)) for k, c in enumerate(NULL_FIELDS[:2])},
            "power_consumption_kwh": F.when(f == "negative", -F.col("power_consumption_kwh") - 0.001).otherwise(F.col("power_consumption_kwh")),
            "solar_generation_kwh": F.when(f == "solar_spike", 5 * F.greatest(F.col("solar_capacity_kw"), F.lit(1.0))).otherwise(F.col("solar_generation_kwh")),
            "event_timestamp": F.when((f == "null_field") & (which == 2), None).when(f == "future", shifted(30)).when(f == "late", shifted(-late_minutes)).otherwise(F.col("event_timestamp")),
        }
    )
    return out.unionByName(out.filter(uniform(F.lit(seed), F.col("event_id"), F.lit("copy")) < duplicates))


def without_dropouts(readings: DataFrame, share: float = 0.001, seed: int = 1, real_seconds: int = 90, ratio: float = 288.0) -> DataFrame:
    """Takes out all readings of a meter for spans of so many real seconds: a share of all such spans of all meters."""
    span = F.floor(F.unix_seconds(F.to_timestamp("event_timestamp")) / F.lit(real_seconds * ratio))
    return readings.filter(uniform(F.lit(seed), F.col("meter_id"), span, F.lit("out")) >= share)
