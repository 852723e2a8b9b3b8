"""Event-time windows per zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.amounts import decimal_of

WINDOW = "288 minutes"
TOTAL = "decimal(28,6)"


def kwh(c: Column) -> Column:
    """Energy for summing: exact, so that the order of rows does not matter. NaN is null; a value of 10^22 or more raises an error."""
    return decimal_of(c, 28, 6)


def renewable_pct(consumption: Column, solar: Column) -> Column:
    """Share of solar in consumption in percent within [0, 100]; null without consumption (the guard is outside of the clamp, which skips nulls)."""
    ratio = F.try_divide(solar.cast("double"), consumption.cast("double")) * 100
    return F.when(consumption != 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), ratio))).cast("decimal(6,3)")


def is_late(emitted: Column, event: Column, tick_seconds: float = 2.0, ratio: float = 288.0) -> Column:
    """Whether a reading took longer than a tick to be emitted; both are microseconds on the simulated axis."""
    return F.coalesce(emitted - event > F.lit(int(tick_seconds * ratio * 1_000_000)), F.lit(False))


def zone_load(df: DataFrame, event_at: str = "event_at", late: str = "is_late", window: str = WINDOW, exact_meters: bool = True, meter: str = "household_id") -> DataFrame:
    """Totals by zone and tumbling window; rows without zone or time are in none. exact_meters: batch frames only; a stream counts them approximately."""
    meters = F.count_distinct(meter) if exact_meters else F.approx_count_distinct(meter)
    out = (
        df.filter(F.col(event_at).isNotNull() & F.col("grid_zone").isNotNull())
        .groupBy(F.window(event_at, window), "grid_zone")
        .agg(
            F.sum(kwh(F.col("power_consumption_kwh"))).alias("c"),
            F.sum(kwh(F.col("solar_generation_kwh"))).alias("s"),
            meters.cast("int").alias("active_meter_count"),
            F.sum(F.when(F.col(late), 1).otherwise(0)).cast("int").alias("late_event_count"),
        )
    )
    return out.select(
        "grid_zone",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        F.col("c").cast(TOTAL).alias("total_consumption_kwh"),
        F.col("s").cast(TOTAL).alias("total_solar_kwh"),
        renewable_pct(F.col("c"), F.col("s")).alias("renewable_pct"),
        "active_meter_count",
        "late_event_count",
    )


def running_totals(df: DataFrame) -> DataFrame:
    """Sums per household and day so far, and the share of its solar that a household used itself (null without solar)."""
    sums = (
        df.filter(F.col("household_id").isNotNull() & F.col("sim_date").isNotNull())
        .groupBy("household_id", "sim_date")
        .agg(*[F.sum(kwh(F.col(c))).cast(TOTAL).alias(n) for c, n in (("power_consumption_kwh", "consumption_kwh"), ("solar_generation_kwh", "solar_kwh"), ("net_grid_kwh", "net_grid_kwh"), ("self_consumption_kwh", "self_consumption_kwh"))])
    )
    ratio = F.try_divide(F.col("self_consumption_kwh").cast("double"), F.col("solar_kwh").cast("double"))
    return sums.withColumn("self_consumption_ratio", ratio.try_cast("decimal(6,4)"))
