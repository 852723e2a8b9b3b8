"""Parsing, validation, routing and enrichment of readings: pure functions of frames, batch or streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.contracts import CLEAN_FIELDS, READING, REQUIRED
from gridloom.functions.identifiers import uuid_hex

TOLERANCE = 1e-6


def parse(raw: DataFrame, value: str = "value", schema: T.StructType = READING) -> DataFrame:
    """The columns of a JSON value against an explicit schema, next to the raw text and the log's columns. What doesn't parse is null."""
    kept = [c for c in raw.columns if c != value]
    return raw.select(*kept, F.col(value).cast("string").alias("raw_value"), F.from_json(F.col(value).cast("string"), schema).alias("_d")).select(*kept, "raw_value", "_d.*")


def message_id(event_id: Column) -> Column:
    """The same for all spellings of a UUID; of other identifiers the trimmed text; null if there is none (null or blank)."""
    text = event_id.cast("string")
    return F.coalesce(uuid_hex(text), F.when(text.rlike(r"\S"), F.trim(text)))


def dedupe_key(event_id: Column, place: Column) -> Column:
    """The message's identity or, for a record without one, its place, which must be its own: it is kept, and rejected later with a reason."""
    return F.coalesce(message_id(event_id), F.concat(F.lit("_unkeyable:"), place))


def any_null(columns: list[str] | tuple[str, ...] = REQUIRED) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def negative_energy(consumption: Column, solar: Column) -> Column:
    return (consumption < 0) | (solar < 0)


def solar_above_capacity(solar: Column, capacity: Column, interval_seconds: float = 3600.0) -> Column:
    return solar > capacity * F.lit(interval_seconds / 3600.0) + F.lit(TOLERANCE)


def in_future(event_at: Column, now: Column, tolerance_seconds: int = 300) -> Column:
    """event_at and now are timestamps."""
    return event_at > now + F.make_dt_interval(secs=F.lit(tolerance_seconds))


def rejection_reason(now: Column, required: tuple[str, ...] = REQUIRED, event_at: str = "event_at", interval_seconds: float = 3600.0, tolerance_seconds: int = 300, reject_unknown_household: bool = False) -> Column:
    """The first rule that a reading breaks, null if none.

    In this order: null_required_field, negative_kwh, solar_above_capacity, future_timestamp. With reject_unknown_household a
    household that the dimension lacks is rejected after a null field; by default its reading passes, as nothing can be said
    about its capacity.
    """
    out = F.when(any_null(required), "null_required_field")
    if reject_unknown_household:
        out = out.when(F.col("solar_capacity_kw").isNull(), "unknown_household")
    consumption, solar = F.col("power_consumption_kwh"), F.col("solar_generation_kwh")
    return (
        out.when(negative_energy(consumption, solar), "negative_kwh")
        .when(solar_above_capacity(solar, F.col("solar_capacity_kw"), interval_seconds), "solar_above_capacity")
        .when(in_future(F.col(event_at), now, tolerance_seconds), "future_timestamp")
    )


def split(df: DataFrame, reason: str = "rejection_reason") -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows."""
    return df.filter(F.col(reason).isNull()), df.filter(F.col(reason).isNotNull())


def time_of_day(at: Column) -> Column:
    h = F.hour(at)
    return F.when((h < 6) | (h >= 22), "OVERNIGHT").when(h < 12, "MORNING").when(h < 17, "AFTERNOON").when(h < 22, "EVENING")


def enrich(df: DataFrame, event_at: str = "event_at") -> DataFrame:
    """Adds net_grid_kwh (signed), is_exporting, self_consumption_kwh and time_of_day_bucket."""
    consumption, solar = F.col("power_consumption_kwh"), F.col("solar_generation_kwh")
    return df.withColumns(
        {
            "net_grid_kwh": consumption - solar,
            "is_exporting": consumption - solar < 0,
            # least() would skip a null
            "self_consumption_kwh": F.when(consumption.isNotNull() & solar.isNotNull(), F.least(solar, consumption)),
            "time_of_day_bucket": time_of_day(F.col(event_at)),
        }
    )


def dimension(households: DataFrame, zones: DataFrame) -> DataFrame:
    """Households with their zone's name and capacity."""
    z = zones.select(F.col("grid_zone").alias("_zone"), F.col("name").alias("zone_name"), F.col("capacity_kw").alias("zone_capacity_kw"))
    return households.join(z, households["grid_zone"] == z["_zone"], "left").select("household_id", "has_solar", "solar_capacity_kw", "zone_name", "zone_capacity_kw")


def dimension_faults(households: DataFrame, zones: DataFrame) -> DataFrame:
    """What is wrong with a dimension: fault and id, no row if nothing is."""
    twice = lambda df, c, name: df.groupBy(F.col(c).alias("id")).count().filter("count > 1").select(F.lit(name).alias("fault"), "id")
    flag = (F.col("solar_capacity_kw") > 0) != F.col("has_solar")
    return (
        twice(households, "household_id", "duplicate_household")
        .unionByName(twice(households, "meter_id", "duplicate_meter"))
        .unionByName(twice(zones, "grid_zone", "duplicate_zone"))
        .unionByName(households.join(zones, "grid_zone", "left_anti").select(F.lit("unknown_zone").alias("fault"), F.col("household_id").alias("id")))
        .unionByName(households.filter(F.coalesce(flag, F.lit(True))).select(F.lit("solar_flag_mismatch").alias("fault"), F.col("household_id").alias("id")))
    )


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows that a frame is made of, by their statistics, without a job; unknown sizes count as huge."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def join_dimension(df: DataFrame, dim: DataFrame, keys: list[str] | str = "household_id", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Left equi-join that neither drops nor multiplies rows (the dimension's keys must be unique).

    The dimension is broadcast only if what it is read from has no more than so many bytes; beyond, or where that is not known,
    Spark joins by shuffle, or broadcasts what it has measured at run time. Joins of a dimension with its own lookups add no rows, so that its source bounds its size.
    """
    small = not dim.isStreaming and source_bytes(dim) <= broadcast_bytes
    return df.join(F.broadcast(dim) if small else dim, keys, "left")


def clean_message(df: DataFrame) -> DataFrame:
    """key and value (JSON) of the clean log."""
    return df.select(F.col("grid_zone").alias("key"), F.to_json(F.struct(*CLEAN_FIELDS)).alias("value"))


def dead_letters(rejected: DataFrame, job: str, at: Column) -> DataFrame:
    """The envelope of rejected records; the payload stays opaque."""
    return rejected.select(
        F.col("raw_value").alias("original_payload"), "rejection_reason", at.cast("string").alias("rejected_at"), F.lit(job).alias("job_name"), "correlation_id", F.lit(1).alias("schema_version")
    )
