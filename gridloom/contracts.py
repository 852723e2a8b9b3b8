"""Record contracts: one definition for readers and writers. All columns are nullable when parsed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _B, _I, _L = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


READING = _struct(
    event_id=_S, meter_id=_S, household_id=_S, grid_zone=_S, power_consumption_kwh=_D, solar_generation_kwh=_D,
    event_timestamp=_S, sim_date=_S, producer_emitted_at=_S, correlation_id=_S, schema_version=_I,
)

CLEAN_READING = _struct(
    event_id=_S, meter_id=_S, household_id=_S, grid_zone=_S, power_consumption_kwh=_D, solar_generation_kwh=_D,
    net_grid_kwh=_D, self_consumption_kwh=_D, is_exporting=_B, has_solar=_B, solar_capacity_kw=_D, zone_name=_S, zone_capacity_kw=_D,
    time_of_day_bucket=_S, event_timestamp=_S, sim_date=_S, producer_emitted_at=_S, correlation_id=_S,
)
CLEAN_FIELDS = tuple(CLEAN_READING.names)

TARIFF = _struct(household_id=_S, sim_date=_S, tariff_rate=_D, billing_tier=_S, subsidy_flag=_B, effective_from=_S, schema_version=_I)
WEATHER = _struct(grid_zone=_S, sim_date=_S, cloud_cover_pct=_D, expected_solar_index=_D, forecast_issued_at=_S, schema_version=_I)
DEAD_LETTER = _struct(original_payload=_S, rejection_reason=_S, rejected_at=_S, job_name=_S, correlation_id=_S, schema_version=_I)
HOUSEHOLD = _struct(household_id=_S, meter_id=_S, grid_zone=_S, has_solar=_B, base_load_kw=_D, solar_capacity_kw=_D)
ZONE = _struct(grid_zone=_S, name=_S, capacity_kw=_D, latitude_deg=_D)

#: Fields without which a reading is rejected.
REQUIRED = ("event_id", "household_id", "grid_zone", "power_consumption_kwh", "solar_generation_kwh", "event_timestamp", "sim_date")

#: Keys of the serving tables.
KEYS = {
    "zone_load": ("grid_zone", "window_start"),
    "running_bills": ("household_id", "sim_date"),
    "daily_bills": ("household_id", "sim_date", "version"),
    "run_audit": ("run_id", "job_name", "stage"),
    "day_state": ("sim_date",),
}
