"""DuckDB statements for the queries that run streaming jobs and stores."""

from __future__ import annotations

from gridloom.plans.core_sql import _JUDGED, _MESSAGES, _PCT, _VALID

_EMITTED, _ARRIVED = "ORDER BY emitted, log_offset, log_partition", "ORDER BY log_offset, log_partition"
_FIRST, _FIRST_JUDGED, _FIRST_VALID = (x.replace(_EMITTED, _ARRIVED) for x in (_MESSAGES, _JUDGED, _VALID))

SQL = {
    "stream_messages": f"""WITH {_FIRST_VALID} SELECT grid_zone AS key, CASE WHEN trim(event_id) = '' THEN NULL ELSE message END AS message, household_id, power_consumption_kwh, solar_generation_kwh, bucket AS time_of_day_bucket, zone_name FROM valid""",
    "stream_dead_letters": f"WITH {_FIRST_JUDGED} SELECT reason AS rejection_reason, 'clean' AS job_name, correlation_id, log_offset, household_id, event_timestamp FROM judged WHERE reason IS NOT NULL",
    "stream_archive": f"WITH {_FIRST_VALID} SELECT sim_date, grid_zone, count(*) AS n_rows, count(DISTINCT household_id) AS n_households FROM valid GROUP BY 1, 2",
    "stream_audit": f"WITH {_FIRST_JUDGED} SELECT coalesce(reason, 'valid') AS reason, count(*) AS n_rows FROM judged GROUP BY 1",
    # records without an id are no copies of each other, so those that come twice count twice
    "stream_zone_load": f"""WITH {_FIRST_VALID}, twice AS (SELECT * FROM valid UNION ALL SELECT * FROM valid WHERE trim(event_id) = ''), g AS (
 SELECT grid_zone, time_bucket(INTERVAL '288 minutes', ts, TIMESTAMP '1970-01-01') AS w, CAST(sum(CAST(power_consumption_kwh AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS c,
        CAST(sum(CAST(solar_generation_kwh AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS s, count(*) FILTER (late) AS l FROM twice GROUP BY 1, 2)
 SELECT grid_zone, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, c AS total_consumption_kwh, s AS total_solar_kwh, {_PCT.format(c='c', s='s')} AS renewable_pct, CAST(l AS INTEGER) AS late_event_count FROM g""",
    "stream_running": f"""WITH {_FIRST_VALID}, twice AS (SELECT * FROM valid UNION ALL SELECT * FROM valid WHERE trim(event_id) = '')
 SELECT household_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_day, CAST(sum(CAST(power_consumption_kwh AS DECIMAL(18,6))) AS DECIMAL(38,6)) AS consumption_kwh,
        CAST(sum(CAST(solar_generation_kwh AS DECIMAL(18,6))) AS DECIMAL(38,6)) AS solar_kwh FROM twice GROUP BY 1, 2""",
    "stream_once": f"WITH {_FIRST} SELECT CASE WHEN trim(event_id) = '' THEN NULL WHEN event_id IS NOT NULL THEN message END AS message, household_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time FROM messages",
    "store_merge": """WITH b AS (SELECT household_id, CAST(sim_date AS VARCHAR) AS sim_date, version, net_grid_kwh, tariff_rate FROM household_billing_daily)
 SELECT household_id, sim_date, max(version) AS version, arg_max(net_grid_kwh, version) AS net_grid_kwh, first(tariff_rate ORDER BY version) FILTER (tariff_rate IS NOT NULL) AS tariff_rate FROM b GROUP BY 1, 2""",
    "run_audit": """SELECT batch_id AS run_id, 'clean' AS job_name, 'parsed' AS stage, count(*) AS n_rows FROM meter_readings_v1 GROUP BY 1 UNION ALL SELECT batch_id, 'clean', 'with_meter', count(meter_id) FROM meter_readings_v1 GROUP BY 1
 UNION ALL SELECT batch_id, 'clean', 'timed', count(event_timestamp) FROM meter_readings_v1 GROUP BY 1""",
    "bill_report": "SELECT household_id, CAST(sim_date AS VARCHAR) AS sim_date, CAST(net_grid_kwh AS VARCHAR) AS net_grid_kwh FROM household_billing_daily WHERE is_current AND sim_date = (SELECT max(sim_date) FROM household_billing_daily WHERE is_current)",
    "load_age": "SELECT grid_zone, CAST(date_diff('microsecond', max(updated_at), (SELECT max(updated_at) FROM zone_load_1m)) // 60000000 AS BIGINT) AS age_minutes FROM zone_load_1m GROUP BY 1",
}
