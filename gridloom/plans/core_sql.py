"""DuckDB statements for the core queries, written independently of the operators."""

from __future__ import annotations

from gridloom.plans.problem_sql import _iso

_MESSAGES = f"""
keyed AS (
  SELECT *, {_iso('event_timestamp')} AS ts, {_iso('producer_emitted_at')} AS emitted,
         CASE WHEN event_id IS NULL OR trim(event_id) = '' THEN 'row ' || log_partition || ' ' || log_offset
              ELSE translate(replace(lower(trim(event_id)), 'urn:uuid:', ''), '{{}}-', '') END AS message
  FROM meter_readings_v1
),
messages AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message ORDER BY emitted, log_offset, log_partition) AS rn FROM keyed) WHERE rn = 1
)"""

_JUDGED = f"""{_MESSAGES},
judged AS (
  SELECT m.*, h.has_solar, h.solar_capacity_kw, z.name AS zone_name, z.capacity_kw AS zone_capacity_kw,
         CASE WHEN m.event_id IS NULL OR m.household_id IS NULL OR m.grid_zone IS NULL OR m.power_consumption_kwh IS NULL
                   OR m.solar_generation_kwh IS NULL OR m.ts IS NULL OR m.sim_date IS NULL THEN 'null_required_field'
              WHEN m.power_consumption_kwh < 0 OR m.solar_generation_kwh < 0 THEN 'negative_kwh'
              WHEN m.solar_generation_kwh > h.solar_capacity_kw + 1e-6 THEN 'solar_above_capacity'
              WHEN m.ts > m.emitted + INTERVAL '5 minutes' THEN 'future_timestamp' END AS reason
  FROM messages m LEFT JOIN households h ON h.household_id = m.household_id LEFT JOIN zones z ON z.grid_zone = h.grid_zone
)"""

_VALID = f"""{_JUDGED},
valid AS (
  SELECT *, power_consumption_kwh - solar_generation_kwh AS net, least(solar_generation_kwh, power_consumption_kwh) AS self,
         CASE WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 'OVERNIGHT' WHEN hour(ts) < 12 THEN 'MORNING' WHEN hour(ts) < 17 THEN 'AFTERNOON' ELSE 'EVENING' END AS bucket,
         emitted - ts > INTERVAL '576 seconds' AS late
  FROM judged WHERE reason IS NULL
)"""

_PCT = "CAST(CASE WHEN {c} <> 0 THEN least(100.0, greatest(0.0, CAST({s} AS DOUBLE) / CAST({c} AS DOUBLE) * 100)) END AS DECIMAL(6,3))"

_RUNNING = f"""{_VALID},
running AS (
  SELECT household_id, sim_date,
         CAST(sum(CAST(power_consumption_kwh AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS consumption_kwh, CAST(sum(CAST(solar_generation_kwh AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS solar_kwh,
         CAST(sum(CAST(net AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS net_grid_kwh, CAST(sum(CAST(self AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS self_consumption_kwh
  FROM valid GROUP BY 1, 2
)"""

_TARIFF = f"""
feed AS (SELECT *, {_iso('effective_from')} AS eff FROM tariff_reference_v1),
tariff AS (
  SELECT household_id, sim_date, log_offset, tariff_rate, billing_tier, subsidy_flag FROM (
    SELECT *, row_number() OVER (PARTITION BY household_id, sim_date ORDER BY eff DESC, source_seq DESC, log_offset DESC) AS n FROM feed WHERE household_id IS NOT NULL AND eff IS NOT NULL) WHERE n = 1 AND lower(trim(op)) NOT LIKE 'd%'
)"""

_WS = "strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start"
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_zone ORDER BY window_start DESC) AS n FROM zone_load_1m) WHERE n = 1"
_LOW = "SELECT grid_zone, window_start, renewable_pct FROM zone_load_1m WHERE hour(window_start) >= 6 AND hour(window_start) < 18 AND renewable_pct < 15"
_OVER = """SELECT w.grid_zone, window_start, CAST(total_consumption_kwh AS DOUBLE) / (epoch(window_end - window_start) / 3600.0) AS kw, capacity_kw
 FROM zone_load_1m w JOIN zones z ON z.grid_zone = w.grid_zone WHERE CAST(total_consumption_kwh AS DOUBLE) / (epoch(window_end - window_start) / 3600.0) > capacity_kw"""

SQL = {
    "parsed_readings": "SELECT log_offset, log_partition, event_id, power_consumption_kwh, solar_generation_kwh, schema_version FROM meter_readings_v1",
    "dedupe_readings": f"""WITH {_MESSAGES} SELECT log_offset, log_partition, CASE WHEN event_id IS NULL OR trim(event_id) = '' THEN '_unkeyable:' || log_offset_place ELSE message END AS dedupe_key
 FROM (SELECT *, log_partition || ':' || log_offset AS log_offset_place FROM messages)""",
    "reject_reasons": f"WITH {_JUDGED} SELECT coalesce(reason, 'valid') AS reason, count(*) AS n_rows FROM judged GROUP BY 1",
    "valid_readings": f"WITH {_JUDGED} SELECT log_offset, log_partition, event_id, household_id FROM judged WHERE reason IS NULL",
    "dlq_records": f"""WITH {_JUDGED} SELECT reason AS rejection_reason, producer_emitted_at AS rejected_at, 'clean' AS job_name, correlation_id, 1 AS schema_version, event_id AS original_event_id, meter_id AS original_meter_id,
 household_id AS original_household_id, grid_zone AS original_grid_zone, power_consumption_kwh AS original_power_consumption_kwh, solar_generation_kwh AS original_solar_generation_kwh, event_timestamp AS original_event_timestamp,
 sim_date AS original_sim_date, producer_emitted_at AS original_producer_emitted_at FROM judged WHERE reason IS NOT NULL""",
    "enriched_readings": f"WITH {_VALID} SELECT log_offset, log_partition, round(net, 6) AS net_grid_kwh, net < 0 AS is_exporting, round(self, 6) AS self_consumption_kwh, bucket AS time_of_day_bucket, zone_name, late AS is_late FROM valid",
    "clean_messages": f"""WITH {_VALID} SELECT grid_zone AS key, event_id, meter_id, household_id, power_consumption_kwh, solar_generation_kwh, net < 0 AS is_exporting, zone_name, bucket AS time_of_day_bucket, event_timestamp,
 round(net, 6) AS net_grid_kwh, round(self, 6) AS self_consumption_kwh FROM valid""",
    "bucket_totals": f"WITH {_VALID} SELECT bucket AS time_of_day_bucket, count(*) AS n_rows, CAST(sum(CAST(power_consumption_kwh AS DECIMAL(18,6))) AS DECIMAL(38,6)) AS consumption_kwh, count(*) FILTER (net < 0) AS exporting_count FROM valid GROUP BY 1",
    "zone_load_tumbling": f"""WITH {_VALID}, g AS (
 SELECT grid_zone, time_bucket(INTERVAL '288 minutes', ts, TIMESTAMP '1970-01-01') AS w, CAST(sum(CAST(power_consumption_kwh AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS c,
        CAST(sum(CAST(solar_generation_kwh AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS s, count(DISTINCT household_id) AS n, count(*) FILTER (late) AS l FROM valid GROUP BY 1, 2)
 SELECT grid_zone, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL '288 minutes', '%Y-%m-%d %H:%M:%S') AS window_end, c AS total_consumption_kwh, s AS total_solar_kwh,
        {_PCT.format(c='c', s='s')} AS renewable_pct, CAST(n AS INTEGER) AS active_meter_count, CAST(l AS INTEGER) AS late_event_count FROM g""",
    "late_event_counts": f"WITH {_VALID} SELECT grid_zone, count(*) FILTER (late) AS late_count, count(*) AS n_rows FROM valid GROUP BY 1",
    "running_totals": f"WITH {_RUNNING} SELECT *, CAST(CASE WHEN solar_kwh <> 0 THEN CAST(self_consumption_kwh AS DOUBLE) / CAST(solar_kwh AS DOUBLE) END AS DECIMAL(6,4)) AS self_consumption_ratio FROM running",
    "latest_tariff": f"WITH {_TARIFF} SELECT * FROM tariff",
    "running_with_tariff": f"WITH {_RUNNING}, {_TARIFF} SELECT r.household_id, r.sim_date, r.consumption_kwh, CAST(t.tariff_rate AS DECIMAL(10,4)) AS tariff_rate, t.billing_tier, t.tariff_rate IS NULL AS tariff_missing FROM running r LEFT JOIN tariff t ON t.household_id = r.household_id AND t.sim_date = r.sim_date",
    "unpriced_by_day": f"WITH {_RUNNING}, {_TARIFF} SELECT r.sim_date, count(*) AS n_rows, count(t.tariff_rate) AS priced_count, count(*) FILTER (t.tariff_rate IS NULL) AS unpriced_count FROM running r LEFT JOIN tariff t ON t.household_id = r.household_id AND t.sim_date = r.sim_date GROUP BY 1",
    "latest_zone_load": f"SELECT grid_zone, {_WS}, total_consumption_kwh, renewable_pct, active_meter_count FROM ({_LATEST})",
    "zone_timeseries": f"SELECT grid_zone, {_WS}, total_consumption_kwh, total_solar_kwh FROM (SELECT *, row_number() OVER (PARTITION BY grid_zone ORDER BY window_start DESC) AS n FROM zone_load_1m) WHERE n <= 50",
    "grid_summary": f"""WITH g AS (SELECT CAST(sum(total_consumption_kwh) AS DECIMAL(38,6)) AS consumption_kwh, CAST(sum(total_solar_kwh) AS DECIMAL(38,6)) AS solar_kwh, count(*) AS zone_count, CAST(sum(active_meter_count) AS BIGINT) AS meter_count FROM ({_LATEST}))
 SELECT *, {_PCT.format(c='consumption_kwh', s='solar_kwh')} AS renewable_pct FROM g""",
    "top_consumers": f"WITH {_RUNNING} SELECT household_id, sim_date, net_grid_kwh FROM running WHERE sim_date = (SELECT max(sim_date) FROM running) ORDER BY net_grid_kwh DESC NULLS LAST, household_id LIMIT 20",
    "bill_versions": "SELECT household_id, CAST(sim_date AS VARCHAR) AS sim_date, version, net_grid_kwh, final_bill, is_current FROM household_billing_daily",
    "bill_with_fallback": f"""WITH {_RUNNING}, issued AS (SELECT household_id, CAST(sim_date AS VARCHAR) AS sim_date, CAST(net_grid_kwh AS DECIMAL(28,6)) AS net_grid_kwh FROM household_billing_daily WHERE is_current)
 SELECT *, 'first' AS source FROM issued UNION ALL SELECT household_id, sim_date, net_grid_kwh, 'second' FROM running r WHERE NOT EXISTS (SELECT 1 FROM issued i WHERE i.household_id = r.household_id AND i.sim_date = r.sim_date)""",
    "latest_day_panel": "SELECT household_id, CAST(sim_date AS VARCHAR) AS sim_date, consumption_kwh FROM household_billing_daily WHERE is_current AND sim_date = (SELECT max(sim_date) FROM household_billing_daily WHERE is_current)",
    "freshness": "SELECT strftime(max(window_start), '%Y-%m-%d %H:%M:%S') AS last_window, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS last_update, count(*) AS n_rows FROM zone_load_1m",
    "day_load": f"SELECT grid_zone, {_WS}, total_consumption_kwh FROM zone_load_1m WHERE CAST(window_start AS DATE) = (SELECT CAST(max(window_start) AS DATE) FROM zone_load_1m)",
    "window_spans": "SELECT CAST(epoch(window_end - window_start) / 60 AS DOUBLE) AS span_minutes, count(*) AS n_rows FROM zone_load_1m GROUP BY 1",
    "coverage_gate": f"WITH {_RUNNING}, a AS (SELECT count(DISTINCT household_id) AS expected_count FROM households), b AS (SELECT count(DISTINCT household_id) AS seen_count FROM running) SELECT expected_count, seen_count, seen_count >= 0.95 * expected_count AS passed FROM a, b",
    "coherence_gate": """WITH g AS (SELECT count(*) FILTER (consumption_kwh < 0 OR solar_kwh < 0) AS negative_count, count(*) FILTER (solar_kwh > 0 AND net_grid_kwh > consumption_kwh + solar_kwh) AS net_above_count,
 count(*) FILTER (net_grid_kwh <> consumption_kwh - solar_kwh) AS net_off_count FROM household_billing_daily) SELECT *, negative_count + net_above_count + net_off_count = 0 AS passed FROM g""",
    "reject_rate_gate": f"WITH {_JUDGED} SELECT count(*) AS n_rows, count(reason) AS rejected_count, count(reason) <= 0.02 * count(*) AS passed FROM judged",
    "duplicate_keys": "SELECT event_id, count(*) AS n_rows FROM meter_readings_v1 WHERE event_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "current_version_faults": "SELECT household_id, CAST(sim_date AS VARCHAR) AS sim_date, count(*) FILTER (is_current) AS current_count FROM household_billing_daily GROUP BY household_id, household_billing_daily.sim_date HAVING count(*) FILTER (is_current) <> 1",
    "version_currency": "SELECT version, bool_and(is_current) AS all_current, count(DISTINCT household_id) AS n_households, count(*) AS n_rows FROM household_billing_daily GROUP BY 1",
    "null_iff_missing": "SELECT count(*) AS n_rows FROM household_billing_daily WHERE (tariff_rate IS NULL) <> (gross_cost IS NULL)",
    "settled_diff": """SELECT a.household_id, CAST(a.sim_date AS VARCHAR) AS sim_date FROM household_billing_daily a JOIN household_billing_daily b ON a.household_id = b.household_id AND a.sim_date = b.sim_date
 WHERE a.version = 1 AND b.is_current AND (a.net_grid_kwh IS DISTINCT FROM b.net_grid_kwh OR a.tariff_rate IS DISTINCT FROM b.tariff_rate)""",
    "low_renewable": f"SELECT grid_zone, {_WS}, renewable_pct FROM ({_LOW})",
    "zone_overload": f"SELECT grid_zone, {_WS}, round(kw, 6) AS mean_kw, capacity_kw FROM ({_OVER})",
    "meter_silent": f"""WITH s AS (SELECT meter_id, max({_iso('event_timestamp')}) AS t FROM meter_readings_v1 WHERE meter_id IS NOT NULL GROUP BY 1)
 SELECT h.meter_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS last_at FROM households h LEFT JOIN s ON s.meter_id = h.meter_id WHERE t IS NULL OR (SELECT max({_iso('event_timestamp')}) FROM meter_readings_v1 WHERE {_iso('event_timestamp')} <= {_iso('producer_emitted_at')}) - t > INTERVAL '6 hours'""",
    "inhibited_alerts": f"SELECT grid_zone, {_WS} FROM ({_LOW}) l WHERE NOT EXISTS (SELECT 1 FROM ({_OVER}) o WHERE o.grid_zone = l.grid_zone AND o.window_start = l.window_start)",
    "offset_rate": """WITH e AS (SELECT log_partition, batch_id, max(log_offset) AS end_offset FROM meter_readings_v1 GROUP BY 1, 2), p AS (SELECT *, lag(end_offset) OVER (PARTITION BY log_partition ORDER BY batch_id) AS b FROM e)
 SELECT log_partition, batch_id, end_offset, CASE WHEN b IS NULL THEN 0 WHEN end_offset >= b THEN end_offset - b ELSE end_offset END AS increase FROM p""",
    "batch_percentiles": f"""WITH r AS (SELECT log_partition, date_diff('microsecond', {_iso('event_timestamp')}, {_iso('producer_emitted_at')}) / 1e6 AS d FROM meter_readings_v1)
 SELECT log_partition, round(quantile_cont(d, 0.5), 3) AS p50_s, round(quantile_cont(d, 0.95), 3) AS p95_s FROM r WHERE d IS NOT NULL GROUP BY 1""",
    "households_by_zone": "SELECT grid_zone, count(*) AS n_households, count(*) FILTER (has_solar) AS with_solar, CAST(sum(CAST(solar_capacity_kw AS DECIMAL(18,3))) AS DECIMAL(38,3)) AS capacity_kw FROM households GROUP BY 1",
    "dimension_faults": """SELECT 'unknown_zone' AS fault, household_id AS id FROM households h WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.grid_zone = h.grid_zone)
 UNION ALL SELECT 'duplicate_household', household_id FROM households GROUP BY household_id HAVING count(*) > 1
 UNION ALL SELECT 'solar_flag_mismatch', household_id FROM households WHERE ((solar_capacity_kw > 0) <> has_solar) IS NOT FALSE
 UNION ALL SELECT 'duplicate_meter', meter_id FROM households GROUP BY meter_id HAVING count(*) > 1
 UNION ALL SELECT 'duplicate_zone', grid_zone FROM zones GROUP BY grid_zone HAVING count(*) > 1""",
    "distinct_days": "SELECT DISTINCT sim_date FROM meter_readings_v1",
    "redelivered": """WITH l AS (SELECT grid_zone, CASE WHEN trim(event_id) = '' THEN 'row ' || log_partition || ' ' || log_offset ELSE translate(replace(lower(trim(event_id)), 'urn:uuid:', ''), '{}-', '') END AS m, event_id
 FROM meter_readings_v1 WHERE event_id IS NOT NULL), b AS (SELECT grid_zone, m FROM l UNION ALL SELECT grid_zone, CASE WHEN trim(event_id) = '' THEN m || ' again' ELSE m END FROM l)
 SELECT grid_zone, count(*) AS n_rows, count(DISTINCT m) AS n_messages FROM b GROUP BY 1""",
    "next_versions": "SELECT CAST(sim_date AS VARCHAR) AS sim_date, coalesce(max(version), 0) + 1 AS next_version FROM household_billing_daily GROUP BY household_billing_daily.sim_date",
    "latest_bills": "SELECT household_id, CAST(sim_date AS VARCHAR) AS sim_date, version, net_grid_kwh, is_current FROM (SELECT *, row_number() OVER (PARTITION BY household_id, sim_date ORDER BY version DESC) AS n FROM household_billing_daily) WHERE n = 1",
    "restated_bills": f"""WITH {_RUNNING},
 bills AS (SELECT household_id, CAST(sim_date AS VARCHAR) AS d, version, CAST(net_grid_kwh AS DECIMAL(28,6)) AS net_grid_kwh, is_current FROM household_billing_daily),
 fresh AS (SELECT household_id, net_grid_kwh FROM running WHERE sim_date = (SELECT max(d) FROM bills)),
 v AS (SELECT max(version) + 1 AS version FROM bills WHERE d = (SELECT max(d) FROM bills))
 SELECT household_id, d AS sim_date, version, net_grid_kwh, is_current AND d <> (SELECT max(d) FROM bills) AS is_current FROM bills
 UNION ALL SELECT household_id, (SELECT max(d) FROM bills), CAST(v.version AS INTEGER), net_grid_kwh, TRUE FROM fresh, v
 UNION ALL SELECT household_id, d, CAST(v.version AS INTEGER), net_grid_kwh, TRUE FROM bills, v WHERE d = (SELECT max(d) FROM bills) AND is_current AND household_id NOT IN (SELECT household_id FROM fresh)""",
    "ready_days": """SELECT CAST(a.d AS VARCHAR) AS sim_date, bill_count, window_count FROM (SELECT sim_date AS d, count(*) AS bill_count FROM household_billing_daily WHERE is_current GROUP BY 1) a
 JOIN (SELECT CAST(window_start AS DATE) AS d, count(*) AS window_count FROM zone_load_1m GROUP BY 1) b ON a.d = b.d""",
    "unbilled_backlog": f"WITH {_RUNNING} SELECT sim_date, count(*) AS n_households FROM running r WHERE NOT EXISTS (SELECT 1 FROM household_billing_daily b WHERE b.household_id = r.household_id AND CAST(b.sim_date AS VARCHAR) = r.sim_date) GROUP BY 1",
    "daily_zone_report": f"""WITH g AS (SELECT grid_zone, CAST(CAST(window_start AS DATE) AS VARCHAR) AS day, CAST(sum(total_consumption_kwh) AS DECIMAL(38,6)) AS consumption_kwh, CAST(sum(total_solar_kwh) AS DECIMAL(38,6)) AS solar_kwh,
 round(avg(CAST(renewable_pct AS DOUBLE)), 4) AS mean_pct, max(active_meter_count) AS most_meters FROM zone_load_1m GROUP BY 1, 2) SELECT *, {_PCT.format(c='consumption_kwh', s='solar_kwh')} AS weighted_pct FROM g""",
    "hourly_profile": f"WITH {_VALID} SELECT CAST(hour(ts) AS INTEGER) AS hour_of_day, count(*) AS n_rows, CAST(sum(CAST(net AS DECIMAL(18,6))) AS DECIMAL(38,6)) AS net_grid_kwh FROM valid GROUP BY 1",
    "event_windows": """SELECT r_name, strftime(time_bucket(INTERVAL '288 minutes', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS total_value, count(DISTINCT user_id) AS n_users
 FROM events LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON user_id = c_custkey GROUP BY 1, 2""",
    "lineitem_totals": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_price, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1, 2",
    "latest_order": "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "sim_clock": f"""SELECT log_offset, log_partition, strftime(date_trunc('second', TIMESTAMP '2025-01-01' + to_microseconds(CAST(288 * date_diff('microsecond', TIMESTAMP '2025-03-03', {_iso('producer_emitted_at')}) AS BIGINT))), '%Y-%m-%d %H:%M:%S') AS sim_at FROM meter_readings_v1""",
    "prefix_window": f"""WITH r AS (SELECT *, {_iso('producer_emitted_at')} AS e FROM meter_readings_v1), z AS (SELECT date_trunc('day', max({_iso('event_timestamp')})) AS z FROM r WHERE {_iso('event_timestamp')} <= e) SELECT grid_zone, count(*) AS n_rows, count(DISTINCT correlation_id) AS n_ids FROM r, z
 WHERE correlation_id LIKE 'c-0%' AND e >= z - INTERVAL '2 days' AND e < z GROUP BY 1""",
    "target_day": "SELECT CAST(max(TRY_CAST(sim_date AS DATE)) - 1 AS VARCHAR) AS day FROM meter_readings_v1",
    "household_dimension": "SELECT household_id, has_solar, solar_capacity_kw, z.name AS zone_name, z.capacity_kw AS zone_capacity_kw FROM households h LEFT JOIN zones z ON z.grid_zone = h.grid_zone",
    "unreported_days": "SELECT DISTINCT sim_date FROM meter_readings_v1 WHERE sim_date IS NOT NULL AND sim_date NOT IN (SELECT CAST(sim_date AS VARCHAR) FROM household_billing_daily)",
    "approx_active_meters": f"""WITH {_VALID} SELECT grid_zone, strftime(time_bucket(INTERVAL '288 minutes', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, count(DISTINCT household_id) AS exact_count, TRUE AS within_error FROM valid GROUP BY 1, 2""",
    "pipeline_status": f"""SELECT 'readings' AS dataset, count(*) AS n_rows, strftime(max({_iso('producer_emitted_at')}), '%Y-%m-%d %H:%M:%S') AS newest FROM meter_readings_v1
 UNION ALL SELECT 'bills', count(*), strftime(max(generated_at), '%Y-%m-%d %H:%M:%S') FROM household_billing_daily UNION ALL SELECT 'zone_load', count(*), strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') FROM zone_load_1m
 UNION ALL SELECT 'tariffs', count(*), strftime(max(published_at), '%Y-%m-%d %H:%M:%S') FROM tariff_reference_v1""",
    "alerts": f"""WITH r AS (SELECT log_partition, {_iso('event_timestamp')} AS ts, {_iso('producer_emitted_at')} AS e FROM meter_readings_v1), now AS (SELECT max(e) AS n FROM r)
 SELECT 'no_data' AS alert, 'zone_load' AS label FROM now WHERE (SELECT n - max(updated_at) > INTERVAL '1 day' OR max(updated_at) IS NULL FROM zone_load_1m)
 UNION ALL SELECT 'lag', CAST(log_partition AS VARCHAR) FROM r, now GROUP BY log_partition, n HAVING n - max(e) > INTERVAL '2 hours'
 UNION ALL SELECT 'tariff_stalled', 'tariffs' FROM now WHERE (SELECT n - max(published_at) > INTERVAL '1 day' OR max(published_at) IS NULL FROM tariff_reference_v1)
 UNION ALL SELECT DISTINCT 'missed_report', CAST(CAST(ts AS DATE) AS VARCHAR) FROM r WHERE e >= ts AND CAST(ts AS DATE) NOT IN (SELECT sim_date FROM household_billing_daily)""",
}
