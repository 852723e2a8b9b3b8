"""DuckDB statements for the queries of problems 1 to 6. Those of 1 to 5 are written independently of the operators; that of 6 states the
operator's main rules and constants once more, so it tests how they are computed, not whether they are the right ones."""

from __future__ import annotations

_ISO = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?([Zz]|[+-]\d{2}:?\d{2})?$"


def _iso(column: str) -> str:
    zoned = f"CASE WHEN regexp_matches({column}, '([Zz]|[+-]\\d{{2}}:?\\d{{2}})$') AND length({column}) > 16 THEN {column} ELSE {column} || 'Z' END"
    return f"CASE WHEN regexp_matches({column}, '{_ISO}') THEN (TRY_CAST({zoned} AS TIMESTAMPTZ) AT TIME ZONE 'UTC') END"


_CHANGES = f"""
changes AS (
  SELECT household_id, source_seq, {_iso('effective_from')} AS eff, published_at,
         CASE WHEN lower(trim(op)) LIKE 'd%' THEN 'd' ELSE 'w' END AS kind, tariff_rate, billing_tier, subsidy_flag
  FROM tariff_reference_v1
  WHERE trim(household_id) <> '' AND {_iso('effective_from')} IS NOT NULL AND source_seq IS NOT NULL
    AND lower(trim(op)) IN ('i', 'insert', 'u', 'update', 'd', 'delete')
)"""

_RATES = f"""
WITH {_CHANGES},
ranked AS (
  SELECT b.household_id, b.sim_date, b.version, b.tariff_rate AS billed_rate, c.kind, c.tariff_rate,
         row_number() OVER (PARTITION BY b.household_id, b.sim_date, b.version ORDER BY c.eff DESC NULLS LAST, c.source_seq DESC) AS rn
  FROM household_billing_daily b
  LEFT JOIN changes c ON c.household_id = b.household_id AND c.eff <= CAST(b.sim_date AS TIMESTAMP) AND c.published_at <= b.generated_at
),
rates AS (
  SELECT household_id, CAST(sim_date AS VARCHAR) AS sim_date, version, CAST(billed_rate AS DECIMAL(14,4)) AS billed_rate,
         CASE WHEN kind = 'w' THEN CAST(tariff_rate AS DECIMAL(14,4)) END AS right_rate
  FROM ranked WHERE rn = 1
)"""

_STANDING = f"""
WITH {_CHANGES},
last AS (
  SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY eff DESC, source_seq DESC) AS rn FROM changes
)"""

_READINGS = f"""
keyed AS (
  SELECT log_partition, log_offset, meter_id, grid_zone, power_consumption_kwh, solar_generation_kwh,
         {_iso('event_timestamp')} AS ts, {_iso('producer_emitted_at')} AS emitted,
         CASE WHEN event_id IS NULL OR trim(event_id) = '' THEN 'row ' || log_partition || ' ' || log_offset
              ELSE translate(replace(lower(trim(event_id)), 'urn:uuid:', ''), '{{}}-', '') END AS message
  FROM meter_readings_v1
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY message ORDER BY emitted, log_offset, log_partition) AS rn FROM keyed
)"""

_SUMS = f"""
WITH {_READINGS},
sums AS (
  SELECT grid_zone, time_bucket(INTERVAL '288 minutes', ts, TIMESTAMP '1970-01-01') AS window_at,
         sum(coalesce(CAST(power_consumption_kwh AS DECIMAL(28,9)), 0)) AS c, sum(coalesce(CAST(solar_generation_kwh AS DECIMAL(28,9)), 0)) AS s,
         count(*) AS counted
  FROM numbered
  WHERE rn = 1 AND grid_zone IS NOT NULL AND ts IS NOT NULL AND emitted - ts <= INTERVAL '6 hours'
  GROUP BY 1, 2
)"""

SQL = {
    "p1_found": _RATES + " SELECT household_id, sim_date, version FROM rates WHERE billed_rate IS DISTINCT FROM right_rate",
    "p1_rates": _RATES + " SELECT * FROM rates",
    "p2_found": _STANDING + " SELECT household_id, source_seq FROM last WHERE rn = 1 AND kind = 'w'",
    "p2_table": _STANDING + " SELECT household_id, source_seq, tariff_rate, billing_tier, subsidy_flag FROM last WHERE rn = 1 AND kind = 'w'",
    "p3_found": f"""
WITH r AS (SELECT meter_id, {_iso('event_timestamp')} AS ts FROM meter_readings_v1 WHERE meter_id IS NOT NULL),
days AS (SELECT DISTINCT meter_id, date_trunc('day', ts) AS d FROM r WHERE ts IS NOT NULL),
slots AS (SELECT meter_id, d + k * INTERVAL '1 hour' AS h FROM days, range(24) AS g(k))
SELECT s.meter_id, strftime(s.h, '%Y-%m-%d %H:%M:%S') AS slot_start
FROM slots s LEFT JOIN (SELECT DISTINCT meter_id, date_trunc('hour', ts) AS h FROM r) x ON x.meter_id = s.meter_id AND x.h = s.h
WHERE x.h IS NULL""",
    "p4_found": f"WITH {_READINGS} SELECT log_partition, log_offset FROM numbered WHERE rn > 1",
    "p5_found": _SUMS
    + """
SELECT coalesce(z.grid_zone, sums.grid_zone) AS grid_zone, strftime(coalesce(z.window_start, sums.window_at), '%Y-%m-%d %H:%M:%S') AS window_start
FROM zone_load_1m z FULL JOIN sums ON z.grid_zone = sums.grid_zone AND z.window_start = sums.window_at
WHERE z.window_start IS NULL OR total_consumption_kwh IS NULL OR total_solar_kwh IS NULL
   OR abs(total_consumption_kwh - coalesce(c, 0)) > 0.0005 OR abs(total_solar_kwh - coalesce(s, 0)) > 0.0005""",
    "p5_views": _SUMS
    + """
SELECT grid_zone, strftime(window_at, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(c AS DECIMAL(38,6)) AS total_consumption_kwh,
       CAST(s AS DECIMAL(38,6)) AS total_solar_kwh, counted FROM sums""",
}


def _profile(column: str, usable: str, top: float, shoulder: float, name: str) -> str:
    """The regular top of each meter and the fences of its parts of the day, with exact quantiles."""
    v = f"CASE WHEN {usable} THEN {column} END"
    return f"""
{name}_meter AS (SELECT meter_id, quantile_disc({v}, {top}) AS top, quantile_disc({v}, {shoulder}) AS shoulder, max({v}) AS most FROM keyed WHERE meter_id IS NOT NULL GROUP BY 1),
{name}_part AS (
  SELECT meter_id, coalesce(CAST(hour(ts) AS INTEGER) // 4, -1) AS part,
         greatest(3 * quantile_disc({v}, 0.75) - 2 * quantile_disc({v}, 0.25), 2 * quantile_disc({v}, 0.9)) AS fence
  FROM keyed WHERE meter_id IS NOT NULL GROUP BY 1, 2
)"""


def _stuck(column: str, usable: str, positive_only: bool, measure: str, name: str) -> str:
    """Rows in runs of at least eight messages of one value, of meters without fixed levels."""
    return f"""
{name}_line AS (SELECT DISTINCT meter_id, ts, message, {column} AS v FROM keyed WHERE meter_id IS NOT NULL AND ts IS NOT NULL),
{name}_turn AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND v IS NOT DISTINCT FROM lag(v) OVER w THEN 0 ELSE 1 END AS turn FROM {name}_line WINDOW w AS (PARTITION BY meter_id ORDER BY ts, message)),
{name}_run AS (SELECT *, sum(turn) OVER (PARTITION BY meter_id ORDER BY ts, message ROWS UNBOUNDED PRECEDING) AS run FROM {name}_turn),
{name}_size AS (SELECT meter_id, run, any_value(v) AS v, count(*) AS n FROM {name}_run GROUP BY 1, 2),
{name}_all AS (SELECT meter_id, count(*) AS in_all FROM {name}_line WHERE {usable.replace(column, 'v')} GROUP BY 1),
{name}_level AS (SELECT meter_id, v, sum(n) AS n FROM {name}_size WHERE n > 1 AND {usable.replace(column, 'v')} GROUP BY 1, 2 {'HAVING count(*) > 1' if positive_only else ''}),
{name}_fixed AS (SELECT l.meter_id FROM {name}_level l JOIN {name}_all a ON a.meter_id = l.meter_id WHERE l.n >= 0.05 * in_all GROUP BY l.meter_id, in_all HAVING sum(l.n) >= 0.8 * in_all),
{name}_stuck AS (
  SELECT k.log_partition, k.log_offset, '{measure}' AS measure FROM keyed k
  JOIN {name}_run r ON r.meter_id = k.meter_id AND r.ts = k.ts AND r.message = k.message
  JOIN {name}_size z ON z.meter_id = r.meter_id AND z.run = r.run
  WHERE z.n >= 8 AND {usable.replace(column, 'z.v')} AND k.meter_id NOT IN (SELECT meter_id FROM {name}_fixed)
)"""


_USE, _SUN = "power_consumption_kwh", "solar_generation_kwh"
_SPIKE = "coalesce({m}.top > 0 AND ({v} > 2.6 * {m}.top OR ({v} > 4 * {m}.shoulder AND {m}.most > 1.6 * {m}.top)) AND {v} > coalesce({p}.fence, 0), FALSE)"

_FLAGS = f"""
WITH {_READINGS.split('numbered AS')[0].rstrip().rstrip(',').replace('SELECT log_partition,', 'SELECT household_id, log_partition,')},
{_profile(_USE, f'{_USE} >= 0', 0.985, 0.97, 'use')},
{_profile(_SUN, f'{_SUN} > 0', 0.96, 0.96, 'sun')},
{_stuck(_USE, f'{_USE} IS NOT NULL', False, _USE, 'u')},
{_stuck(_SUN, f'{_SUN} > 0', True, _SUN, 's')},
met AS (
  SELECT k.log_partition, k.log_offset, k.ts, k.{_USE} AS c, k.{_SUN} AS s, h.has_solar, h.solar_capacity_kw AS cap,
         {_SPIKE.format(m='um', p='up', v='k.' + _USE)} AS c_spike, {_SPIKE.format(m='sm', p='sp', v='k.' + _SUN)} AS s_spike
  FROM keyed k LEFT JOIN households h ON (k.meter_id IS NOT NULL AND h.meter_id = k.meter_id) OR (k.meter_id IS NULL AND h.household_id = k.household_id)
  LEFT JOIN use_meter um ON um.meter_id = h.meter_id LEFT JOIN use_part up ON up.meter_id = h.meter_id AND up.part = coalesce(CAST(hour(k.ts) AS INTEGER) // 4, -1)
  LEFT JOIN sun_meter sm ON sm.meter_id = h.meter_id LEFT JOIN sun_part sp ON sp.meter_id = h.meter_id AND sp.part = coalesce(CAST(hour(k.ts) AS INTEGER) // 4, -1)
),
flags AS (
  SELECT log_partition, log_offset, '{_USE}' AS measure, CASE WHEN c < 0 THEN 'negative' WHEN c_spike THEN 'spike' END AS why FROM met
  UNION ALL SELECT log_partition, log_offset, '{_SUN}',
    CASE WHEN s < 0 THEN 'negative' WHEN s > 0 AND (NOT has_solar OR cap <= 0) THEN 'no_panels' WHEN s > cap THEN 'above_capacity' WHEN s > 0 AND (hour(ts) >= 20 OR hour(ts) < 4) THEN 'dark' WHEN s_spike THEN 'spike' END FROM met
  UNION ALL SELECT *, 'stuck' FROM u_stuck UNION ALL SELECT *, 'stuck' FROM s_stuck
)"""

SQL["p6_flags"] = _FLAGS + " SELECT log_partition, log_offset, measure, min(why) AS why FROM flags WHERE why IS NOT NULL GROUP BY 1, 2, 3"
SQL["p6_found"] = _FLAGS + " SELECT DISTINCT log_partition, log_offset, measure FROM flags WHERE why IS NOT NULL"

SQL["p3_grid"] = f"""
WITH {_READINGS},
r AS (SELECT meter_id, ts, power_consumption_kwh AS v FROM numbered WHERE rn = 1 AND meter_id IS NOT NULL AND ts IS NOT NULL),
i AS (SELECT *, greatest(ts - INTERVAL '1 hour', coalesce(lag(ts) OVER w, ts - INTERVAL '1 hour')) AS b FROM r WINDOW w AS (PARTITION BY meter_id ORDER BY ts, v NULLS FIRST)),
c AS (SELECT *, date_trunc('hour', ts) AS cell, 1 AS here FROM i UNION ALL SELECT *, date_trunc('hour', b), 0 FROM i WHERE date_trunc('hour', b) < date_trunc('hour', ts)),
o AS (SELECT *, greatest(0, date_diff('microsecond', greatest(b, cell), least(ts, cell + INTERVAL '1 hour'))) AS cov FROM c),
s AS (
  SELECT meter_id, cell, sum(v * CASE WHEN ts > b THEN cov / CAST(date_diff('microsecond', b, ts) AS DOUBLE) ELSE here END) AS amount, sum(here) AS n, sum(cov) AS cov
  FROM o WHERE here = 1 OR cov > 0 GROUP BY 1, 2
),
d AS (SELECT meter_id, day + k * INTERVAL '1 hour' AS cell FROM (SELECT DISTINCT meter_id, date_trunc('day', cell) AS day FROM s), range(24) AS g(k))
SELECT d.meter_id, strftime(d.cell, '%Y-%m-%d %H:%M:%S') AS slot_start, round(amount, 6) AS kwh, CAST(coalesce(n, 0) AS BIGINT) AS readings,
       CAST(least(coalesce(cov, 0), 3600000000) // 1000000 AS BIGINT) AS covered_s, CASE WHEN n > 0 THEN 'observed' WHEN cov > 0 THEN 'filled' ELSE 'missing' END AS status
FROM d LEFT JOIN s ON s.meter_id = d.meter_id AND s.cell = d.cell"""

SQL["p2_incremental"] = SQL["p2_table"]
SQL["p4_batches"] = SQL["p4_found"]
SQL["p3_counter"] = f"""
WITH {_READINGS},
r AS (SELECT meter_id, ts, log_offset, log_partition, CAST(round(power_consumption_kwh * 1000) AS BIGINT) AS wh FROM numbered WHERE rn = 1 AND meter_id IS NOT NULL AND ts IS NOT NULL AND power_consumption_kwh > 0),
register AS (SELECT meter_id, ts, sum(wh) OVER (PARTITION BY meter_id, date_trunc('day', ts) ORDER BY ts, log_offset, log_partition ROWS UNBOUNDED PRECEDING) AS v FROM r),
state AS (SELECT meter_id, ts, max(v) AS v FROM register GROUP BY 1, 2),
i AS (SELECT meter_id, ts, lag(ts) OVER w AS b, CASE WHEN lag(v) OVER w IS NULL THEN NULL WHEN v < lag(v) OVER w THEN v ELSE v - lag(v) OVER w END AS amount FROM state WINDOW w AS (PARTITION BY meter_id ORDER BY ts)),
p AS (SELECT meter_id, ts, coalesce(b, ts) AS b, amount, date_trunc('day', coalesce(b, ts)) + INTERVAL '1 day' AS lo, date_trunc('day', ts) AS hi FROM i),
c AS (
  SELECT meter_id, ts, b, amount, cell, 1 AS n FROM (SELECT *, unnest(generate_series(date_trunc('hour', b), date_trunc('hour', ts), INTERVAL '1 hour')) AS cell FROM p) WHERE cell < lo OR cell >= hi
  UNION ALL SELECT meter_id, ts, b, amount, lo, date_diff('hour', lo, hi) FROM p WHERE lo < hi
),
o AS (SELECT *, n = 1 AND cell = date_trunc('hour', ts) AS here, greatest(0, date_diff('microsecond', greatest(b, cell), least(ts, cell + n * INTERVAL '1 hour'))) AS cov FROM c),
s AS (
  SELECT meter_id, cell, n, sum(amount * CASE WHEN ts > b THEN cov / CAST(date_diff('microsecond', b, ts) AS DOUBLE) ELSE CAST(here AS INTEGER) END) AS amount, count(*) FILTER (here) AS readings, sum(cov) AS cov
  FROM o WHERE here OR cov > 0 GROUP BY 1, 2, 3
),
d AS (SELECT meter_id, date_trunc('day', cell) AS day, max(n) AS n, sum(readings) > 0 AS in_use FROM s GROUP BY 1, 2),
g AS (SELECT meter_id, day + k * INTERVAL '1 hour' AS cell, n AS cells, in_use FROM d, range(24) AS x(k) WHERE n = 1 OR k = 0)
SELECT g.meter_id, strftime(g.cell, '%Y-%m-%d %H:%M:%S') AS slot_start, round(amount, 6) AS wh, CAST(coalesce(readings, 0) AS BIGINT) AS readings,
       CAST(least(coalesce(cov, 0), g.cells * 3600000000) // 1000000 AS BIGINT) AS covered_s, CASE WHEN readings > 0 THEN 'observed' WHEN cov > 0 THEN 'filled' ELSE 'missing' END AS status, g.cells, g.in_use
FROM g LEFT JOIN s ON s.meter_id = g.meter_id AND s.cell = g.cell"""
