import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.fixtures import generators
from gridloom.operators import clean, quality, serving, zones
from gridloom.simtime import Clock, TimeBudget

NOW = "2026-01-14 12:00:00"
READING = "event_id string, meter_id string, household_id string, grid_zone string, power_consumption_kwh double, solar_generation_kwh double, solar_capacity_kw double, event_timestamp timestamp, sim_date string"
FIELDS = ("event_id", "household_id", "grid_zone", "power_consumption_kwh", "solar_generation_kwh", "event_timestamp", "sim_date")


def readings(spark, **changes):
    base = {"event_id": "e", "meter_id": "m", "household_id": "h", "grid_zone": "z", "power_consumption_kwh": 0.5, "solar_generation_kwh": 0.2, "solar_capacity_kw": 4.0, "event_timestamp": datetime(2026, 1, 14, 11), "sim_date": "2026-01-14"}
    return spark.createDataFrame([tuple((base | changes).values())], READING)


def reason(spark, interval=3600.0, unknown=False, **changes):
    col = clean.rejection_reason(F.lit(NOW).cast("timestamp"), FIELDS, "event_timestamp", interval, 300, unknown)
    return readings(spark, **changes).select(col).first()[0]


def test_each_rule_and_their_order(spark):
    at = datetime(2026, 1, 14, 12)
    assert reason(spark) is None
    assert reason(spark, power_consumption_kwh=0.0, solar_generation_kwh=0.0) is None
    for f in FIELDS:
        assert reason(spark, **{f: None}) == "null_required_field"
    assert reason(spark, power_consumption_kwh=-1e-9) == "negative_kwh"
    assert reason(spark, solar_generation_kwh=-0.1) == "negative_kwh"
    assert reason(spark, solar_generation_kwh=4.0) is None
    assert reason(spark, solar_generation_kwh=4.0000001) is None
    assert reason(spark, solar_generation_kwh=4.1) == "solar_above_capacity"
    assert reason(spark, solar_generation_kwh=0.1, solar_capacity_kw=0.0) == "solar_above_capacity"
    assert reason(spark, interval=1800.0, solar_generation_kwh=3.0) == "solar_above_capacity"
    assert [reason(spark, event_timestamp=at + timedelta(minutes=m)) for m in (4, 5, 6, 30, -360)] == [None, None, "future_timestamp", "future_timestamp", None]
    assert reason(spark, power_consumption_kwh=-1.0, solar_generation_kwh=99.0, event_timestamp=at + timedelta(hours=1)) == "negative_kwh"
    assert reason(spark, solar_generation_kwh=99.0, event_timestamp=at + timedelta(hours=1)) == "solar_above_capacity"
    # a household that the dimension lacks passes, unless asked otherwise
    assert reason(spark, solar_capacity_kw=None, solar_generation_kwh=99.0) is None
    assert reason(spark, unknown=True, solar_capacity_kw=None) == "unknown_household"


def test_split_loses_nothing(spark):
    df = readings(spark).union(readings(spark, power_consumption_kwh=-1.0)).withColumn("rejection_reason", clean.rejection_reason(F.lit(NOW).cast("timestamp"), FIELDS, "event_timestamp"))
    a, b = clean.split(df)
    assert (a.count(), b.count()) == (1, 1)


def test_enrichment(spark):
    rows = [(0.5, 0.2), (0.2, 0.5), (0.3, 0.3), (None, 0.3), (0.3, None)]
    df = spark.createDataFrame([(*r, datetime(2026, 1, 14, 11)) for r in rows], "power_consumption_kwh double, solar_generation_kwh double, event_at timestamp")
    got = [(r.net_grid_kwh, r.is_exporting, r.self_consumption_kwh) for r in clean.enrich(df).collect()]
    assert got == [(0.3, False, 0.2), (-0.3, True, 0.2), (0.0, False, 0.3), (None, None, None), (None, None, None)]
    hours = spark.range(24).select(F.make_timestamp(F.lit(2026), F.lit(1), F.lit(14), F.col("id").cast("int"), F.lit(59), F.lit(59)).alias("t"))
    assert [r[0] for r in hours.select(clean.time_of_day(F.col("t"))).collect()] == ["OVERNIGHT"] * 6 + ["MORNING"] * 6 + ["AFTERNOON"] * 5 + ["EVENING"] * 5 + ["OVERNIGHT"] * 2


def test_dimension_join_neither_drops_nor_multiplies(spark):
    dim = spark.createDataFrame([("h", 1)], "household_id string, x int")
    df = readings(spark).union(readings(spark, household_id="other")).union(readings(spark, household_id=None))
    for most in (1 << 80, 0):  # broadcast or not
        assert sorted((r.household_id or "", r.x) for r in clean.join_dimension(df, dim, broadcast_bytes=most).collect()) == [("", None), ("h", 1), ("other", None)]


def test_dimension_faults(spark):
    h = spark.createDataFrame([("a", "m1", "z", True, 1.0, 2.0), ("a", "m2", "z", False, 1.0, 0.0), ("b", "m2", "q", False, 1.0, 3.0)], "household_id string, meter_id string, grid_zone string, has_solar boolean, base_load_kw double, solar_capacity_kw double")
    z = spark.createDataFrame([("z", "Z", 1.0, 0.0)], "grid_zone string, name string, capacity_kw double, latitude_deg double")
    assert {tuple(r) for r in clean.dimension_faults(h, z).collect()} == {("duplicate_household", "a"), ("duplicate_meter", "m2"), ("unknown_zone", "b"), ("solar_flag_mismatch", "b")}


def test_windows_are_half_open_and_shares_null_safe(spark):
    rows = [("z", "a", 1.0, 0.5, datetime(2026, 1, 14)), ("z", "a", 1.0, 2.5, datetime(2026, 1, 14, 4, 47, 59)), ("z", "b", 3.0, 0.0, datetime(2026, 1, 14, 4, 48)), ("dark", "c", 0.0, 0.0, datetime(2026, 1, 14)), (None, "d", 9.0, 9.0, datetime(2026, 1, 14)), ("z", "d", 9.0, 9.0, None)]
    df = spark.createDataFrame(rows, "grid_zone string, household_id string, power_consumption_kwh double, solar_generation_kwh double, event_at timestamp").withColumn("is_late", F.lit(False))
    out = {(r.grid_zone, r.window_start.hour): r for r in zones.zone_load(df).collect()}
    assert set(out) == {("z", 0), ("z", 4), ("dark", 0)}
    assert (out["z", 0].total_consumption_kwh, out["z", 0].renewable_pct, out["z", 0].active_meter_count) == (Decimal("2.000000"), Decimal("100.000"), 1)
    assert out["z", 4].renewable_pct == 0 and out["dark", 0].renewable_pct is None


def test_serving(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 2, 7), ("b", None, 1)], "k string, t int, u int")
    assert {tuple(r) for r in serving.latest_per(df, ["k"], ["t", "u"]).collect()} == {("a", 2, 7), ("b", None, 1)}
    assert [r.u for r in serving.newest(df.filter("k = 'a'"), "u", 2, "k").collect()] == [6, 7]
    assert [r.u for r in serving.top(df, "t", 3, "u").collect()] == [6, 7, 5]
    assert serving.optionally(df, "k").count() == 4 and serving.optionally(df, "k", "a").count() == 3
    other = spark.createDataFrame([("b", 9, 9), ("c", 9, 9)], df.schema)
    assert {(r.k, r.source) for r in serving.with_fallback(df.filter("u = 7 or k = 'b'"), other, ["k"]).collect()} == {("a", "first"), ("b", "first"), ("c", "second")}
    alerts = spark.createDataFrame([(1, None), (2, 5)], "id int, resolved_at int")
    assert serving.unresolved(alerts, "open").count() == 1 and serving.unresolved(alerts).count() == 2
    counter = spark.createDataFrame([("x", 1, 5), ("x", 2, 9), ("x", 3, 2)], "s string, t int, v int")
    assert [r.increase for r in serving.counter_delta(counter, ["s"], "t", "v").orderBy("t").collect()] == [0, 4, 2]
    df.createOrReplaceTempView("gridloom_there")
    assert serving.relation_exists(spark, "gridloom_there") and not serving.relation_exists(spark, "gridloom_not_there")


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_quantiles_are_exact(spark, width):
    rng = random.Random(width)
    rows = [(k, rng.choice([rng.randrange(-50, 50), 7])) for k in ("a", "b", "one", None) for _ in range(1 if k == "one" else 101 if k == "a" else 64)] + [("a", None)]
    out = serving.quantiles(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, width).collect()
    assert {r.k for r in out} == {"a", "b", "one"}
    for r in out:
        v = np.array([v for k, v in rows if k == r.k and v is not None])
        assert [r.p0, r.p50, r.p95, r.p100] == pytest.approx([np.quantile(v, q) for q in (0, 0.5, 0.95, 1)])


def test_alert_predicates(spark):
    last = spark.createDataFrame([("x", 10), ("y", 95), ("z", None)], "label string, last_at bigint")
    assert {tuple(r) for r in quality.behind(last, "lag", F.lit(100), 20).collect()} == {("lag", "x"), ("lag", "z")}
    days = spark.createDataFrame([("d1",), ("d2",)], "d string")
    gone = quality.missing(days, days.filter("d = 'd1'"), "d", "missed_report")
    assert [tuple(r) for r in quality.all_alerts([gone, gone]).collect()] == [("missed_report", "d2")] * 2


def test_gates(spark):
    seen, expected = spark.range(94), spark.range(100)
    with pytest.raises(quality.GateFailed):
        quality.enforce(quality.coverage(seen, expected, "id"))
    quality.enforce(quality.coverage(spark.range(95), expected, "id"))
    quality.enforce(quality.coverage(spark.range(0), spark.range(0), "id"))
    rows = spark.range(100).select(F.when(F.col("id") < 3, "x").alias("rejection_reason"))
    with pytest.raises(quality.GateFailed):
        quality.enforce(quality.reject_rate(rows))
    d = spark.createDataFrame([(1.0, 0.5, 0.5), (-1.0, 0.0, -1.0), (1.0, 0.1, 5.0)], "consumption_kwh double, solar_kwh double, net_grid_kwh double")
    r = quality.coherence(d).first()
    assert (r.negative_count, r.net_above_count, r.net_off_count, r.passed) == (1, 1, 1, False)


def test_versions(spark):
    bills = spark.createDataFrame([("a", "d1", 1, 5, True), ("b", "d1", 1, 6, True), ("a", "d2", 1, 7, True)], "h string, d string, version int, net int, is_current boolean")
    out = quality.issue(bills, spark.createDataFrame([("a", "d1", 8), ("c", "d1", 9)], "h string, d string, net int"), ["h", "d"], ["d"])
    assert {tuple(r) for r in out.collect()} == {
        ("a", "d1", 1, 5, False), ("b", "d1", 1, 6, False), ("a", "d2", 1, 7, True),
        ("a", "d1", 2, 8, True), ("c", "d1", 2, 9, True), ("b", "d1", 2, 6, True),
    }
    assert quality.current_versions_off(out, ["h", "d"]).count() == 0
    first = quality.issue(bills.filter("false"), spark.createDataFrame([("a", "d1", 8)], "h string, d string, net int"), ["h", "d"], ["d"])
    assert [tuple(r) for r in first.collect()] == [("a", "d1", 1, 8, True)]
    assert {r.h for r in quality.differing(out.filter("version = 1"), out.filter("version = 2"), ["h", "d"], ["net"]).collect()} == {"a"}


def test_clock_and_time_budget(spark):
    c = Clock(datetime(2026, 1, 1, tzinfo=timezone.utc), datetime(2026, 6, 1, tzinfo=timezone.utc), 288)
    t = datetime(2026, 6, 1, 0, 5, tzinfo=timezone.utc)
    assert c.to_sim(t) == datetime(2026, 1, 2, tzinfo=timezone.utc) and c.to_real(c.to_sim(t)) == t
    real = int(t.timestamp() * 1e6)
    assert spark.range(1).select(c.sim_column(F.lit(real))).first()[0] == int(c.to_sim(t).timestamp() * 1e6)
    for ratio in (288.0, 1440.0):
        TimeBudget(ratio).check()
        with pytest.raises(ValueError):
            TimeBudget(ratio, records_per_batch=20_000).check()
    with pytest.raises(ValueError):
        TimeBudget(window_real_minutes=0.1).check()
    assert TimeBudget().span == 96 and TimeBudget().watermark == 576 and TimeBudget().window == 288


def test_generated_readings_and_faults(spark):
    df = generators.generate(spark, 40, 72, 1_741_000_000_000_000).cache()
    assert df.exceptAll(generators.generate(spark, 40, 72, 1_741_000_000_000_000).repartition(3)).count() == 0
    assert df.filter("power_consumption_kwh <= 0 or solar_generation_kwh < 0 or solar_generation_kwh > solar_capacity_kw").count() == 0
    assert df.filter("substring(event_timestamp, 12, 2) in ('22', '23', '00', '03') and solar_generation_kwh > 0").count() == 0
    bad = generators.inject(df, 2)
    n = {r.fault: r["count"] for r in bad.groupBy("fault").count().collect()}
    assert set(n) == {None, "null_field", "negative", "solar_spike", "future", "late"} and n[None] > 0.97 * df.count()
    assert bad.count() > df.count() and bad.filter("fault = 'negative' and power_consumption_kwh >= 0").count() == 0
    assert generators.without_dropouts(df, 0.2).count() < 0.9 * df.count()
    curve = spark.range(24).select(generators.load_factor(F.col("id").cast("double")), generators.solar_factor(F.col("id").cast("double"))).collect()
    assert max(range(24), key=lambda h: curve[h][0]) == 19 and curve[12][1] == pytest.approx(1) and curve[3][1] == 0
