"""Queries of the engine's own operators over the whole smart-meter tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.contracts import CLEAN_READING, READING
from gridloom.functions.timeparse import DAY, HOUR, SECOND, bucket_of, floor_to, micros, micros_text
from gridloom.operators import clean, quality, serving, zones
from gridloom.operators.changefeed import operation
from gridloom.operators.dedup import first_copies
from gridloom.simtime import Clock
from gridloom.plans.problems import ROW, readings, table, tariff_changes

REQUIRED = ("event_id", "household_id", "grid_zone", "power_consumption_kwh", "solar_generation_kwh", "at", "sim_date")
COLUMNS = [*READING.names, "at", "emitted"]


def _at(c: str):
    return F.timestamp_micros(F.col(c))


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings, each message once, with event_at (timestamp)."""
    return first_copies(readings(spark, sf_dir), "event_id", F.col("emitted"), ROW, COLUMNS).withColumn("event_at", _at("at"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their household's dimension and rejection_reason. A reading's own publication instant stands for the present, so that a replay judges alike."""
    dim = clean.dimension(table(spark, sf_dir, "households"), table(spark, sf_dir, "zones"))
    return clean.join_dimension(messages(spark, sf_dir), dim).withColumn("rejection_reason", clean.rejection_reason(_at("emitted"), REQUIRED))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid readings, enriched."""
    return clean.enrich(clean.split(judged(spark, sf_dir))[0]).withColumn("is_late", zones.is_late(F.col("emitted"), F.col("at")))


def dedupe_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.concat_ws(":", F.col("log_partition").cast("string"), F.col("log_offset").cast("string"))
    return messages(spark, sf_dir).select(*ROW, clean.dedupe_key(F.col("event_id"), place).alias("dedupe_key"))


def parsed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as JSON texts, parsed again against the contract."""
    raw = table(spark, sf_dir, "meter_readings_v1").select(*ROW, F.to_json(F.struct(*READING.names)).alias("value"))
    parsed = clean.parse(raw)
    return parsed.select(*ROW, "event_id", "power_consumption_kwh", "solar_generation_kwh", "schema_version")


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy(F.coalesce("rejection_reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def valid_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.split(judged(spark, sf_dir))[0].select(*ROW, "event_id", "household_id")


def dlq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead letters, with what their payload, the original record, says."""
    rejected = clean.split(judged(spark, sf_dir))[1].withColumn("raw_value", F.to_json(F.struct(*READING.names)))
    letters = clean.dead_letters(rejected, "clean", F.col("producer_emitted_at"))
    payload = F.from_json("original_payload", READING)
    said = ["event_id", "meter_id", "household_id", "grid_zone", "power_consumption_kwh", "solar_generation_kwh", "event_timestamp", "sim_date", "producer_emitted_at"]
    return letters.select("rejection_reason", "rejected_at", "job_name", "correlation_id", "schema_version", *[payload[c].alias("original_" + c) for c in said])


def enriched_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = valid(spark, sf_dir)
    return out.select(*ROW, F.round("net_grid_kwh", 6).alias("net_grid_kwh"), "is_exporting", F.round("self_consumption_kwh", 6).alias("self_consumption_kwh"), "time_of_day_bucket", "zone_name", "is_late")


def clean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the clean log: their key, and what their value says."""
    m = clean.clean_message(valid(spark, sf_dir)).withColumn("_v", F.from_json("value", CLEAN_READING))
    numbers = [F.round(F.col("_v")[c], 6).alias(c) for c in ("net_grid_kwh", "self_consumption_kwh")]
    return m.select("key", *[F.col("_v")[c].alias(c) for c in ("event_id", "meter_id", "household_id", "power_consumption_kwh", "solar_generation_kwh", "is_exporting", "zone_name", "time_of_day_bucket", "event_timestamp")], *numbers)


def bucket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid(spark, sf_dir).groupBy("time_of_day_bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(zones.kwh(F.col("power_consumption_kwh"))).cast("decimal(38,6)").alias("consumption_kwh"), F.count_if("is_exporting").alias("exporting_count"))


def _zone_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.zone_load(valid(spark, sf_dir))


def zone_load_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zone_load(spark, sf_dir).withColumns({"window_start": _text("window_start"), "window_end": _text("window_end")})


def approx_active_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate count of active meters next to the exact one, and whether it is within four standard errors (5 % each) or one meter."""
    rows = valid(spark, sf_dir)
    both = rows.groupBy(F.window("event_at", zones.WINDOW), "grid_zone").agg(F.approx_count_distinct("household_id").alias("a"), F.count_distinct("household_id").alias("exact_count"))
    return both.select("grid_zone", _text("window.start").alias("window_start"), "exact_count", (F.abs(F.col("a") - F.col("exact_count")) <= F.greatest(F.lit(1.0), 0.2 * F.col("exact_count"))).alias("within_error"))


def late_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = valid(spark, sf_dir).groupBy("grid_zone").agg(F.count_if("is_late").alias("late_count"), F.count(F.lit(1)).alias("n_rows"))
    return out


def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zones.running_totals(valid(spark, sf_dir))


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running(spark, sf_dir)


def _tariffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest tariff of each household and day; one that was deleted last is none."""
    feed = tariff_changes(spark, sf_dir).filter("household_id is not null and effective is not null").withColumn("op", operation(F.col("op")))
    # log_offset breaks ties
    return serving.latest_per(feed, ["household_id", "sim_date"], ["effective", "source_seq", "log_offset"]).filter("op <> 'd'")


def latest_tariff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tariffs(spark, sf_dir).select("household_id", "sim_date", "log_offset", "tariff_rate", "billing_tier", "subsidy_flag")


def _running_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tariffs(spark, sf_dir).select("household_id", "sim_date", F.col("tariff_rate").try_cast("decimal(10,4)").alias("tariff_rate"), "billing_tier")
    return clean.join_dimension(_running(spark, sf_dir), t, ["household_id", "sim_date"]).withColumn("tariff_missing", F.col("tariff_rate").isNull())


def running_with_tariff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running_rated(spark, sf_dir).select("household_id", "sim_date", "consumption_kwh", "tariff_rate", "billing_tier", "tariff_missing")


def unpriced_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running_rated(spark, sf_dir).groupBy("sim_date").agg(F.count(F.lit(1)).alias("n_rows"), F.count("tariff_rate").alias("priced_count"), F.count_if("tariff_missing").alias("unpriced_count"))


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "zone_load_1m")


def latest_zone_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serving.latest_per(_published(spark, sf_dir), ["grid_zone"], ["window_start"])
    return out.select("grid_zone", _text("window_start").alias("window_start"), "total_consumption_kwh", "renewable_pct", "active_meter_count")


def zone_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 windows of each zone."""
    return serving.newest_per(_published(spark, sf_dir), ["grid_zone"], "window_start", 50).select("grid_zone", _text("window_start").alias("window_start"), "total_consumption_kwh", "total_solar_kwh")


def grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the latest window of each zone: the share of sums, not the mean of shares."""
    last = serving.latest_per(_published(spark, sf_dir), ["grid_zone"], ["window_start"])
    out = last.agg(F.sum("total_consumption_kwh").cast("decimal(38,6)").alias("consumption_kwh"), F.sum("total_solar_kwh").cast("decimal(38,6)").alias("solar_kwh"), F.count(F.lit(1)).alias("zone_count"), F.sum("active_meter_count").alias("meter_count"))
    return out.withColumn("renewable_pct", zones.renewable_pct(F.col("consumption_kwh"), F.col("solar_kwh")))


def top_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 households with the greatest net consumption of the latest day."""
    first = _running(spark, sf_dir).orderBy(F.col("sim_date").desc(), F.col("net_grid_kwh").desc_nulls_last(), "household_id").limit(20)
    # of these few rows, those of the latest day
    return first.withColumn("_last", F.max("sim_date").over(Window.partitionBy())).filter("sim_date = _last").select("household_id", "sim_date", "net_grid_kwh")


def bill_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of all bills."""
    return table(spark, sf_dir, "household_billing_daily").select("household_id", F.col("sim_date").cast("string").alias("sim_date"), "version", "net_grid_kwh", "final_bill", "is_current")


def bill_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net consumption of each household and day: of the issued bill if there is one, else of the running totals."""
    issued = table(spark, sf_dir, "household_billing_daily").filter("is_current").select("household_id", F.col("sim_date").cast("string").alias("sim_date"), F.col("net_grid_kwh").cast("decimal(28,6)").alias("net_grid_kwh"))
    return serving.with_fallback(issued, _running(spark, sf_dir).select("household_id", "sim_date", "net_grid_kwh"), ["household_id", "sim_date"])


def latest_day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    bills = table(spark, sf_dir, "household_billing_daily").filter("is_current")
    bills.createOrReplaceTempView("gridloom_current_bills")
    return spark.sql("select household_id, cast(sim_date as string) as sim_date, consumption_kwh from gridloom_current_bills where sim_date = (select max(sim_date) from gridloom_current_bills)")


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.freshness(_published(spark, sf_dir), "window_start", "updated_at").withColumns({"last_window": _text("last_window"), "last_update": _text("last_update")})


def day_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published windows of the last half-open day that has any."""
    p = _published(spark, sf_dir)
    return serving.on_day(p, "window_start", p.agg(F.to_date(F.max("window_start"))).scalar()).select("grid_zone", _text("window_start").alias("window_start"), "total_consumption_kwh")


def window_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _published(spark, sf_dir)
    types = dict(p.dtypes)
    span = (micros(F.col("window_end"), types["window_end"]) - micros(F.col("window_start"), types["window_start"])) / (60 * SECOND)
    return p.groupBy(span.cast("double").alias("span_minutes")).agg(F.count(F.lit(1)).alias("n_rows"))


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(_running(spark, sf_dir), table(spark, sf_dir, "households"), "household_id")


def coherence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coherence(table(spark, sf_dir, "household_billing_daily"))


def reject_rate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reject_rate(judged(spark, sf_dir))


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that the raw log has more than once, as written."""
    return quality.repeated_keys(table(spark, sf_dir, "meter_readings_v1").filter("event_id is not null"), ["event_id"])


def current_version_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.current_versions_off(table(spark, sf_dir, "household_billing_daily").withColumn("sim_date", F.col("sim_date").cast("string")), ["household_id", "sim_date"])


def version_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "household_billing_daily").groupBy("version").agg(F.bool_and("is_current").alias("all_current"), F.count_distinct("household_id").alias("n_households"), F.count(F.lit(1)).alias("n_rows"))


def null_iff_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills of which only one of rate and effective rate is null though something was consumed."""
    b = table(spark, sf_dir, "household_billing_daily")
    return b.filter(F.col("tariff_rate").isNull() != F.col("gross_cost").isNull()).agg(F.count(F.lit(1)).alias("n_rows"))


def settled_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Household days whose first and current versions differ in energy or rate."""
    b = table(spark, sf_dir, "household_billing_daily").withColumn("sim_date", F.col("sim_date").cast("string"))
    return quality.differing(b.filter("version = 1"), b.filter("is_current"), ["household_id", "sim_date"], ["net_grid_kwh", "tariff_rate"])


def low_renewable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.low_renewable(_published(spark, sf_dir)).select("grid_zone", _text("window_start").alias("window_start"), "renewable_pct")


def zone_overload(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.overloaded(_published(spark, sf_dir), table(spark, sf_dir, "zones"))
    return out.select("grid_zone", _text("window_start").alias("window_start"), F.round("mean_kw", 6).alias("mean_kw"), "capacity_kw")


def _latest_event(log: DataFrame):
    """The latest event time that is not ahead of publication."""
    return log.agg(F.max(F.when(F.col("at") <= F.col("emitted"), F.col("at")))).scalar()


def _silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meters that were silent for six hours at the latest event."""
    log = readings(spark, sf_dir)
    seen = log.filter("meter_id is not null").groupBy("meter_id").agg(F.max("at").alias("last_at"))
    return quality.silent(seen, table(spark, sf_dir, "households"), "meter_id", _latest_event(log), 6 * HOUR)


def meter_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silent(spark, sf_dir).select("meter_id", micros_text(F.col("last_at")).alias("last_at"))


def inhibited_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-renewable alerts, but for zones that are overloaded at the same time."""
    return quality.inhibited(low_renewable(spark, sf_dir), zone_overload(spark, sf_dir), ["grid_zone", "window_start"]).select("grid_zone", "window_start")


def offset_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of each log partition from batch to batch: a counter's increase."""
    ends = table(spark, sf_dir, "meter_readings_v1").groupBy("log_partition", "batch_id").agg(F.max("log_offset").alias("end_offset"))
    return serving.counter_delta(ends, ["log_partition"], "batch_id", "end_offset")


def batch_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of delay by log partition (exact)."""
    r = readings(spark, sf_dir).select("log_partition", (F.col("emitted") - F.col("at")).alias("delay"))
    out = serving.quantiles(r, ["log_partition"], "delay", {"p50_s": 0.5, "p95_s": 0.95}, 60 * SECOND)
    return out.select("log_partition", *[F.round(F.col(n) / SECOND, 3).alias(n) for n in ("p50_s", "p95_s")])


def households_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "households").groupBy("grid_zone").agg(F.count(F.lit(1)).alias("n_households"), F.count_if("has_solar").alias("with_solar"), F.sum(F.col("solar_capacity_kw").cast("decimal(18,3)")).cast("decimal(38,3)").alias("capacity_kw"))


def dimension_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dimension_faults(table(spark, sf_dir, "households"), table(spark, sf_dir, "zones"))


def distinct_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "meter_readings_v1").select("sim_date").distinct()


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log delivered twice (a union), counted by zone before and after deduplication."""
    log = readings(spark, sf_dir)
    both = log.unionByName(log.withColumn("log_offset", F.col("log_offset") + 10**12)).filter("event_id is not null")
    n = both.groupBy("grid_zone").agg(F.count(F.lit(1)).alias("n_rows"))
    kept = first_copies(both, "event_id", F.col("emitted"), ROW, ["grid_zone"]).groupBy("grid_zone").agg(F.count(F.lit(1)).alias("n_messages"))
    return n.alias("n").join(kept.alias("k"), F.col("n.grid_zone").eqNullSafe(F.col("k.grid_zone"))).select("n.grid_zone", "n_rows", "n_messages")


def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "household_billing_daily").groupBy(F.col("sim_date").cast("string").alias("sim_date")).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def latest_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.latest_version(table(spark, sf_dir, "household_billing_daily"), ["household_id", "sim_date"]).select("household_id", F.col("sim_date").cast("string").alias("sim_date"), "version", "net_grid_kwh", "is_current")


def restated_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bill table after its last day is issued again from the running totals."""
    bills = table(spark, sf_dir, "household_billing_daily").withColumn("sim_date", F.col("sim_date").cast("string")).select("household_id", "sim_date", "version", F.col("net_grid_kwh").cast("decimal(28,6)").alias("net_grid_kwh"), "is_current")
    day = _running(spark, sf_dir).filter(F.col("sim_date") == bills.agg(F.max("sim_date")).scalar()).select("household_id", "sim_date", "net_grid_kwh")
    return quality.issue(bills, day, ["household_id", "sim_date"], ["sim_date"])


def ready_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with issued bills and published load, with their counts."""
    bills = table(spark, sf_dir, "household_billing_daily").filter("is_current").groupBy("sim_date").agg(F.count(F.lit(1)).alias("bill_count"))
    load = _published(spark, sf_dir).groupBy(F.to_date("window_start").alias("sim_date")).agg(F.count(F.lit(1)).alias("window_count"))
    return bills.join(load, "sim_date").select(F.col("sim_date").cast("string").alias("sim_date"), "bill_count", "window_count")


def unbilled_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Household days with running totals but no bill."""
    bills = table(spark, sf_dir, "household_billing_daily").select("household_id", F.col("sim_date").cast("string").alias("sim_date"))
    return _running(spark, sf_dir).join(bills, ["household_id", "sim_date"], "left_anti").groupBy("sim_date").agg(F.count(F.lit(1)).alias("n_households"))


def daily_zone_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per zone and day: totals, the plain mean of the windows' shares and the share weighted by energy."""
    p = _published(spark, sf_dir).groupBy("grid_zone", F.to_date("window_start").cast("string").alias("day"))
    out = p.agg(
        F.sum("total_consumption_kwh").cast("decimal(38,6)").alias("consumption_kwh"), F.sum("total_solar_kwh").cast("decimal(38,6)").alias("solar_kwh"), F.round(F.avg(F.col("renewable_pct").cast("double")), 4).alias("mean_pct"), F.max("active_meter_count").alias("most_meters")
    )
    return out.withColumn("weighted_pct", zones.renewable_pct(F.col("consumption_kwh"), F.col("solar_kwh")))


def hourly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and zones' energy by hour of the day."""
    return valid(spark, sf_dir).groupBy(F.hour("event_at").alias("hour_of_day")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(zones.kwh(F.col("net_grid_kwh"))).cast("decimal(38,6)").alias("net_grid_kwh"))


def sim_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication instants on a simulated axis that starts with the year and runs 288 times as fast from 2025-03-03 on."""
    clock = Clock(datetime(2025, 1, 1, tzinfo=timezone.utc), datetime(2025, 3, 3, tzinfo=timezone.utc), 288)
    return readings(spark, sf_dir).select(*ROW, micros_text(clock.sim_column(F.col("emitted"))).alias("sim_at"))


def prefix_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of correlation ids with a prefix, published in the two days before that of the latest event, by zone."""
    r = readings(spark, sf_dir)
    end = floor_to(_latest_event(r), DAY)
    some = r.filter(F.col("correlation_id").startswith("c-0") & (F.col("emitted") >= end - 2 * DAY) & (F.col("emitted") < end))
    return some.groupBy("grid_zone").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("correlation_id").alias("n_ids"))


def target_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day to work on: the one before the latest."""
    last = table(spark, sf_dir, "meter_readings_v1").agg(F.max(F.expr("try_cast(sim_date as date)")).alias("d"))
    return last.select(F.date_sub("d", 1).cast("string").alias("day"))


def household_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dimension(table(spark, sf_dir, "households"), table(spark, sf_dir, "zones"))


def unreported_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which readings say they were taken but for which no bill was issued."""
    bills = table(spark, sf_dir, "household_billing_daily").select(F.col("sim_date").cast("string").alias("sim_date"))
    return table(spark, sf_dir, "meter_readings_v1").select("sim_date").filter("sim_date is not null").distinct().join(bills, "sim_date", "left_anti")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over the events table by customer region."""
    ev = table(spark, sf_dir, "events")
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    where = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("c_custkey").alias("user_id"), "r_name")
    out = clean.join_dimension(ev, where, "user_id").groupBy(F.window("ts", "288 minutes"), "r_name")
    return out.agg(F.sum(F.col("value").cast("decimal(18,6)")).cast("decimal(28,6)").alias("total_value"), F.count_distinct("user_id").alias("n_users")).select("r_name", _text("window.start").alias("window_start"), "total_value", "n_users")


def lineitem_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk aggregation by flag and line status, with exact sums."""
    d = lambda c: F.col(c).cast("decimal(18,2)")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(d("l_quantity")).cast("decimal(38,2)").alias("sum_qty"), F.sum(d("l_extendedprice")).cast("decimal(38,2)").alias("sum_price"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_orders"))


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest-wins reduction of an append-only history: each customer's newest order."""
    return serving.latest_per(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", _text("o_orderdate").alias("o_orderdate"))


def pipeline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per dataset of the pipeline: its rows and its newest instant."""
    log, bills, load = readings(spark, sf_dir), table(spark, sf_dir, "household_billing_daily"), _published(spark, sf_dir)
    tariffs = tariff_changes(spark, sf_dir)
    of = lambda df, name, at: df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n_rows"), F.max(at).alias("newest"))
    parts = [of(log, "readings", F.col("emitted")), of(bills, "bills", micros(F.col("generated_at"), dict(bills.dtypes)["generated_at"])), of(load, "zone_load", micros(F.col("updated_at"), dict(load.dtypes)["updated_at"])), of(tariffs, "tariffs", F.col("published"))]
    return serving.status(parts).withColumn("newest", micros_text(F.col("newest")))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fires when the log's last message was published: datasets without news for a day, partitions that lag behind, days without a report, and a stalled tariff feed."""
    log, load, bills = readings(spark, sf_dir), _published(spark, sf_dir), table(spark, sf_dir, "household_billing_daily")
    now = log.agg(F.max("emitted")).scalar()
    ends = log.groupBy("log_partition").agg(F.max("emitted").alias("last_at")).select(F.col("log_partition").cast("string").alias("label"), "last_at")
    newest = load.agg(F.max(micros(F.col("updated_at"), dict(load.dtypes)["updated_at"])).alias("last_at")).select(F.lit("zone_load").alias("label"), "last_at")
    tariffs = tariff_changes(spark, sf_dir).agg(F.max("published").alias("last_at")).select(F.lit("tariffs").alias("label"), "last_at")
    days = log.filter("at is not null and emitted >= at").select(F.date_from_unix_date(bucket_of(F.col("at"), DAY).cast("int")).alias("sim_date")).distinct()
    parts = [quality.behind(newest, "no_data", now, DAY), quality.behind(ends, "lag", now, 2 * HOUR), quality.behind(tariffs, "tariff_stalled", now, DAY), quality.missing(days, bills.select("sim_date"), "sim_date", "missed_report")]
    return quality.all_alerts(parts)


QUERIES = {
    f.__name__: f
    for f in (
        parsed_readings, dedupe_readings, reject_reasons, valid_readings, dlq_records, enriched_readings, clean_messages, bucket_totals,
        zone_load_tumbling, approx_active_meters, late_event_counts, running_totals, latest_tariff, running_with_tariff, unpriced_by_day,
        latest_zone_load, zone_timeseries, grid_summary, top_consumers, bill_versions, bill_with_fallback, latest_day_panel, freshness, day_load, window_spans,
        coverage_gate, coherence_gate, reject_rate_gate, duplicate_keys, current_version_faults, version_currency, null_iff_missing, settled_diff,
        low_renewable, zone_overload, meter_silent, inhibited_alerts, offset_rate, batch_percentiles, households_by_zone, dimension_faults, distinct_days,
        redelivered, next_versions, latest_bills, restated_bills, ready_days, unbilled_backlog, daily_zone_report, hourly_profile, event_windows, lineitem_totals, latest_order,
        sim_clock, prefix_window, target_day, household_dimension, unreported_days, pipeline_status, alerts,
    )
}
