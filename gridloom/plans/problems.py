"""Queries of problems 1 to 6 over the smart-meter tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.timeparse import DAY, HOUR, SECOND, bucket_of, iso_micros, micros, micros_text
from gridloom.operators.anomalies import implausible
from gridloom.operators.asof import attach_as_known
from gridloom.operators.changefeed import advance, apply_changes, distinct_changes, standing
from gridloom.operators.dedup import first_copies, later_copies
from gridloom.operators.lateness import windows_to_correct
from gridloom.operators.regrid import regular_grid
from gridloom.session import scratch
from gridloom.store.quotients import QuotientTables
from gridloom.streaming.lambda_store import LambdaStore

ROW = ["log_offset", "log_partition"]
WINDOW = 288 * 60 * SECOND
CUTOFF = 6 * HOUR
SUMS = {"total_consumption_kwh": "power_consumption_kwh", "total_solar_kwh": "solar_generation_kwh"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros_of(df: DataFrame, name: str):
    return micros(F.col(name), dict(df.dtypes)[name])


def tariff_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tariff feed with times in microseconds: effective, published."""
    feed = table(spark, sf_dir, "tariff_reference_v1")
    return feed.withColumn("effective", iso_micros(F.col("effective_from"))).withColumn("published", _micros_of(feed, "published_at"))


def bills_with_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bill with the tariff rate that was known for its day when it was made."""
    bills = table(spark, sf_dir, "household_billing_daily")
    events = bills.select("household_id", "sim_date", "version", "tariff_rate", _micros_of(bills, "sim_date").alias("day_start"), _micros_of(bills, "generated_at").alias("made"))
    # the earliest delivery of a change is the one that made it known
    changes = distinct_changes(tariff_changes(spark, sf_dir), "household_id", "op", "effective", "source_seq", ["published", "log_offset"], ["op", "tariff_rate"])
    rates = changes.select("household_id", "effective", "source_seq", "published", F.when(F.col("op") != "d", F.col("tariff_rate")).try_cast("decimal(14,4)").alias("right_rate"))
    return attach_as_known(events, rates, "household_id", "day_start", "made", "effective", "source_seq", "published", ["right_rate"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills whose rate differs at four decimals from the one known when they were made."""
    off = ~F.col("tariff_rate").cast("decimal(14,4)").eqNullSafe(F.col("right_rate"))
    return bills_with_rate(spark, sf_dir).filter(off).select("household_id", F.col("sim_date").cast("string").alias("sim_date"), "version")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bill with its rate and the right one."""
    return bills_with_rate(spark, sf_dir).select("household_id", F.col("sim_date").cast("string").alias("sim_date"), "version", F.col("tariff_rate").cast("decimal(14,4)").alias("billed_rate"), "right_rate")


_FEED = ("household_id", "op", "effective", "source_seq", ["log_offset"], ["tariff_rate", "billing_tier", "subsidy_flag"])


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tariffs that hold after the whole feed."""
    return apply_changes(tariff_changes(spark, sf_dir), *_FEED).drop("effective")


def p2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, the feed applied in three deliveries of which the latest comes first: late changes meet tombstones."""
    feed = tariff_changes(spark, sf_dir)
    third = F.ntile(3).over(Window.partitionBy("household_id").orderBy(F.col("source_seq").desc(), "log_offset"))
    feed = feed.withColumn("_part", third)
    state = None
    for k in (1, 2, 3):
        state = advance(state, feed.filter(F.col("_part") == k), *_FEED)
    return standing(state, "op").select("household_id", "source_seq", "tariff_rate", "billing_tier", "subsidy_flag")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Household and number of the change that stands, of each household with a tariff."""
    return p2_table(spark, sf_dir).select("household_id", "source_seq")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of readings with event time (at) and publication time (emitted) in microseconds."""
    return table(spark, sf_dir, "meter_readings_v1").withColumn("at", iso_micros(F.col("event_timestamp"))).withColumn("emitted", iso_micros(F.col("producer_emitted_at")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours without a reading on the days on which the meter has one."""
    grid = regular_grid(readings(spark, sf_dir), "meter_id", "at", "power_consumption_kwh")
    return grid.filter("in_use and readings = 0").select("meter_id", micros_text(F.col("cell_start")).alias("slot_start"))


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly series of consumption of each meter, copies taken out."""
    log = readings(spark, sf_dir)
    kept = first_copies(log, "event_id", F.col("emitted"), ROW, ["meter_id", "at", "power_consumption_kwh"])
    grid = regular_grid(kept, "meter_id", "at", "power_consumption_kwh")
    return grid.select("meter_id", micros_text(F.col("cell_start")).alias("slot_start"), F.round("amount", 6).alias("kwh"), "readings", (F.col("covered") / SECOND).cast("bigint").alias("covered_s"), "status")


def p3_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly series from a cumulative register: whole Wh counted up by each meter, which starts anew every day (a reset)."""
    log = readings(spark, sf_dir)
    kept = first_copies(log, "event_id", F.col("emitted"), ROW, ["meter_id", "at", "power_consumption_kwh"]).filter("meter_id is not null and at is not null and power_consumption_kwh > 0")
    day = bucket_of(F.col("at"), DAY)
    upto = Window.partitionBy("meter_id", day).orderBy("at", *ROW).rowsBetween(Window.unboundedPreceding, 0)
    register = kept.withColumn("register_wh", F.sum(F.round(F.col("power_consumption_kwh") * 1000).cast("bigint")).over(upto))
    last = register.groupBy("meter_id", "at").agg(F.max("register_wh").alias("register_wh"))  # one state of the register at an instant
    grid = regular_grid(last, "meter_id", "at", "register_wh", counter=True)
    return grid.select("meter_id", micros_text(F.col("cell_start")).alias("slot_start"), F.round("amount", 6).alias("wh"), "readings", (F.col("covered") / SECOND).cast("bigint").alias("covered_s"), "status", "cells", "in_use")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are not the kept copy of their message."""
    log = table(spark, sf_dir, "meter_readings_v1").withColumn("emitted", iso_micros(F.col("producer_emitted_at")))
    return later_copies(log, "event_id", F.col("emitted"), ROW).select("log_partition", "log_offset")


def p4_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from quotient tables that are kept between batches: the log inserted in two deliveries, then asked about."""
    log = table(spark, sf_dir, "meter_readings_v1").withColumn("emitted", iso_micros(F.col("producer_emitted_at")))
    tables = QuotientTables(spark, scratch(spark, "quotients"), {n: log.schema[n].dataType for n in ROW})
    low, high = log.agg(F.min("batch_id"), F.max("batch_id")).first()  # one row
    middle = ((low or 0) + (high or 0)) // 2
    early = F.coalesce(F.col("batch_id") <= F.lit(middle), F.lit(True))
    for k, part in enumerate((early, ~early)):
        tables.insert(log.filter(part), "event_id", F.col("emitted"), batch_id=k)
    return tables.later(log, "event_id", F.col("emitted")).select("log_partition", "log_offset")


def zone_views(spark: SparkSession, sf_dir: str) -> LambdaStore:
    """The Lambda views per zone and window as of the last message of the log."""
    log = readings(spark, sf_dir)
    store = LambdaStore(spark, scratch(spark, "views"), T.StructType([log.schema["grid_zone"]]), SUMS, WINDOW, CUTOFF)
    as_of = table(spark, sf_dir, "meter_readings_v1").agg(F.max(iso_micros(F.col("producer_emitted_at")))).first()[0]  # one row
    store.catch_up(log, as_of or 0)
    return store


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published windows that are off, and windows with counted readings that have no row."""
    published = table(spark, sf_dir, "zone_load_1m")
    published = published.withColumn("window_at", _micros_of(published, "window_start"))
    wrong = windows_to_correct(zone_views(spark, sf_dir).view(), published, ["grid_zone"], {n: n for n in SUMS}, 0.0005)
    return wrong.select("grid_zone", micros_text(F.col("window_at")).alias("window_start"))


def p5_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrected totals of each zone and window."""
    v = zone_views(spark, sf_dir).view()
    return v.select("grid_zone", micros_text(F.col("window_at")).alias("window_start"), *[F.col(n).cast("decimal(38,6)").alias(n) for n in SUMS], "counted")


def p6_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every implausible value and why."""
    return implausible(readings(spark, sf_dir), table(spark, sf_dir, "households"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every implausible value."""
    return p6_flags(spark, sf_dir).select("log_partition", "log_offset", "measure")


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_table, p2_incremental, p3_found, p3_grid, p3_counter, p4_found, p4_batches, p5_found, p5_views, p6_found, p6_flags)}
