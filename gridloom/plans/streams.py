"""Queries that run the streaming jobs and stores over the whole log: written to a scratch folder in the shared one, read back.

The log is laid out as files in order of arrival, and jobs run until it is used up. Watermarks are longer than any message is
late, so that the results are those of a batch over the same log in which a message's first copy is the one that arrived first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.contracts import CLEAN_READING, KEYS, READING
from gridloom.functions.timeparse import iso_micros, micros, micros_text
from gridloom.operators import clean
from gridloom.plans.problems import table
from gridloom.session import scratch
from gridloom.simtime import TimeBudget
from gridloom.sources.logs import clean_stream, event_time, stream_log, write_log
from gridloom.sources.sinks import PACKED, csv_report
from gridloom.store.keyed import KeyedTable
from gridloom.store.quotients import QuotientTables
from gridloom.streaming import run

_S, _I, _L, _TS, _D = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType(), T.DecimalType(38, 6)
ZONE_LOAD = T.StructType([T.StructField(n, t) for n, t in (("grid_zone", _S), ("window_start", _TS), ("window_end", _TS), ("total_consumption_kwh", T.DecimalType(28, 6)), ("total_solar_kwh", T.DecimalType(28, 6)), ("renewable_pct", T.DecimalType(6, 3)), ("active_meter_count", _I), ("late_event_count", _I))])
DAYS = T.StructType([T.StructField(n, t) for n, t in (("household_id", _S), ("sim_date", _S), ("consumption_kwh", _D), ("solar_kwh", _D), ("net_grid_kwh", _D))])
AUDIT = T.StructType([T.StructField(n, t) for n, t in (("run_id", _L), ("job_name", _S), ("stage", _S), ("n_rows", _L))])
LONG = "90 days"


#: Bytes of the log's tables, or of packed text, that one file of a scratch log holds at most, about; a packed file is read by one task.
FILE_BYTES = 8 << 20
CLEAN_FILE_BYTES = 32 << 20


def _raw_log(spark: SparkSession, sf_dir: str, at: str, batches: int = 3) -> DataFrame:
    """A stream of the raw log in so many micro-batches, each of as many files as its size asks for."""
    log = table(spark, sf_dir, "meter_readings_v1")
    each = max(1, -(-clean.source_bytes(log) // (batches * FILE_BYTES)))
    write_log(log, f"{at}/raw", READING.names, ["log_offset", "log_partition"], batches * each, **PACKED)
    return stream_log(spark, f"{at}/raw", max_files=each)


def _dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dimension(table(spark, sf_dir, "households"), table(spark, sf_dir, "zones"))


def _cleaned(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the cleaning job's outputs. The dimension is read anew in each micro-batch."""
    at = scratch(spark, "clean")
    run.clean_job(_raw_log(spark, sf_dir, at), lambda: _dimension(spark, sf_dir), f"{at}/out", f"{at}/cp", LONG).awaitTermination()
    return f"{at}/out"


def _clean_log(spark: SparkSession, sf_dir: str) -> str:
    """The clean messages as a log of their own (text lines), every one delivered twice."""
    out = _cleaned(spark, sf_dir)
    lines = spark.read.option("recursiveFileLookup", True).schema("key string, value string").json(f"{out}/clean").select("value")
    lines = lines.coalesce(max(1, -(-clean.source_bytes(lines) // CLEAN_FILE_BYTES)))  # a micro-batch has ten files, however small they are
    for _ in range(2):
        lines.write.mode("append").options(**PACKED).text(f"{out}/log")
    return f"{out}/log"


def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean log that the streaming job writes: whatever spelling an id has, its message is there once, and those without one are rejected, not lost."""
    m = spark.read.option("recursiveFileLookup", True).schema("key string, value string").json(f"{_cleaned(spark, sf_dir)}/clean")
    v = F.from_json("value", CLEAN_READING)
    return m.select("key", clean.message_id(v["event_id"]).alias("message"), *[v[c].alias(c) for c in ("household_id", "power_consumption_kwh", "solar_generation_kwh", "time_of_day_bucket", "zone_name")])


def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's dead letters, with what the original record says."""
    d = spark.read.option("recursiveFileLookup", True).schema("original_payload string, rejection_reason string, job_name string, correlation_id string").json(f"{_cleaned(spark, sf_dir)}/dead_letters")
    p = F.from_json("original_payload", T.StructType([*READING.fields, T.StructField("log_offset", _L)]))
    return d.select("rejection_reason", "job_name", "correlation_id", p["log_offset"].alias("log_offset"), p["household_id"].alias("household_id"), p["event_timestamp"].alias("event_timestamp"))


def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's rows by its folders (day and zone), and the job's own audit beside it."""
    a = spark.read.parquet(f"{_cleaned(spark, sf_dir)}/archive")
    return a.groupBy(F.col("sim_date").cast("string").alias("sim_date"), "grid_zone").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("household_id").alias("n_households"))


def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the job counted by reason, over all its batches."""
    rows = spark.read.option("recursiveFileLookup", True).schema("reason string, n_rows bigint").json(f"{_cleaned(spark, sf_dir)}/audit")
    return rows.groupBy("reason").agg(F.sum("n_rows").alias("n_rows"))


def stream_zone_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone windows merged as they change, from a clean log that brings every message twice."""
    log = _clean_log(spark, sf_dir)
    at = scratch(spark, "zones")
    target = KeyedTable(spark, f"{at}/zone_load", ZONE_LOAD, list(KEYS["zone_load"]))
    run.zone_job(clean_stream(spark, log, CLEAN_READING, ["event_timestamp", "grid_zone"]), target, f"{at}/cp", TimeBudget(watermark_real_minutes=450)).awaitTermination()
    return target.read().select("grid_zone", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "total_consumption_kwh", "total_solar_kwh", "renewable_pct", "late_event_count")


def stream_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by household and day, republished into a table cut by day, from the same log; the job is then replayed with a new checkpoint, which changes nothing."""
    log = _clean_log(spark, sf_dir)
    at = scratch(spark, "running")
    target = KeyedTable(spark, f"{at}/days", DAYS, ["household_id", "sim_date"], "sim_date")
    for checkpoint in ("cp", "again"):
        run.running_job(clean_stream(spark, log, CLEAN_READING, ["household_id"]), target, f"{at}/{checkpoint}", LONG).awaitTermination()
    return target.read().select("household_id", F.col("sim_date").alias("event_day"), "consumption_kwh", "solar_kwh")


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log through a stream that knows identifiers by quotient tables instead of a watermark."""
    at = scratch(spark, "once")
    stream = event_time(_raw_log(spark, sf_dir, at))
    run.once_job(stream, QuotientTables(spark, f"{at}/tables", {"log_offset": _L, "log_partition": _S}), f"{at}/out", f"{at}/cp").awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).schema("event_id string, household_id string, event_timestamp string").json(f"{at}/out")
    return rows.select(clean.message_id(F.col("event_id")).alias("message"), "household_id", micros_text(iso_micros(F.col("event_timestamp"))).alias("event_time"))


def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills merged version by version into a table of one row per household and day, its first rate kept; each merge is sent twice."""
    bills = table(spark, sf_dir, "household_billing_daily").withColumn("sim_date", F.col("sim_date").cast("string"))
    schema = T.StructType([T.StructField(n, t) for n, t in (("household_id", _S), ("sim_date", _S), ("version", _I), ("net_grid_kwh", T.DecimalType(18, 6)), ("tariff_rate", T.DecimalType(10, 4)))])
    target = KeyedTable(spark, f"{scratch(spark, 'bills')}/bills", schema, ["household_id", "sim_date"], "sim_date")
    for v in sorted(r[0] for r in bills.select("version").distinct().collect()):  # a few versions
        for _ in range(2):
            target.merge(bills.filter(F.col("version") == v), keep_first=("tariff_rate",), batch_id=v)
    target.vacuum()
    return target.read()


def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by run (a delivery of the log), job and stage; a stage that ran again has replaced its record."""
    log = table(spark, sf_dir, "meter_readings_v1").withColumn("run_id", F.col("batch_id"))
    target = KeyedTable(spark, f"{scratch(spark, 'audit')}/audit", AUDIT, list(KEYS["run_audit"]))
    stages = {"parsed": F.lit(True), "with_meter": F.col("meter_id").isNotNull(), "timed": F.col("event_timestamp").isNotNull()}
    first = {k: F.count_if(c) for k, c in stages.items()}
    for stage, figure in ({"parsed": F.lit(-1)} | {}).items():  # a run that broke off
        run.audit(target, log.groupBy("run_id").agg(F.first(figure).alias("n_rows")).withColumns({"job_name": F.lit("clean"), "stage": F.lit(stage)}))
    counted = log.groupBy("run_id").agg(*[f.alias(k) for k, f in first.items()])
    run.audit(target, counted.unpivot(["run_id"], list(stages), "stage", "n_rows").withColumn("job_name", F.lit("clean")))
    return target.read()


def bill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the last day's bills as one CSV file, greatest first, read back."""
    bills = table(spark, sf_dir, "household_billing_daily").filter("is_current")
    at = scratch(spark, "report")
    day = bills.filter(F.col("sim_date") == bills.agg(F.max("sim_date")).scalar())
    csv_report(day.select("household_id", F.col("sim_date").cast("string").alias("sim_date"), F.col("net_grid_kwh").cast("string").alias("net_grid_kwh")), f"{at}/report", "net_grid_kwh", "household_id")
    return spark.read.csv(f"{at}/report", header=True, schema="household_id string, sim_date string, net_grid_kwh string")


def load_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of each zone's published load in minutes at the newest update."""
    p = table(spark, sf_dir, "zone_load_1m")
    at = micros(F.col("updated_at"), dict(p.dtypes)["updated_at"])
    newest = p.agg(F.max(at)).scalar()
    return p.groupBy("grid_zone").agg(F.floor((newest - F.max(at)) / 60_000_000).cast("bigint").alias("age_minutes"))


QUERIES = {f.__name__: f for f in (stream_messages, stream_dead_letters, stream_archive, stream_audit, stream_zone_load, stream_running, stream_once, store_merge, run_audit, bill_report, load_age)}
