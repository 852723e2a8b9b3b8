"""Sources: append-only logs, dimensions and drop folders, batch or streaming, always with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.contracts import HOUSEHOLD, READING, TARIFF, WEATHER, ZONE
from gridloom.functions.timeparse import iso_micros
from gridloom.operators.clean import dimension_faults, parse


def _offsets(df: DataFrame) -> DataFrame:
    """The place of every line of a file log: its file, and the log_offset that the producer wrote into the record (null if it wrote none)."""
    return df.withColumns({"log_partition": F.col("_metadata.file_path"), "log_offset": F.get_json_object("value", "$.log_offset").try_cast("bigint")})


def write_log(df: DataFrame, folder: str, fields: list[str], order: list[str], files: int = 4, **options: str) -> None:
    """A file log: JSON lines with the fields and the record's log_offset, in order of arrival within and between files, whose
    modification times rise, so that a stream reads them in that order. options: of the text files."""
    spark = df.sparkSession
    lines = df.select(*dict.fromkeys([*fields, "log_offset", *order])).repartitionByRange(files, *order).sortWithinPartitions(*order)
    lines.select(F.to_json(F.struct(*[f for f in fields if f != "log_offset"], "log_offset")).alias("value")).write.mode("overwrite").options(**options).text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    newest = fs.getFileStatus(path).getModificationTime()
    for k, p in enumerate(found):
        fs.setTimes(p, newest - 1000 * (len(found) - k), -1)


def stream_log(spark: SparkSession, path: str, schema: T.StructType = READING, max_files: int = 10, kafka: dict[str, str] | None = None) -> DataFrame:
    """An unbounded log of JSON lines, parsed against the contract, with the raw text; max_files bounds a micro-batch and the event time it spans.

    With kafka options (kafka.bootstrap.servers, subscribe, startingOffsets, maxOffsetsPerTrigger ...) the same columns come from a topic, where the connector is installed.
    """
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).load().select(F.col("value").cast("string").alias("value"), F.col("partition").cast("string").alias("log_partition"), F.col("offset").alias("log_offset"))
    else:
        raw = _offsets(spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)).select("value", "log_partition", "log_offset")
    return parse(raw, schema=schema)


def batch_log(spark: SparkSession, path: str, schema: T.StructType = READING) -> DataFrame:
    """The whole log, from the earliest record on: to be read anew in each micro-batch where a compacted log stands beside a stream."""
    return parse(_offsets(spark.read.text(path)).select("value", "log_partition", "log_offset"), schema=schema)


def event_time(df: DataFrame, fallback: str | None = None) -> DataFrame:
    """Adds event_at and emitted_at (timestamps), null where the text is no ISO time, and watermark_at: event_at, or fallback (a timestamp column),
    and no later than the record's own emission plus five minutes, so that a stamp from the future moves no watermark."""
    out = df.withColumns({"event_at": F.timestamp_micros(iso_micros(F.col("event_timestamp"))), "emitted_at": F.timestamp_micros(iso_micros(F.col("producer_emitted_at")))})
    at = F.coalesce("event_at", *([fallback] if fallback else []), "emitted_at")
    return out.withColumn("watermark_at", F.least(at, F.col("emitted_at") + F.expr("INTERVAL 5 MINUTES")))


def clean_stream(spark: SparkSession, path: str, schema: T.StructType, required: list[str], max_files: int = 10) -> DataFrame:
    """A clean log; rows without a required key are left out before they reach state."""
    out = stream_log(spark, path, schema, max_files)
    for c in required:
        out = out.filter(F.col(c).isNotNull())
    return out


class BadDimension(ValueError):
    pass


def read_dimensions(spark: SparkSession, households: str, zones: str) -> tuple[DataFrame, DataFrame]:
    """Dimension files (CSV with header), checked: unique ids, known zones, capacity above 0 only with solar, not empty. Raises BadDimension."""
    h = spark.read.schema(HOUSEHOLD).csv(households, header=True)
    z = spark.read.schema(ZONE).csv(zones, header=True)
    faults = dimension_faults(h, z).limit(5).collect()
    if faults or h.isEmpty() or z.isEmpty():
        raise BadDimension("; ".join(f"{r.fault}: {r.id}" for r in faults) or "empty dimension")
    return h, z


def _rejects(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    reason = F.lit(None).cast("string")
    for rule, name in reversed(rules):
        reason = F.when(F.coalesce(F.expr(rule), F.lit(True)), name).otherwise(reason)
    return df.withColumn("rejection_reason", reason)


def tariff_drops(spark: SparkSession, folder: str, max_files: int = 10) -> DataFrame:
    """Tariff CSV files dropped into a folder, each read once (the checkpoint is the marker); with rejection_reason. Names that start with a dot are skipped."""
    raw = spark.readStream.schema(TARIFF).option("header", True).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "[!.]*.csv").csv(folder)
    return _rejects(raw, [("household_id is null or trim(household_id) = ''", "no_household"), ("tariff_rate is null or tariff_rate <= 0", "bad_rate"), ("try_cast(effective_from as timestamp) is null", "bad_time")])


def weather_drops(spark: SparkSession, folder: str, max_files: int = 10) -> DataFrame:
    """Weather forecasts (JSON arrays) dropped into a folder, keyed by zone and date."""
    raw = spark.readStream.schema(WEATHER).option("multiLine", True).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "[!.]*.json").json(folder)
    keyed = raw.withColumn("key", F.concat_ws("|", "grid_zone", "sim_date"))
    return _rejects(keyed, [("grid_zone is null or sim_date is null", "no_key"), ("cloud_cover_pct is null or cloud_cover_pct < 0 or cloud_cover_pct > 100", "bad_cloud"), ("expected_solar_index is null or expected_solar_index < 0 or expected_solar_index > 1", "bad_index")])
