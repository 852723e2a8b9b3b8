"""Streaming jobs: the batch operators on micro-batches, with idempotent sinks.

A batch that is run again after a crash replaces what it wrote (folders by batch id, merges by key and batch id), so that a job
restarted from its checkpoint ends as if it had not stopped. To replay a log, start the same job with a new checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gridloom.operators import clean, zones
from gridloom.operators.dedup import first_copies
from gridloom.session import release
from gridloom.simtime import TimeBudget
from gridloom.sources.logs import event_time
from gridloom.sources.sinks import append_messages, append_records, archive
from gridloom.store.keyed import KeyedTable
from gridloom.store.quotients import QuotientTables

REQUIRED = ("event_id", "household_id", "grid_zone", "power_consumption_kwh", "solar_generation_kwh", "event_at", "sim_date")


def with_key(df: DataFrame) -> DataFrame:
    """Adds dedupe_key: the message's identity, whatever its spelling. A record without one (null or blank id) is a message of its own; as a file
    log need not know its place, its key is made up, and serves for nothing but being no other record's."""
    return df.withColumn("dedupe_key", clean.dedupe_key(F.col("event_id"), F.expr("uuid()")))


def deduplicated(stream: DataFrame, watermark: str) -> DataFrame:
    """Each message once while its copies are within the watermark; state is dropped behind it. Records without an id are all kept.

    Of the copies in a micro-batch the first by log_offset and log_partition is kept, in whatever order a shuffle brings them: its partitions
    are sorted before state sees them. To be started with sorts."""
    keyed = with_key(event_time(stream)).withWatermark("watermark_at", watermark)
    return keyed.repartition("dedupe_key").sortWithinPartitions("log_offset", "log_partition").dropDuplicatesWithinWatermark(["dedupe_key"])


_CHECK = "spark.sql.streaming.unsupportedOperationCheck"


def start(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None, sorts: bool = False) -> StreamingQuery:
    """Runs a query on micro-batches; without `every` until the input is used up. sorts: whether it sorts within partitions, which Spark refuses
    along with sorts of whole streams, though a micro-batch's partition can be sorted; its check is left out while such a query starts."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    conf = df.sparkSession.conf
    checked = conf.get(_CHECK, "true")
    try:
        if sorts:
            conf.set(_CHECK, "false")
        return w.start()
    finally:
        if sorts:
            conf.set(_CHECK, checked)


def merge_into(target: KeyedTable, job: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """Merges each micro-batch once. A batch that was merged before a crash is still read to its end, as its state must be written again; a job
    with another checkpoint counts its batches anew."""
    writer = f"{job}:{checkpoint}"

    def each(batch: DataFrame, batch_id: int) -> None:
        release(batch.sparkSession)  # what the batch before has shuffled
        if target.batches.get(writer, -1) >= batch_id:
            batch.write.format("noop").mode("overwrite").save()
        else:
            target.merge(batch, writer=writer, batch_id=batch_id)

    return each


def clean_batch(dim: DataFrame | Callable[[], DataFrame], out: str, reject_unknown_household: bool = False) -> Callable[[DataFrame, int], None]:
    """The fan-out of one micro-batch: dead letters, clean messages and the archive, in this order, from one pass over its input.

    dim may be a function: then the dimension is read anew in each micro-batch, as where it is a compacted log that goes on growing.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        release(batch.sparkSession)  # what the batch before has shuffled
        judged = clean.join_dimension(batch, dim() if callable(dim) else dim).withColumn("rejection_reason", clean.rejection_reason(F.col("emitted_at"), REQUIRED, reject_unknown_household=reject_unknown_household)).persist()
        try:
            valid, rejected = clean.split(judged)
            good = clean.enrich(valid)
            append_records(clean.dead_letters(rejected, "clean", F.col("emitted_at")), f"{out}/dead_letters", batch_id)
            append_messages(clean.clean_message(good), f"{out}/clean", batch_id)
            archive(good.drop("rejection_reason", "raw_value", "watermark_at", "dedupe_key"), f"{out}/archive", batch_id)
            append_records(judged.groupBy(F.coalesce("rejection_reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("batch_id", F.lit(batch_id)), f"{out}/audit", batch_id)
        finally:
            judged.unpersist()

    return each


def clean_job(stream: DataFrame, dim: DataFrame | Callable[[], DataFrame], out: str, checkpoint: str, watermark: str = "576 minutes", every: str | None = None) -> StreamingQuery:
    return start(deduplicated(stream, watermark), clean_batch(dim, out), checkpoint, every=every, sorts=True)


def zone_job(clean_stream: DataFrame, target: KeyedTable, checkpoint: str, budget: TimeBudget = TimeBudget(), every: str | None = None) -> StreamingQuery:
    """Zone totals, merged by zone and window as they change. The time budget is checked before anything runs."""
    budget.check()
    timed = event_time(clean_stream)
    timed = timed.withColumn("is_late", zones.is_late(F.unix_micros("emitted_at"), F.unix_micros("event_at"), budget.tick_seconds, budget.ratio))
    # the message's copies may have come through a replayed clean log
    once = with_key(timed).withWatermark("event_at", f"{int(budget.watermark)} minutes").dropDuplicatesWithinWatermark(["dedupe_key"])
    totals = zones.zone_load(once, window=f"{int(budget.window)} minutes", exact_meters=False)
    return start(totals, merge_into(target, "zone_job", checkpoint), checkpoint, "update", every)


def running_job(clean_stream: DataFrame, target: KeyedTable, checkpoint: str, watermark: str = "576 minutes", every: str | None = None) -> StreamingQuery:
    """Totals by household and day, republished (never accumulated in the sink). Days are windows, so that state is dropped behind the watermark.
    A message that a replayed clean log brings again counts once."""
    timed = event_time(clean_stream).filter(F.col("household_id").isNotNull() & F.col("event_at").isNotNull())
    once = with_key(timed).withWatermark("event_at", watermark).dropDuplicatesWithinWatermark(["dedupe_key"])
    sums = once.groupBy("household_id", F.window("event_at", "1 day").alias("day")).agg(*[F.sum(zones.kwh(F.col(c))).alias(n) for c, n in (("power_consumption_kwh", "consumption_kwh"), ("solar_generation_kwh", "solar_kwh"), ("net_grid_kwh", "net_grid_kwh"))])
    out = sums.select("household_id", F.date_format("day.start", "yyyy-MM-dd").alias("sim_date"), "consumption_kwh", "solar_kwh", "net_grid_kwh")
    return start(out, merge_into(target, "running_job", checkpoint), checkpoint, "update", every)


def once_job(stream: DataFrame, tables: QuotientTables, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each message once however late its copies come: identifiers are kept in quotient tables instead of state behind a watermark.
    stream must have log_partition, log_offset (not null) and the columns of event_time."""

    def each(batch: DataFrame, batch_id: int) -> None:
        when = F.unix_micros("emitted_at")
        fresh = first_copies(batch, "event_id", when, ["log_offset", "log_partition"], batch.columns)
        done = tables.table.batches.get("once", -1) >= batch_id  # inserted before a crash: what it brought has been written
        if not done:
            append_records(tables.unknown(fresh, "event_id"), out, batch_id)
        tables.insert(batch, "event_id", when, batch_id, "once")

    return start(stream, each, checkpoint, every=every)


def audit(table: KeyedTable, rows: DataFrame) -> None:
    """Upserts a run's records by run, job and stage: a stage that runs again replaces what it recorded. rows: run_id, job_name, stage and figures."""
    table.merge(rows, writer="audit")


def completed(target: KeyedTable, tariffs: DataFrame) -> DataFrame:
    """Rows that lack a rate although their tariff has come since: to be merged after every tariff change, for days that no reading touches again."""
    t = tariffs.select("household_id", F.col("tariff_rate").alias("_rate"))
    return target.read().filter("tariff_rate is null").join(t, "household_id").filter("_rate is not null").withColumn("tariff_rate", F.col("_rate")).drop("_rate")


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks dropped and the duration of batches, per query."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.batch_ms: dict[str, list[int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.dropped[name] = self.dropped.get(name, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.batch_ms.setdefault(name, []).append(p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
