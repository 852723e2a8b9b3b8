import json
import os
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.contracts import CLEAN_READING, KEYS
from gridloom.fixtures import generators
from gridloom.operators import clean, zones
from gridloom.operators.dedup import first_copies
from gridloom.plans import streams
from gridloom.plans.problems import table
from gridloom.simtime import TimeBudget
from gridloom.sources.logs import BadDimension, batch_log, clean_stream, event_time, read_dimensions, stream_log, tariff_drops, weather_drops, write_log
from gridloom.sources.sinks import drop_file
from gridloom.store.keyed import KeyedTable
from gridloom.store.quotients import QuotientTables
from gridloom.streaming import run

DAYS = T.StructType([T.StructField("household_id", T.StringType()), T.StructField("sim_date", T.StringType()), *[T.StructField(n, T.DecimalType(28, 6)) for n in ("consumption_kwh", "solar_kwh", "net_grid_kwh")]])
START = 1_741_046_400_000_000  # 2025-03-04
RAW = ["event_id", "meter_id", "household_id", "grid_zone", "power_consumption_kwh", "solar_generation_kwh", "event_timestamp", "sim_date", "producer_emitted_at", "correlation_id", "schema_version"]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """A log in files of successive hours, with faults and copies, and its dimension."""
    folder = tmp_path_factory.mktemp("raw")
    good = generators.generate(spark, 12, 24, START)
    rows = generators.inject(good, 3, (("null_field", 0.05), ("negative", 0.05), ("solar_spike", 0.05)), 0.1).select(*RAW, "event_timestamp").orderBy("event_timestamp").collect()
    for k in range(0, len(rows), 60):
        lines = [json.dumps({f: r[f] for f in RAW}) for r in rows[k : k + 60]] + (["not json"] if k == 0 else [])
        drop_file(str(folder), f"{k:06d}.json", ("\n".join(lines) + "\n").encode())
    dim = good.select("household_id", (F.col("solar_capacity_kw") > 0).alias("has_solar"), "solar_capacity_kw").distinct().withColumns({"zone_name": F.lit("zone"), "zone_capacity_kw": F.lit(9.0)})
    return str(folder), dim


def test_stream_equals_batch_and_replays_alike(spark, raw, tmp_path):
    folder, dim = raw
    out = str(tmp_path / "out")
    run.clean_job(stream_log(spark, folder, max_files=2), dim, out, str(tmp_path / "cp")).awaitTermination()
    log = run.with_key(event_time(batch_log(spark, folder))).dropDuplicates(["dedupe_key"])
    judged = clean.join_dimension(log, dim).withColumn("rejection_reason", clean.rejection_reason(F.col("emitted_at"), run.REQUIRED))
    want = {r.rejection_reason or "valid": r["count"] for r in judged.groupBy("rejection_reason").count().collect()}
    got = {r.reason: r.n for r in spark.read.json(f"{out}/audit").groupBy("reason").agg(F.sum("n_rows").alias("n")).collect()}
    assert got == want and {"negative_kwh", "null_required_field", "solar_above_capacity"} <= set(got)
    messages = spark.read.option("recursiveFileLookup", True).json(f"{out}/clean")
    assert messages.count() == got["valid"] == spark.read.parquet(f"{out}/archive").count()
    assert spark.read.json(f"{out}/dead_letters").filter("original_payload = 'not json'").count() == 1
    # a batch that runs again replaces what it wrote
    batch = event_time(batch_log(spark, f"{folder}/000000.json"))
    each = run.clean_batch(dim, str(tmp_path / "again"))
    each(batch, 0)
    n = spark.read.parquet(f"{tmp_path}/again/archive").count()
    each(batch, 0)
    assert spark.read.parquet(f"{tmp_path}/again/archive").count() == n

    # downstream: windows and running totals
    clean_log = str(tmp_path / "clean_log")
    messages.select("value").write.text(clean_log)
    zone_schema = T.StructType([T.StructField(n, t) for n, t in (("grid_zone", T.StringType()), ("window_start", T.TimestampType()), ("window_end", T.TimestampType()), ("total_consumption_kwh", T.DecimalType(28, 6)), ("total_solar_kwh", T.DecimalType(28, 6)), ("renewable_pct", T.DecimalType(6, 3)), ("active_meter_count", T.IntegerType()), ("late_event_count", T.IntegerType()))])
    zone_table = KeyedTable(spark, str(tmp_path / "zones"), zone_schema, ["grid_zone", "window_start"])
    run.zone_job(clean_stream(spark, clean_log, CLEAN_READING, ["event_timestamp", "grid_zone"]), zone_table, str(tmp_path / "cpz")).awaitTermination()
    valid = clean.enrich(judged.filter("rejection_reason is null")).withColumn("is_late", zones.is_late(F.unix_micros("emitted_at"), F.unix_micros("event_at")))
    keys = ["grid_zone", "window_start", "total_consumption_kwh", "total_solar_kwh", "renewable_pct", "late_event_count"]
    assert sorted(map(tuple, zone_table.read().select(*keys).collect())) == sorted(map(tuple, zones.zone_load(valid).select(*keys).collect()))
    day_schema = T.StructType([T.StructField("household_id", T.StringType()), T.StructField("sim_date", T.StringType()), *[T.StructField(n, T.DecimalType(28, 6)) for n in ("consumption_kwh", "solar_kwh", "net_grid_kwh")], T.StructField("tariff_rate", T.DoubleType())])
    days = KeyedTable(spark, str(tmp_path / "days"), T.StructType(day_schema.fields[:-1]), ["household_id", "sim_date"], part="sim_date")
    run.running_job(clean_stream(spark, clean_log, CLEAN_READING, ["household_id"]), days, str(tmp_path / "cpd")).awaitTermination()
    want = {(r.household_id, r.sim_date): r.net_grid_kwh for r in zones.running_totals(valid).collect()}
    assert {(r.household_id, r.sim_date): r.net_grid_kwh for r in days.read().collect()} == want
    # a tariff that comes later completes the rows that lack one
    rated = KeyedTable(spark, str(tmp_path / "rated"), day_schema, ["household_id", "sim_date"])
    rated.merge(days.read().withColumn("tariff_rate", F.lit(None).cast("double")))
    one = sorted(want)[0][0]
    rated.merge(run.completed(rated, spark.createDataFrame([(one, 2.5)], "household_id string, tariff_rate double")))
    assert {r.household_id for r in rated.read().filter("tariff_rate = 2.5").collect()} == {one} and rated.read().count() == len(want)


def line(event_id, hour=1, **more):
    return json.dumps({"event_id": event_id, "household_id": "h", "grid_zone": "z", "power_consumption_kwh": 1.0, "solar_generation_kwh": 0.0, "net_grid_kwh": 1.0, "event_timestamp": f"2025-03-04T{hour:02d}:00:00Z", "producer_emitted_at": f"2025-03-04T{hour:02d}:00:01Z", "sim_date": "2025-03-04"} | more)


U = "12345678-90ab-cdef-1234-567890abcdef"
#: Three records without an id, three with a blank one, and one message in four spellings: seven messages.
MIXED = [None, None, None, "", "  ", "", U, U.upper(), "{" + U + "}", "urn:uuid:" + U]


def test_stream_keeps_what_has_no_id_and_knows_every_spelling(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    drop_file(str(folder), "a.json", "\n".join(line(i) for i in MIXED).encode())
    drop_file(str(folder), "b.json", "\n".join(line(i) for i in [U, None]).encode())
    for k, name in enumerate(("a.json", "b.json")):
        os.utime(folder / name, (1000 + k, 1000 + k))
    dim = spark.createDataFrame([("h", False, 0.0, "zone", 9.0)], "household_id string, has_solar boolean, solar_capacity_kw double, zone_name string, zone_capacity_kw double")
    out = str(tmp_path / "out")
    run.clean_job(stream_log(spark, str(folder), max_files=1), dim, out, str(tmp_path / "cp")).awaitTermination()
    n = {r.reason: r.n for r in spark.read.json(f"{out}/audit").groupBy("reason").agg(F.sum("n_rows").alias("n")).collect()}
    assert n == {"valid": 4, "null_required_field": 4}  # three blank ids and the message; three and one without an id
    # the batch over the same log has the same messages
    batch = first_copies(event_time(batch_log(spark, str(folder))).withColumn("n", F.monotonically_increasing_id()), "event_id", F.col("n"), ["n"], [])
    assert batch.count() == sum(n.values())
    # downstream jobs count alike, also when the clean log is delivered again
    clean_log = tmp_path / "clean"
    clean_log.mkdir()
    for k in range(2):
        drop_file(str(clean_log), f"{k}.json", "\n".join(line(i) for i in ["", "", U if k else U.upper()]).encode())
    t = KeyedTable(spark, str(tmp_path / "t"), DAYS, ["household_id", "sim_date"])
    run.running_job(clean_stream(spark, str(clean_log), CLEAN_READING, ["household_id"]), t, str(tmp_path / "cpd")).awaitTermination()
    assert [int(r.consumption_kwh) for r in t.read().collect()] == [5]


def test_a_batch_merged_before_a_crash_runs_to_its_end(spark, tmp_path):
    """The sink knows the batch; its state must be written all the same."""
    folder = tmp_path / "in"
    folder.mkdir()
    drop_file(str(folder), "a.json", line(U).encode())
    t = KeyedTable(spark, str(tmp_path / "t"), DAYS, ["household_id", "sim_date"])
    job = lambda: run.running_job(clean_stream(spark, str(folder), CLEAN_READING, ["household_id"]), t, str(tmp_path / "cp")).awaitTermination()
    job()
    shutil.rmtree(tmp_path / "cp" / "commits")  # as if the job had died after the merge
    version = t.version
    job()
    assert t.version == version
    drop_file(str(folder), "b.json", line("other", 2).encode())
    job()
    assert [int(r.consumption_kwh) for r in t.read().collect()] == [2]


def test_once_job_knows_ids_of_any_age(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, ids in enumerate(([U, None], [U.upper(), "x"], [U, None, " x "])):
        drop_file(str(folder), f"{k}.json", "\n".join(line(i, 1 + k, log_offset=10 * k + n) for n, i in enumerate(ids)).encode())
        os.utime(folder / f"{k}.json", (1000 + k, 1000 + k))
    tables = QuotientTables(spark, str(tmp_path / "q"), {"log_offset": T.LongType(), "log_partition": T.StringType()})
    run.once_job(event_time(stream_log(spark, str(folder), max_files=1)), tables, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.log_offset, r.event_id) for r in spark.read.schema("log_offset bigint, event_id string").option("recursiveFileLookup", True).json(str(tmp_path / "out")).collect())
    assert got == [(0, U), (1, None), (11, "x"), (21, None)]


def test_files_of_a_log_are_read_in_order_of_arrival(spark, tmp_path):
    df = spark.range(1000).select(F.lit("e").alias("event_id"), F.col("id").alias("log_offset"))
    write_log(df.repartition(7), str(tmp_path / "log"), ["event_id"], ["log_offset"], 5)
    files = sorted((p.stat().st_mtime, p) for p in (tmp_path / "log").glob("part-*"))
    offsets = [json.loads(x)["log_offset"] for _, p in files for x in p.read_text().split()]
    assert offsets == list(range(1000)) and len({m for m, _ in files}) == len(files)
    assert {r.log_offset for r in batch_log(spark, str(tmp_path / "log")).collect()} == set(range(1000))


def test_audit_is_keyed_by_run_job_and_stage(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "audit"), T.StructType([T.StructField("run_id", T.LongType()), T.StructField("job_name", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("n_rows", T.LongType())]), list(KEYS["run_audit"]))
    for n in (5, 7):
        run.audit(t, spark.createDataFrame([(1, "j", "a", n), (1, "j", "b", 1), (n, "j", "a", n)], "run_id long, job_name string, stage string, n_rows long"))
    assert sorted(map(tuple, t.read().collect())) == [(1, "j", "a", 7), (1, "j", "b", 1), (5, "j", "a", 5), (7, "j", "a", 7)]


def test_time_budget_is_checked_before_anything_runs(spark):
    with pytest.raises(ValueError, match="dropped"):
        run.zone_job(None, None, "", TimeBudget(records_per_batch=20_000))


def test_late_rows_are_counted(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, hours in enumerate(([0, 1], [40, 41], [42], [2, 43])):  # the 2 comes behind the watermark
        drop_file(str(folder), f"{k}.json", "\n".join(json.dumps({"event_id": f"{k}{h}", "household_id": "h", "grid_zone": "z", "power_consumption_kwh": 1.0, "solar_generation_kwh": 0.0, "net_grid_kwh": 1.0, "event_timestamp": f"2025-03-{4 + h // 24:02d}T{h % 24:02d}:00:00Z"}) for h in hours).encode())
        os.utime(folder / f"{k}.json", (1000 + k, 1000 + k))  # files are read in the order of their times
    listener = run.LateRows()
    spark.streams.addListener(listener)
    try:
        t = KeyedTable(spark, str(tmp_path / "t"), T.StructType([T.StructField("household_id", T.StringType()), T.StructField("sim_date", T.StringType()), *[T.StructField(n, T.DecimalType(28, 6)) for n in ("consumption_kwh", "solar_kwh", "net_grid_kwh")]]), ["household_id", "sim_date"])
        run.running_job(clean_stream(spark, str(folder), CLEAN_READING, ["household_id"], max_files=1), t, str(tmp_path / "cp"), "60 minutes").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert {(r.sim_date, int(r.consumption_kwh)) for r in t.read().collect()} == {("2025-03-04", 2), ("2025-03-05", 4)}
    assert sum(listener.dropped.values()) == 1


def test_drop_folders(spark, tmp_path):
    drop_file(str(tmp_path), "t.csv", b"household_id,sim_date,tariff_rate,billing_tier,subsidy_flag,effective_from,schema_version\nh,2025-03-04,2.5,T,true,2025-03-04T00:00:00Z,1\n,2025-03-04,2.5,T,true,2025-03-04T00:00:00Z,1\nh,2025-03-04,-1,T,true,2025-03-04T00:00:00Z,1\nh,2025-03-04,2,T,true,soon,1\n")
    drop_file(str(tmp_path), ".half.csv", b"garbage")
    drop_file(str(tmp_path), "w.json", json.dumps([{"grid_zone": "z", "sim_date": "2025-03-04", "cloud_cover_pct": 20.0, "expected_solar_index": 0.8}, {"grid_zone": "z", "sim_date": "2025-03-05", "cloud_cover_pct": 120.0, "expected_solar_index": 0.8}]).encode())
    for name, df, want in (("t", tariff_drops(spark, str(tmp_path)), [None, "bad_rate", "bad_time", "no_household"]), ("w", weather_drops(spark, str(tmp_path)), [None, "bad_cloud"])):
        for _ in range(2):  # a file is read once
            df.writeStream.format("parquet").option("path", f"{tmp_path}/out_{name}").option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start().awaitTermination()
        assert sorted((r.rejection_reason for r in spark.read.parquet(f"{tmp_path}/out_{name}").collect()), key=lambda x: x or "") == want


def test_dimension_files(spark, tmp_path):
    z = tmp_path / "z.csv"
    z.write_text("grid_zone,name,capacity_kw,latitude_deg\nz,Z,5,1\n")
    h = tmp_path / "h.csv"
    h.write_text("household_id,meter_id,grid_zone,has_solar,base_load_kw,solar_capacity_kw\na,m,z,true,1,2\n")
    assert read_dimensions(spark, str(h), str(z))[0].count() == 1
    h.write_text("household_id,meter_id,grid_zone,has_solar,base_load_kw,solar_capacity_kw\na,m,q,true,1,2\n")
    with pytest.raises(BadDimension, match="unknown_zone"):
        read_dimensions(spark, str(h), str(z))
    h.write_text("household_id,meter_id,grid_zone,has_solar,base_load_kw,solar_capacity_kw\n")
    with pytest.raises(BadDimension, match="empty"):
        read_dimensions(spark, str(h), str(z))


def test_a_large_raw_log_has_several_files_in_each_of_its_three_batches(spark, sf, tmp_path, monkeypatch):
    def files(stream):
        seen = []
        run.start(stream, lambda batch, k: seen.append(sorted(r[0] for r in batch.select("log_partition").distinct().collect())), str(tmp_path / f"cp{len(list(tmp_path.iterdir()))}")).awaitTermination()
        return seen

    assert [len(b) for b in files(streams._raw_log(spark, sf, str(tmp_path / "one")))] == [1, 1, 1]
    monkeypatch.setattr(streams, "FILE_BYTES", clean.source_bytes(table(spark, sf, "meter_readings_v1")) // 5)
    several = files(streams._raw_log(spark, sf, str(tmp_path / "two")))
    assert [len(b) for b in several] == [2, 2, 2] and sum(several, []) == sorted(sum(several, []))  # in order of arrival
    assert all(p.endswith(".gz") for b in several for p in b)


def test_the_clean_log_is_in_few_files(spark, sf):
    """A micro-batch takes ten files, however small they are."""
    log = Path(streams._clean_log(spark, sf).removeprefix("file:"))
    assert len(list(log.glob("part-*"))) == 2


def test_of_copies_in_a_batch_the_one_that_arrived_first_is_kept(spark, tmp_path):
    """The larger file is read first, but came later."""
    folder = tmp_path / "in"
    folder.mkdir()
    drop_file(str(folder), "a.json", line(U, log_offset=1).encode())
    drop_file(str(folder), "b.json", "\n".join([line(U.upper(), log_offset=2), *[line(f"x{k}", log_offset=10 + k) for k in range(50)]]).encode())
    dim = spark.createDataFrame([("h", False, 0.0, "zone", 9.0)], "household_id string, has_solar boolean, solar_capacity_kw double, zone_name string, zone_capacity_kw double")
    run.clean_job(stream_log(spark, str(folder), max_files=2), dim, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out/archive").select("log_offset").collect()) == [1, *range(10, 60)]
