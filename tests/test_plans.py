"""Plans as they should be: pruned scans, no Python and no nested loops in the core queries, partial aggregation before shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from gridloom.operators import anomalies
from gridloom.operators.dedup import KEY, first_copies, identified, shard_tables
from gridloom.operators.lateness import window_totals
from gridloom.plans import core, problems
from gridloom.sources import sinks
from gridloom.sources.sinks import archive


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found"])
def test_core_problems_stay_in_the_jvm(spark, sf, name):
    plan = plan_of(problems.QUERIES[name](spark, sf))
    assert not re.search("Python|Pandas|MapInArrow|Cartesian|NestedLoop", plan)


def test_scans_read_the_columns_they_need(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = plan_of(problems.p3_found(spark, sf))
    assert all(set(re.findall(r"(\w+):", s)) == {"meter_id", "power_consumption_kwh", "event_timestamp"} for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert "IsNotNull(meter_id)" in plan  # pushed down
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(core.latest_zone_load(spark, sf))))))
    assert read == {"grid_zone", "window_start", "total_consumption_kwh", "renewable_pct", "active_meter_count"}


def test_archive_is_pruned_by_day_and_zone(spark, tmp_path):
    df = spark.range(10).select(F.lit("e").alias("event_id"), F.concat(F.lit("2025-03-0"), (F.col("id") % 3 + 1).cast("string")).alias("sim_date"), F.lit("z").alias("grid_zone"))
    archive(df, str(tmp_path / "a"), 0)
    plan = plan_of(spark.read.parquet(str(tmp_path / "a")).filter("sim_date = '2025-03-02' and grid_zone = 'z'"))
    assert re.search(r"PartitionFilters: \[[^\]]*sim_date", plan)


def test_sums_combine_before_the_shuffle(spark, sf):
    log = problems.readings(spark, sf)
    plan = plan_of(window_totals(log, ["grid_zone"], "at", "emitted", problems.SUMS, problems.WINDOW, problems.CUTOFF))
    assert "partial_sum" in plan
    kept = plan_of(first_copies(log, "event_id", F.col("emitted"), problems.ROW, ["at"]))
    assert "partial_min" in kept  # copies of a message


def test_quotient_tables_are_hash_aggregated(spark, sf):
    log = problems.readings(spark, sf)
    rows = identified(log, "event_id").select(*KEY, F.col("emitted").alias("_first"), F.lit(1).alias("_salt"))
    plan = plan_of(shard_tables(rows))
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "partial_count" in plan


def test_identities_are_computed_once(spark, sf):
    """Conditions on computed keys would be pushed below and double the work."""
    plan = plan_of(first_copies(problems.readings(spark, sf), "event_id", F.col("emitted"), problems.ROW, []))
    assert not re.search(r"Filter [^\n]*xxhash64", plan)


def test_anomalies_shuffle_the_log_once(spark, sf, monkeypatch):
    """All that is asked of the log by meter and day asks for the same shuffle, which Spark then makes once."""
    cuts = []
    monkeypatch.setattr(anomalies, "cut", lambda df: cuts.append(df) or df)
    problems.p6_found(spark, sf)
    lines = [re.sub(r"#\d+L?|\[plan_id=\d+\]|^[ :+|-]+", "", x) for x in plan_of(cuts[0]).split("\n")]
    below = {tuple(lines[k : k + 8]) for k, x in enumerate(lines) if x.startswith("Exchange hashpartitioning(_meter, _day")}
    assert len(below) == 1
    assert not any(x.startswith("Filter") and "xxhash64" in x for x in lines)


def test_a_folder_of_the_archive_is_written_by_one_task_unless_it_is_large(spark, tmp_path, monkeypatch):
    df = spark.range(1200, numPartitions=6).select(F.concat(F.lit("2025-03-0"), F.col("id") % 3 + 1).alias("sim_date"), F.when(F.col("id") % 10 < 9, "a").otherwise("b").alias("grid_zone"), "id")
    archive(df, str(tmp_path / "a"), 0)
    assert len(list((tmp_path / "a").rglob("*.parquet"))) == 6
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 100)  # zone a has 360 rows a day, zone b 40
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in micro-batches
    try:
        archive(df, str(tmp_path / "b"), 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = [str(p) for p in (tmp_path / "b").rglob("*.parquet")]
    assert len([p for p in files if "grid_zone=b" in p]) == 3 < len([p for p in files if "grid_zone=a" in p])
    assert spark.read.parquet(str(tmp_path / "b")).select("id").distinct().count() == 1200 == spark.read.parquet(str(tmp_path / "b")).count()
