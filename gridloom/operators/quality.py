"""Gates, invariants and alert predicates. A gate returns one row with its figures and `passed`; `enforce` raises if it did not pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class GateFailed(Exception):
    pass


def enforce(gate: DataFrame) -> None:
    row = gate.first()
    if not row["passed"]:
        raise GateFailed(str(row.asDict()))


def coverage(seen: DataFrame, expected: DataFrame, key: str, at_least: float = 0.95) -> DataFrame:
    """Distinct keys seen against those expected."""
    both = expected.select(F.lit(True).alias("_wanted"), F.col(key).alias("_k")).unionByName(seen.select(F.lit(False).alias("_wanted"), F.col(key).alias("_k")))
    both = both.agg(F.count_distinct(F.when(F.col("_wanted"), F.col("_k"))).alias("expected_count"), F.count_distinct(F.when(~F.col("_wanted"), F.col("_k"))).alias("seen_count"))
    return both.select("expected_count", "seen_count", (F.coalesce(F.try_divide("seen_count", "expected_count"), F.lit(1.0)) >= at_least).alias("passed"))


def coherence(df: DataFrame) -> DataFrame:
    """Counts of incoherent totals: negative energy, net over consumption + solar where there is solar, published net unequal to consumption - solar."""
    c, s, net = F.col("consumption_kwh"), F.col("solar_kwh"), F.col("net_grid_kwh")
    n = lambda rule, name: F.coalesce(F.sum(F.when(rule, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(name)
    out = df.agg(n((c < 0) | (s < 0), "negative_count"), n((s > 0) & (net > c + s), "net_above_count"), n(net != c - s, "net_off_count"))
    return out.withColumn("passed", (F.col("negative_count") + F.col("net_above_count") + F.col("net_off_count")) == 0)


def reject_rate(df: DataFrame, reason: str = "rejection_reason", at_most: float = 0.02) -> DataFrame:
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(reason).alias("rejected_count"))
    return out.withColumn("passed", F.coalesce(F.try_divide("rejected_count", "n_rows"), F.lit(0.0)) <= at_most)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique; none in a sound table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def current_versions_off(df: DataFrame, keys: list[str], current: str = "is_current") -> DataFrame:
    """Keys that don't have exactly one current row."""
    return df.groupBy(*keys).agg(F.sum(F.when(F.col(current), 1).otherwise(0)).cast("bigint").alias("current_count")).filter("current_count <> 1")


def differing(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys in both whose columns differ, nulls counting as values."""
    b = before.select(*keys, *[F.col(c).alias("_before_" + c) for c in columns])
    off = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col("_before_" + c)) for c in columns])
    return after.select(*keys, *columns).join(b, keys).filter(off).select(*keys)


def low_renewable(windows: DataFrame, below: float = 15.0, hours: tuple[int, int] = (6, 18)) -> DataFrame:
    """Windows by day with a known share of renewables below the limit."""
    h = F.hour("window_start")
    return windows.filter((h >= hours[0]) & (h < hours[1]) & (F.col("renewable_pct") < below))


def overloaded(windows: DataFrame, zones: DataFrame) -> DataFrame:
    """Windows whose mean power is above their zone's capacity."""
    hours = (F.unix_timestamp(F.col("window_end").cast("timestamp")) - F.unix_timestamp(F.col("window_start").cast("timestamp"))) / 3600
    z = zones.select("grid_zone", "capacity_kw")
    return windows.join(z, "grid_zone").withColumn("mean_kw", F.try_divide(F.col("total_consumption_kwh").cast("double"), hours)).filter("mean_kw > capacity_kw")


def silent(last_seen: DataFrame, expected: DataFrame, key: str, as_of: Column, longer_than: int) -> DataFrame:
    """Expected keys whose last_at is longer ago than so many microseconds, or that were never seen."""
    return expected.select(key).join(last_seen, key, "left").filter(F.coalesce(as_of - F.col("last_at") > F.lit(longer_than), F.lit(True)))


def behind(last: DataFrame, alert: str, now: Column, longer_than: int) -> DataFrame:
    """alert and label of what has had no news (last_at) for longer than so many microseconds, or never had any."""
    return last.filter(F.coalesce(now - F.col("last_at") > F.lit(longer_than), F.lit(True))).select(F.lit(alert).alias("alert"), "label")


def missing(expected: DataFrame, there: DataFrame, key: str, alert: str) -> DataFrame:
    """alert and label of the keys that are expected and not there."""
    return expected.join(there, key, "left_anti").select(F.lit(alert).alias("alert"), F.col(key).cast("string").alias("label"))


def all_alerts(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def inhibited(firing: DataFrame, by: DataFrame, on: list[str]) -> DataFrame:
    """Alerts that still count when others (by) fire on the same labels."""
    return firing.join(by.select(*on).distinct(), on, "left_anti")


def issue(bills: DataFrame, computed: DataFrame, keys: list[str], day: list[str]) -> DataFrame:
    """The snapshot after computed rows are issued as the next version of their day: earlier versions stay but are not current; rows of the day
    that are not computed anew are carried over into the new version, so that a day's version is one for all its keys."""
    version = bills.groupBy(*day).agg(F.max("version").alias("_v"))
    fresh = computed.select(*[c for c in bills.columns if c not in ("version", "is_current")])
    days = fresh.select(*day).distinct()
    carried = bills.filter("is_current").join(days, day, "left_semi").join(fresh.select(*keys), keys, "left_anti").select(*fresh.columns)
    added = fresh.unionByName(carried).join(version, day, "left").withColumn("version", (F.coalesce("_v", F.lit(0)) + 1).cast("int")).withColumn("is_current", F.lit(True)).select(*bills.columns)
    touched = days.withColumn("_touched", F.lit(True))
    kept = bills.join(touched, day, "left").withColumn("is_current", F.col("is_current") & F.col("_touched").isNull()).select(*bills.columns)
    return kept.unionByName(added)


def latest_version(bills: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the highest version of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col("version").desc())
    return bills.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
