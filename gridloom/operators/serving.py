"""Serving queries: functions of the serving tables that return frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.timeparse import bucket_of
from gridloom.operators.sequences import with_previous


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is latest in the order columns (descending, nulls last); end order with a unique column, or ties are arbitrary."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def newest(df: DataFrame, by: str, n: int, then: str) -> DataFrame:
    """The newest n rows, in ascending order."""
    return df.orderBy(F.col(by).desc(), F.col(then)).limit(n).orderBy(by, then)


def newest_per(df: DataFrame, keys: list[str], by: str, n: int) -> DataFrame:
    """The newest n rows of each key; end by with a unique column, or ties are arbitrary. Spark drops what cannot be among them before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def status(parts: list[DataFrame]) -> DataFrame:
    """One table of the datasets' rows (dataset, n_rows, newest)."""
    return reduce(DataFrame.unionByName, parts)


def top(df: DataFrame, by: str, n: int, then: str) -> DataFrame:
    """The n rows with the greatest values (nulls last)."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(then)).limit(n)


def optionally(df: DataFrame, column: str, value=None) -> DataFrame:
    """Rows where column is value; all rows if value is None."""
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def unresolved(df: DataFrame, status: str = "all") -> DataFrame:
    """Alerts; with status 'open' those without resolved_at."""
    return df.filter(F.col("resolved_at").isNull()) if status == "open" else df


def on_day(df: DataFrame, column: str, day: Column) -> DataFrame:
    """Rows of a half-open day."""
    return df.filter((F.col(column) >= day) & (F.col(column) < F.date_add(day, 1)))


def with_fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of first, and of second for keys that first lacks, tagged with their source ('first' or 'second')."""
    both = first.withColumn("_p", F.lit(1)).withColumn("source", F.lit("first")).unionByName(second.withColumn("_p", F.lit(2)).withColumn("source", F.lit("second")))
    w = Window.partitionBy(*keys).orderBy("_p")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_p")


def freshness(df: DataFrame, at: str, updated: str) -> DataFrame:
    return df.agg(F.max(at).alias("last_window"), F.max(updated).alias("last_update"), F.count(F.lit(1)).alias("n_rows"))


def relation_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def counter_delta(df: DataFrame, source: list[str], at: str, value: str, bucket: int = 1000) -> DataFrame:
    """Increase of a counter between samples per source, a fall counting as a restart from nought (rate queries). at is a whole number,
    one sample each; a source's history is cut into buckets of it, so that it may be as long as it likes."""
    out = with_previous(df, source, [at], [value], bucket_of(F.col(at), bucket), "_before_")
    before = F.col("_before_" + value)
    return out.withColumn("increase", F.when(before.isNull(), F.lit(0)).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))).drop("_before_" + value)


def quantiles(df: DataFrame, by: list[str], value: str, ranks: dict[str, float], width: int) -> DataFrame:
    """Exact quantiles (interpolated) per group without a group's values in one task: rows are counted by bins of the given width of a whole-number value,
    and only the bins in which the wanted ranks fall are put in order. ranks: output name -> rank. Null groups and values don't count."""
    rows = df.select(*by, value).dropna().withColumn("_bin", bucket_of(F.col(value), width))
    order = Window.partitionBy(*by).orderBy("_bin")
    bins = rows.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    bins = bins.withColumn("_upto", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    place = lambda p: F.lit(p) * (F.col("_all") - 1)
    ends = [F.struct(F.lit(n).alias("name"), f(place(p)).cast("bigint").alias("rank"), (place(p) - F.floor(place(p)) if e else 1 - (place(p) - F.floor(place(p)))).alias("part")) for n, p in ranks.items() for e, f in ((0, F.floor), (1, F.ceil))]
    wanted = bins.select(*by, "_bin", (F.col("_upto") - F.col("_n")).alias("_under"), "_upto", F.explode(F.array(*ends)).alias("_e")).filter("_e.rank >= _under and _e.rank < _upto")
    wanted = wanted.select(*by, "_bin", (F.col("_e.rank") - F.col("_under") + 1).alias("_k"), "_e.name", "_e.part")
    within = rows.join(wanted.select(*by, "_bin").distinct(), [*by, "_bin"], "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(value)).cast("bigint"))
    met = wanted.join(within, [*by, "_bin", "_k"])
    return met.groupBy(*by).agg(*[F.sum(F.when(F.col("name") == n, F.col(value) * F.col("part"))).alias(n) for n in ranks])
