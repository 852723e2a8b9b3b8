"""Neighbours and running extremes along a key's timeline, without gathering a key in one task.

A window over a key alone puts all rows of that key in one task, and one key may hold a third of all rows. Here a timeline is
first cut into time buckets: windows run over (key, bucket), and what a bucket hands on to the next one is one row per bucket,
over which a second, small window runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def with_previous(df: DataFrame, key: list[str], order: list[str], values: list[str], bucket: Column, prefix: str = "prev_") -> DataFrame:
    """Adds prefix+v for each v of values: its value in the row before, in ascending order within the key; null in the first row.

    bucket must be non-decreasing along order. Rows that tie in order have no defined order among themselves. Keys and order
    columns must not be null.
    """
    at = df.withColumn(BUCKET, bucket).repartition(*key, BUCKET)
    within = Window.partitionBy(*key, BUCKET).orderBy(*order)
    struct = F.struct(*[F.col(v).alias(v) for v in values])
    lagged = at.withColumn("_row", F.row_number().over(within)).withColumn("_before", F.lag(struct).over(within))
    last = at.groupBy(*key, BUCKET).agg(F.max_by(struct, F.struct(*order)).alias("_last"))
    handed = last.select(*key, BUCKET, F.lag("_last").over(Window.partitionBy(*key).orderBy(BUCKET)).alias("_handed"))
    joined = lagged.join(handed, [*key, BUCKET], "left")
    before = F.when(F.col("_row") == 1, F.col("_handed")).otherwise(F.col("_before"))
    return joined.withColumn("_before", before).select(*df.columns, *[F.col("_before")[v].alias(prefix + v) for v in values])


def with_least_after(df: DataFrame, key: list[str], order: list[str], value: str, bucket: Column, name: str) -> DataFrame:
    """Adds the least value among the rows that follow in the key, null if none does; bucket as in with_previous."""
    at = df.withColumn(BUCKET, bucket).repartition(*key, BUCKET)
    down = [F.col(c).desc() for c in order]
    after = Window.partitionBy(*key, BUCKET).orderBy(*down).rowsBetween(Window.unboundedPreceding, -1)
    least = at.groupBy(*key, BUCKET).agg(F.min(value).alias("_least"))
    later = Window.partitionBy(*key).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    handed = least.select(*key, BUCKET, F.min("_least").over(later).alias("_handed"))
    joined = at.withColumn("_within", F.min(value).over(after)).join(handed, [*key, BUCKET], "left")
    return joined.select(*df.columns, F.least("_within", "_handed").alias(name))
