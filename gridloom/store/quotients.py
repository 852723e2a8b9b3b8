"""The quotient tables of problem 4, kept between batches: an identifier of any earlier batch is known.

A part of the table is a range of quotients, so that a batch opens and rewrites only the shards its identifiers fall in. A row
is one identifier: its complete remainder, how often it came, and its kept copy so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.dedup import KEY, LAST, QUOTIENT_BITS, has_id, identified
from gridloom.store.keyed import KeyedTable

_KEY_TYPES = {"_low": T.LongType(), "_high": T.LongType(), "_quotient": T.LongType(), "_other": T.StringType()}


class QuotientTables:
    def __init__(self, spark: SparkSession, path: str, tie: dict[str, T.DataType], shard_bits: int = 6):
        """tie: the columns that name a row (unique together, not null), with their types. 2 ** shard_bits shards."""
        self.tie, self.shard_bits = list(tie), shard_bits
        fields = {"_shard": T.LongType(), **_KEY_TYPES, "_n": T.LongType(), "_first": T.LongType(), **tie}
        self.table = KeyedTable(spark, path, T.StructType([T.StructField(n, t) for n, t in fields.items()]), ["_shard", *KEY], "_shard")

    def _rows(self, batch: DataFrame, id_col: str, first: Column) -> DataFrame:
        shard = F.shiftrightunsigned("_quotient", QUOTIENT_BITS - self.shard_bits).cast("bigint").alias("_shard")
        return identified(batch, id_col).select(shard, *KEY, F.coalesce(first, F.lit(LAST)).alias("_first"), *self.tie)

    def insert(self, batch: DataFrame, id_col: str, first: Column, batch_id: int | None = None, writer: str = "batch") -> None:
        """Inserts the identifiers of a batch, each once; one that is known keeps the better copy (as in dedup.first_copies). With a
        batch_id a batch that was inserted before changes nothing. Rows without an identifier are in no table."""
        if batch_id is not None and self.table.batches.get(writer, -1) >= batch_id:
            return
        copy = F.min(F.struct("_first", *self.tie)).alias("_c")
        fresh = self._rows(batch, id_col, first).groupBy("_shard", *KEY).agg(F.count(F.lit(1)).alias("_n"), copy).persist()
        try:
            shards = [str(r[0]) for r in fresh.select("_shard").distinct().collect()]  # at most 2 ** shard_bits
            known = self.table.read(shards).select("_shard", *KEY, "_n", F.struct("_first", *self.tie).alias("_c"))
            both = known.join(fresh.select("_shard", *KEY), ["_shard", *KEY], "left_semi").unionByName(fresh).groupBy("_shard", *KEY).agg(F.sum("_n").alias("_n"), F.min("_c").alias("_c"))
            self.table.merge(both.select("_shard", *KEY, "_n", "_c.*"), writer=writer, batch_id=batch_id)
        finally:
            fresh.unpersist()

    def unknown(self, batch: DataFrame, id_col: str) -> DataFrame:
        """The rows of a batch whose identifier is in no table, and those without one."""
        fresh = identified(batch, id_col).join(self.table.read().select(*KEY), KEY, "left_anti")
        return fresh.select(*batch.columns).unionByName(batch.filter(~has_id(id_col)))

    def later(self, log: DataFrame, id_col: str, first: Column) -> DataFrame:
        """The tie columns of the log's rows that are not the kept copy of their message; the log must be what was inserted."""
        repeated = self.table.read().filter("_n > 1").select("_shard", *KEY, F.struct(*self.tie).alias("_kept"))
        met = self._rows(log, id_col, first).join(repeated, ["_shard", *KEY])
        return met.filter(F.struct(*self.tie) != F.col("_kept")).select(*self.tie)
