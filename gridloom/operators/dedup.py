"""Problem 4: messages delivered more than once.

An identifier of fixed width is permuted by a bijection and split: the leading bits (the quotient) name a shard, the remaining
bits are the remainder. A shard's table holds complete remainders, each once, so that two identifiers meet only if they are
equal: there are no false matches, as in a filter that stores part of a remainder. A table keeps longs alone (how often the
identifier was met, the earliest delivery, the salts of its rows), so it is built by hash aggregation, and copies combine on the
map side: a third of all rows may be copies of one message and still a task sees one row of it from each map task.
`QuotientTables` (store/quotients.py) keeps the tables between batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.identifiers import hex_halves, permuted, uuid_hex
from gridloom.session import cut

QUOTIENT_BITS = 16
#: In this order a sort is mostly settled by the first column.
KEY = ["_low", "_high", "_quotient", "_other"]
LAST = 2**63 - 1
#: The rows of one identifier are looked up in so many parts.
SALTS = 64


def has_id(id_col: str) -> Column:
    """Whether a row's identifier is neither null nor blank. To be asked of the raw rows: a condition on what with_identity adds would be
    pushed below it and compute it all a second time."""
    return F.coalesce(F.col(id_col).cast("string").rlike(r"\S"), F.lit(False))


def with_identity(df: DataFrame, id_col: str, quotient_bits: int = QUOTIENT_BITS) -> DataFrame:
    """Adds the quotient and the remainder of each row's identifier.

    An identifier that is no UUID has its trimmed text as remainder (in _other), exact as well. Rows whose identifier is null
    or blank have a null quotient: each of them is a message of its own.
    """
    text = F.col(id_col).cast("string")
    high, low = hex_halves(F.col("_hex"))
    halves = df.withColumn("_hex", uuid_hex(text)).select(
        *df.columns,
        F.when(F.col("_hex").isNotNull(), high).when(text.rlike(r"\S"), F.xxhash64(F.trim(text))).alias("_high"),
        F.when(F.col("_hex").isNotNull(), low).when(text.rlike(r"\S"), F.xxhash64(F.trim(text), F.lit(1))).alias("_low"),
        F.coalesce(F.when(F.col("_hex").isNull(), F.trim(text)), F.lit("")).alias("_other"),
    )
    return permuted(halves, "_high", "_low").select(
        *df.columns,
        F.shiftrightunsigned("_high", 64 - quotient_bits).alias("_quotient"),
        F.coalesce(F.col("_high").bitwiseAND(F.lit((1 << (64 - quotient_bits)) - 1)), F.lit(0).cast("bigint")).alias("_high"),
        F.coalesce("_low", F.lit(0).cast("bigint")).alias("_low"),
        "_other",
    )


def identified(df: DataFrame, id_col: str) -> DataFrame:
    """with_identity of the rows that have an identifier; no column of KEY is nullable, so that joins add no condition on them (see has_id)."""
    return with_identity(df.filter(has_id(id_col)), id_col).withColumn("_quotient", F.coalesce("_quotient", F.lit(0).cast("bigint")))


def first_copies(df: DataFrame, id_col: str, first: Column, tie: list[str], values: list[str]) -> DataFrame:
    """The kept copy of each message: one row per identifier, with the columns of tie and values.

    Kept is the copy with the least `first` (nulls last), then the least tie columns (which name a row, so must be unique
    together and not null). Rows without an identifier are all kept. An empty table gives an empty one; extra columns of
    any name (but for those starting with an underscore) do no harm.
    """
    row = F.struct(F.coalesce(first, F.lit(LAST)).alias("_first"), *tie, *[v for v in values if v not in tie]).alias("_row")
    kept = identified(df, id_col).select(*KEY, row).groupBy(*KEY).agg(F.min("_row").alias("_row"))
    return kept.select("_row.*").unionByName(df.filter(~has_id(id_col)).select(row).select("_row.*")).drop("_first")


def shard_tables(rows: DataFrame) -> DataFrame:
    """The tables of all shards: each identifier of rows (KEY, _first, _salt) once, with _n, _least and the bits of its salts."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_salt"))
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.min("_first").alias("_least"), F.bit_or(bit).alias("_salts"))


def later_copies(df: DataFrame, id_col: str, first: Column, tie: list[str]) -> DataFrame:
    """The rows that are not the kept copy of their message, as their tie columns; kept as in first_copies.

    Only identifiers met more than once are looked up again, each under the salts its rows have, so that the copies of one
    message are spread over up to SALTS tasks.
    """
    salt = F.pmod(F.xxhash64(*tie), F.lit(SALTS)).cast("int")
    rows = identified(df, id_col).select(*KEY, F.coalesce(first, F.lit(LAST)).alias("_first"), *tie, salt.alias("_salt"))
    repeated = shard_tables(rows).filter("_n > 1")
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit(F.col("_salts"), k) == 1))
    copies = cut(rows.join(repeated.select(*KEY, "_least", each.alias("_salt")), [*KEY, "_salt"]).drop("_salt"))  # only rows of messages met more than once
    kept = copies.filter("_first = _least").groupBy(*KEY).agg(F.min(F.struct(*tie)).alias("_kept")).select("_kept.*")
    return copies.select(*tie).join(kept, tie, "left_anti")
