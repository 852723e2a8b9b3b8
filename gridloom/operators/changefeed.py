"""Problem 2: a stream of inserts, updates and deletes applied as a signed multiset.

Every change, once deduplicated, takes away its before-image (what its entity had just before, in the order of the changes)
and adds its after-image (of a delete, a tombstone). Summing the multiplicities of equal images, those of the state before
included, leaves one for what stands and nought for all others; tombstones stay in the state and out of the table. Sums are order-free and combine on the map side, so that
deliveries may be repeated, late or split over any partitions; only the order within an entity's timeline needs neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.timeparse import DAY, bucket_of
from gridloom.operators.sequences import with_previous


def operation(op: Column) -> Column:
    """i, u or d from any writing of insert, update or delete; null for anything else."""
    first = F.lower(F.trim(op))
    return (
        F.when(first.isin("i", "ins", "insert", "inserted", "c", "create", "created", "add", "added", "new", "r", "read"), "i")
        .when(first.isin("u", "upd", "update", "updated", "upsert", "modify", "modified", "change", "changed"), "u")
        .when(first.isin("d", "del", "delete", "deleted", "remove", "removed"), "d")
    )


def distinct_changes(feed: DataFrame, entity: str, op: str, at: str, sequence: str, delivery: list[str], values: list[str]) -> DataFrame:
    """One row per change: the delivery with the least delivery columns. at is in microseconds.

    Messages with a null or blank entity, a null at or sequence, or an op that is no insert, update or delete are no changes.
    """
    ok = feed.withColumn(op, operation(F.col(op))).filter(F.col(entity).rlike(r"\S") & F.col(at).isNotNull() & F.col(sequence).isNotNull() & F.col(op).isNotNull())
    others = [op, *[v for v in values if v not in (op, *delivery)]]
    return ok.groupBy(entity, at, sequence).agg(F.min(F.struct(*delivery, *others)).alias("_c")).select(entity, at, sequence, "_c.*")


def signed_images(changes: DataFrame, entity: str, op: str, at: str, sequence: str, values: list[str], bucket: int = DAY) -> DataFrame:
    """The images of all changes with their multiplicities (column multiplicity: -1 before, +1 after). The image of a delete has op d: a tombstone."""
    image = list(dict.fromkeys([op, at, sequence, *values]))
    chained = with_previous(changes.select(entity, *image), [entity], [at, sequence], image, bucket_of(F.col(at), bucket))
    after = F.struct(F.lit(1).alias("multiplicity"), *image)
    before = F.when(F.col("prev_" + sequence).isNotNull(), F.struct(F.lit(-1).alias("multiplicity"), *[F.col("prev_" + c).alias(c) for c in image]))
    return chained.select(entity, F.explode(F.array_compact(F.array(after, before))).alias("_i")).select(entity, "_i.*")


def advance(state: DataFrame | None, feed: DataFrame, entity: str, op: str, at: str, sequence: str, delivery: list[str], values: list[str], bucket: int = DAY) -> DataFrame:
    """The state after the feed: entity, op (i, u or, for an entity that is gone, d), at, sequence, delivery and values of the change that stands.

    state: what an earlier call gave, or None. It keeps tombstones, so that a late change cannot bring back what a later one
    deleted: the state after any split of a feed into calls, in any order, is that after the whole feed at once.
    """
    columns = list(dict.fromkeys([entity, op, at, sequence, *delivery, *values]))
    given = feed.select(*columns)
    if state is not None:
        given = given.unionByName(state.select(*columns))
    changes = distinct_changes(given, entity, op, at, sequence, delivery, values)
    images = signed_images(changes, entity, op, at, sequence, [*delivery, *values], bucket)
    total = images.groupBy(*columns).agg(F.sum("multiplicity").alias("multiplicity"))
    return total.filter("multiplicity > 0").drop("multiplicity")


def standing(state: DataFrame, op: str) -> DataFrame:
    """The rows of a state that are there."""
    return state.filter(F.col(op) != "d").drop(op)


def apply_changes(feed: DataFrame, entity: str, op: str, at: str, sequence: str, delivery: list[str], values: list[str], base: DataFrame | None = None, bucket: int = DAY) -> DataFrame:
    """The table after the whole feed: entity, at and sequence (of the change that stands) and values.

    base, if given, is a state as of advance (with op and delivery) or a table without them, whose rows count as inserts that came
    before all of the feed's deliveries. An empty feed gives the base. Changes that tie in at and sequence are deliveries of one change.
    """
    if base is not None:
        first = {d: F.lit(None).cast(feed.schema[d].dataType) for d in delivery if d not in base.columns}  # nulls are least
        base = base.withColumns(first | ({} if op in base.columns else {op: F.lit("i")}))
    return standing(advance(base, feed, entity, op, at, sequence, delivery, values, bucket), op).drop(*[d for d in delivery if d not in values])
