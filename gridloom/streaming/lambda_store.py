"""Lambda views as tables (problem 5, kept up to date): the batch layer and the fast layer over a log.

The log is the master copy and belongs to the caller. `increment` is the fast layer: it stores the totals of the messages that
came with a delivery and not before. `recompute` is the scheduled batch: it computes the windows that are still open from the log,
replaces their totals and drops the increments that it makes void; windows whose cut-off has passed by then are frozen. Both
read only what belongs to open windows, and both may run again after a crash: an increment replaces itself by its delivery, and
the batch layer's content and the delivery it goes up to are published together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.timeparse import DAY, HOUR, bucket_of
from gridloom.operators.dedup import first_copies
from gridloom.operators.lateness import ENERGY, first_open, last_batch, window_totals
from gridloom.session import cut
from gridloom.store.keyed import KeyedTable

BEFORE_ALL = -(2**62)


class LambdaStore:
    """log columns: id_col, event_at and published_at (microseconds), arrival (a bigint that does not fall from delivery to delivery: the
    delivery's number or the instant it came), tie, keys and the summed columns. Copies of a message must agree in their event time."""

    def __init__(
        self, spark: SparkSession, path: str, keys: T.StructType, sums: dict[str, str], window: int, cutoff: int, id_col: str = "event_id", event_at: str = "at", published_at: str = "emitted", arrival: str = "emitted", tie: tuple[str, ...] = ("log_offset", "log_partition")
    ):
        self.spark, self.keys, self.sums, self.window, self.cutoff = spark, list(keys.names), sums, window, cutoff
        self.id_col, self.event_at, self.published_at, self.arrival, self.tie = id_col, event_at, published_at, arrival, list(tie)
        totals = [*keys.fields, T.StructField("window_at", T.LongType()), *[T.StructField(n, T.DecimalType(38, 9)) for n in sums], T.StructField("counted", T.LongType())]
        self.batch = KeyedTable(spark, f"{path}/batch", T.StructType([*totals, T.StructField("day", T.LongType())]), [*self.keys, "window_at", "day"], "day")
        self.fast = KeyedTable(spark, f"{path}/fast", T.StructType([*totals, T.StructField("delivery", T.LongType())]), [*self.keys, "window_at", "delivery"], "delivery")

    @property
    def upto(self) -> int:
        """The last delivery that the batch layer has."""
        return self.batch.notes.get("upto", BEFORE_ALL)

    @property
    def open_from(self) -> int:
        """The start of the first window that isn't frozen."""
        return self.batch.notes.get("open_from", BEFORE_ALL)

    def _totals(self, log: DataFrame, upto: int, first: str, after: int | None = None) -> DataFrame:
        """Totals of the messages of open windows that came up to a delivery, of their copy with the least `first`; of those that came with the
        deliveries after `after` alone. What belongs to frozen windows is left out before anything else is done with a row."""
        came = F.col(self.arrival) <= F.lit(upto)
        rows = log if self.open_from == BEFORE_ALL else log.filter(F.col(self.event_at) >= F.lit(self.open_from))
        if first != self.arrival:
            rows = rows.filter(came)
        values = list(dict.fromkeys([self.published_at, self.event_at, self.arrival, *self.keys, *self.sums.values()]))
        messages = first_copies(rows, self.id_col, F.col(first), self.tie, values)
        # the copy that came first has come if any has: asked of fewer rows, and times need not be read for it again
        messages = messages.filter(came if after is None else came & (F.col(self.arrival) > F.lit(after)))
        return window_totals(messages, self.keys, self.event_at, self.published_at, self.sums, self.window, self.cutoff)

    def increment(self, log: DataFrame, after: int, upto: int) -> None:
        """The delivery after..upto: totals of the messages of open windows of which it brought the first copy."""
        fresh = self._totals(log, upto, self.arrival, after).withColumn("delivery", F.lit(upto).cast("bigint"))
        self.fast.replace(fresh, lambda part: part == str(upto))

    def recompute(self, log: DataFrame, upto: int, now: int) -> None:
        """The scheduled batch at an instant (microseconds) over what has come up to a delivery."""
        open_from = self.open_from
        fresh = self._totals(log, upto, self.published_at).withColumn("day", bucket_of(F.col("window_at"), DAY))
        if open_from != BEFORE_ALL:  # frozen windows of the day of the first open one
            fresh = fresh.unionByName(self.batch.read([str(open_from // DAY)]).filter(F.col("window_at") < F.lit(open_from)))
        closed = max(open_from, first_open(now, self.window, self.cutoff))
        self.batch.replace(fresh, lambda part: part == "null" or int(part) >= open_from // DAY, {"upto": upto, "open_from": closed})
        if any(int(part) <= upto for part in self.fast.parts):
            self.fast.replace(self.fast.read([]), lambda part: int(part) <= upto)

    def view(self) -> DataFrame:
        """keys, window_at, totals, provisional (whether a part of them is the fast layer's), frozen and counted."""
        since = [p for p in self.fast.parts if int(p) > self.upto]
        fast = self.fast.read(since).filter(F.col("window_at") >= F.lit(self.open_from)).drop("delivery")
        both = self.batch.read().drop("day").withColumn("_fast", F.lit(False)).unionByName(fast.withColumn("_fast", F.lit(True)))
        total = both.groupBy(*self.keys, "window_at").agg(*[F.sum(n).cast(ENERGY).alias(n) for n in self.sums], F.sum("counted").alias("counted"), F.bool_or("_fast").alias("provisional"))
        return total.withColumn("frozen", F.col("window_at") < F.lit(self.open_from))

    def catch_up(self, log: DataFrame, as_of: int, every: int = 6 * HOUR) -> None:
        """Brings an empty store over a log whose arrival is an instant to as_of: the last two scheduled batches, the second of which
        finds most windows frozen and replaces the rest, then the increments since."""
        last = last_batch(as_of, every)
        self.recompute(log, last - every, last - every)
        columns = dict.fromkeys([self.id_col, self.event_at, self.published_at, self.arrival, *self.tie, *self.keys, *self.sums.values()])
        # what belongs to open windows is read from the log once for both layers
        recent = cut(log.filter(F.col(self.event_at) >= F.lit(self.open_from)).select(*columns))
        self.recompute(recent, last, last)
        self.increment(recent, last, as_of)
