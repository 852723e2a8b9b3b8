"""Problem 3: irregular readings onto a regular grid.

Readings are cumulative counters, or the energy of an interval, which is a counter that starts anew with every message. Resets
are detected, consecutive readings differenced, and each increment is spread over the grid cells its interval overlaps, in
proportion to the overlap. Cells in which no reading lies are marked: 'filled' where an increment reaches into them, else
'missing'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.timeparse import DAY, HOUR, bucket_of
from gridloom.operators.sequences import with_previous


def increments(readings: DataFrame, source: str, at: str, value: str, counter: bool, span: int = HOUR, bucket: int = DAY) -> DataFrame:
    """Source, at, begin and amount of each reading: the amount accrued over [begin, at).

    counter: value is cumulative; a value below the one before is a reset, after which it counts from nought; a source's first
    reading and one after a null value have a null amount. Otherwise the counter is reset with every message, and value accrued over `span` before the
    message, or since the message before if that is later. Rows without source or time are no readings; a null value is a
    reading whose amount is null. Readings of one source at the same instant: the first spans back, the others have no length.
    """
    ok = readings.filter(F.col(source).isNotNull() & F.col(at).isNotNull()).select(source, at, value)
    chained = with_previous(ok, [source], [at, value], [at, value], bucket_of(F.col(at), bucket))
    if counter:
        before = F.col("prev_" + value)
        amount = F.when(F.col(value) >= before, F.col(value) - before).when(F.col(value) < before, F.col(value))
        begin = F.coalesce(F.col("prev_" + at), F.col(at))
    else:
        amount = F.col(value)
        begin = F.greatest(F.col(at) - F.lit(span), F.coalesce("prev_" + at, F.col(at) - F.lit(span)))
    return chained.select(source, at, begin.alias("begin"), amount.alias("amount"))


def spread(pieces: DataFrame, source: str, at: str, step: int = HOUR, period: int = DAY) -> DataFrame:
    """Increments by grid cell: source, cell (its number), cells, amount, covered (microseconds) and readings (1 in the cell of at).

    Cells are those of the periods in which the increment begins and ends; the whole periods between come as one row, whose `cells` is
    their number of cells (else 1), however long the gap was.
    """
    per = period // step
    cells = pieces.withColumns({"_f": bucket_of(F.col("begin"), step), "_l": bucket_of(F.col(at), step)})
    whole = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(per).cast("bigint"))
    # _b, _e: the cells in which the periods between begin and end. Column by column, so that nothing is computed twice.
    cells = cells.withColumns({"_b": whole("_f") + F.lit(per).cast("bigint"), "_e": whole("_l")})
    first, last, begins, ends, k = (F.col(c) for c in ("_f", "_l", "_b", "_e", "_k"))
    # the cells up to the end of the first period, the periods between as one, the cells of the last period
    gap = ends > begins
    cells = cells.withColumn("_n", F.when(gap, begins - first + last - ends + 2).otherwise(last - first + 1))
    each = cells.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_k"))
    cell = F.when(~gap | (k < begins - first), first + k).when(k == begins - first, begins).otherwise(ends + (k - (begins - first) - 1))
    each = each.select(source, at, "begin", "amount", "_l", cell.alias("cell"), F.when(gap & (k == begins - first), ends - begins).otherwise(F.lit(1).cast("bigint")).alias("cells"))
    each = each.withColumn("covered", F.greatest(F.least(F.col(at), (F.col("cell") + F.col("cells")) * step) - F.greatest(F.col("begin"), F.col("cell") * step), F.lit(0)))
    here = (F.col("cell") == F.col("_l")) & (F.col("cells") == 1)
    share = F.when(F.col(at) > F.col("begin"), F.col("covered") / (F.col(at) - F.col("begin"))).otherwise(here.cast("double"))
    return each.filter(here | (F.col("covered") > 0)).select(source, "cell", "cells", (F.col("amount") * share).alias("amount"), "covered", here.cast("int").alias("readings"))


def regular_grid(readings: DataFrame, source: str, at: str, value: str, counter: bool = False, step: int = HOUR, period: int = DAY, span: int = HOUR) -> DataFrame:
    """The regular series of each source: every cell of each period in which it has a reading.

    Columns: source, cell_start (microseconds), amount (sum of the increments' shares, null if none is known), covered
    (microseconds of the cell within some reading's interval, at most the step), readings, status: 'observed', 'filled' (no
    reading in the cell, but an increment reaches into it) or 'missing', and cells. period must be a multiple of step. in_use is true
    for periods with a reading. What of an increment falls in periods without readings comes out too, with readings 0 and in_use
    false: the period it begins in as cells, the whole periods between two readings as one row of as many `cells` (else 1).
    An empty table gives an empty grid.
    """
    per = period // step
    pieces = increments(readings, source, at, value, counter, span)
    cells = spread(pieces, source, at, step, period).groupBy(source, "cell", "cells").agg(F.sum("amount").alias("amount"), F.sum("covered").alias("covered"), F.sum("readings").alias("readings"))
    group = (F.col("cell") - F.pmod(F.col("cell"), F.lit(per).cast("bigint"))).alias("_first")
    k = F.pmod(F.col("cell"), F.lit(per).cast("bigint"))
    single = F.when(F.col("cells") == 1, F.struct(k.alias("k"), F.struct("amount", "covered", "readings").alias("cell")))
    gap = F.when(F.col("cells") > 1, F.struct("cells", "amount", "covered"))
    # at most period / step entries; a gap begins a period in which nothing else lies
    periods = cells.groupBy(source, group).agg(F.map_from_entries(F.collect_list(single)).alias("_found"), F.max(gap).alias("_gap"), (F.sum("readings") > 0).alias("in_use"))
    slots = F.when(F.col("_gap").isNotNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.lit(per - 1).cast("bigint")))
    each = periods.select(source, "_first", "_found", "_gap", "in_use", F.explode(slots).alias("_k"))
    cell = F.try_element_at("_found", F.col("_k"))
    n = F.coalesce(cell["readings"], F.lit(0))
    covered = F.coalesce(F.col("_gap")["covered"], cell["covered"], F.lit(0))
    return each.select(
        source,
        ((F.col("_first") + F.col("_k")) * F.lit(step)).alias("cell_start"),
        F.coalesce(F.col("_gap")["amount"], cell["amount"]).alias("amount"),
        F.least(covered, F.coalesce(F.col("_gap")["cells"], F.lit(1)) * F.lit(step)).alias("covered"),
        n.alias("readings"),
        F.when(n > 0, "observed").when(covered > 0, "filled").otherwise("missing").alias("status"),
        "in_use",
        F.coalesce(F.col("_gap")["cells"], F.lit(1).cast("bigint")).alias("cells"),
    )
