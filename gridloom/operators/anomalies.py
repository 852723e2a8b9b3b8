"""Problem 6: implausible values, judged by what their source usually sends.

Quantile sketches (KLL) are built per source, measure and hour-of-day context and merged across partitions, then across contexts.
A value is a spike if it lies outside its context's expanded interquartile fence and far above the source's regular top, or if it
rises from the message before and falls to the next at a rate that nothing else of its source explains.
Rates and zero variance over a run of messages are found along each source's timeline in time buckets, so that a hot source is spread over
tasks; only neighbours across a bucket's edge, and the runs that touch it, are followed from bucket to bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.timeparse import DAY, HOUR, bucket_of
from gridloom.operators.dedup import KEY, with_identity
from gridloom.session import cut


@dataclass(frozen=True)
class Limits:
    """What counts as implausible; the same at every size of data."""

    contexts: int = 6  # parts of the day
    sketch: int = 1024  # size of a KLL sketch: rank error about 0.3 %
    fence: float = 2.0  # interquartile ranges above the third quartile of the context
    peak: float = 0.9  # the quantile that stands for regular peaks of the context
    above_peak: float = 2.0  # times that
    few: int = 10  # a context of fewer usable messages, whose own 0.9 quantile is its greatest value, takes the fence of the whole source
    top: float = 0.985  # the quantile that stands for a source's regular top
    top_positive: float = 0.96  # the same for measures of which only values above 0 are used
    shoulder: float = 0.97  # below the top, for sources of which a few spikes reach the top quantile
    jump: float = 2.6  # times the top
    jump_shoulder: float = 4.0  # times the shoulder, if the values above it don't lie close together (a rare regular peak)
    scatter: float = 1.6
    apart: int = 3 * HOUR  # neighbours of a value tell its rate of change if they are no farther
    often: int = 3  # days with a jump in one hour of the day make it a regular peak
    run: int = 8  # messages of one value
    level: float = 0.05  # a value is a level of its source if so large a share of its messages are in runs of it
    levels: float = 0.95  # a source has fixed levels if its levels make up so much of its messages
    night: tuple[int, int] = (20, 4)  # hours without sun: from, before


def sketches(rows: DataFrame, source: str, at: str, measures: dict[str, bool], limits: Limits) -> DataFrame:
    """Per source (not null) a struct for each measure: spike (for each context, and last for values without time, what a value must be above to
    be a spike; null if none is known) and low (the 0.9 quantile; null if there are few values).

    measures: name -> whether only values above 0 are used (else values of 0 or more). A value is a spike if it is far above the source's regular
    top and outside the upper fence of its context. A context's regular peaks raise its fence, but not if they lie as far above the source's
    top as spikes do: then they are spikes, and the interquartile fence stands alone. Contexts of few values, and values without time, have the
    fence of the whole source.
    """
    context = F.coalesce(F.pmod(bucket_of(F.col(at), DAY // limits.contexts), F.lit(limits.contexts)), F.lit(-1)).cast("int").alias("_context")
    usable = lambda m: F.when((F.col(m) > 0 if measures[m] else F.col(m) >= 0) & ~F.isnan(m), F.col(m).cast("double"))
    by_context = rows.groupBy(source, context).agg(*[F.kll_sketch_agg_double(usable(m), limits.sketch).alias(m) for m in measures], *[F.max(usable(m)).alias("_most_" + m) for m in measures])

    def at_rank(sketch: Column, rank: float) -> Column:
        return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(rank)))

    def quartile_fence(sketch: Column) -> Column:
        return at_rank(sketch, 0.75) + limits.fence * (at_rank(sketch, 0.75) - at_rank(sketch, 0.25))

    fenced = by_context.select(
        source,
        *measures,
        *["_most_" + m for m in measures],
        *[F.struct("_context", F.kll_sketch_get_n_double(m).alias("n"), quartile_fence(F.col(m)).alias("fence"), at_rank(F.col(m), limits.peak).alias("peak")).alias("_fence_" + m) for m in measures],
    )
    merged = fenced.groupBy(source).agg(
        *[F.kll_merge_agg_double(m, limits.sketch).alias(m) for m in measures],
        *[F.max("_most_" + m).alias("_most_" + m) for m in measures],
        *[F.collect_list("_fence_" + m).alias("_fence_" + m) for m in measures],  # at most contexts + 1 entries
    )

    def fences(m: str, top: Column) -> Column:
        own = lambda e: F.when(e["peak"] > limits.jump * top, e["fence"]).otherwise(F.greatest(e["fence"], limits.above_peak * e["peak"]))
        kept = F.filter("_fence_" + m, lambda e: (e["_context"] >= 0) & (e["n"] >= limits.few))
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["_context"], own(e))))

    def spike(m: str) -> Column:
        top, shoulder = F.col("_top_" + m), at_rank(F.col(m), limits.shoulder if not measures[m] else limits.top_positive)
        # a few spikes may reach the top quantile: then the shoulder tells, unless the values above it lie close together
        far = F.when(F.col("_most_" + m) > limits.scatter * top, F.least(limits.jump * top, limits.jump_shoulder * shoulder)).otherwise(limits.jump * top)
        each = F.transform(F.sequence(F.lit(0), F.lit(limits.contexts)), lambda c: F.greatest(F.col("_far_" + m), F.coalesce(F.try_element_at("_fences_" + m, c), F.col("_whole_" + m), F.lit(0.0))))
        return {"_far_" + m: F.when(top > 0, far), "_fences_" + m: fences(m, top), "_whole_" + m: quartile_fence(F.col(m))}, F.when(F.col("_far_" + m).isNotNull(), each)

    tops = merged.withColumns({"_top_" + m: at_rank(F.col(m), limits.top_positive if measures[m] else limits.top) for m in measures})
    tops = tops.withColumns({n: c for m in measures for n, c in spike(m)[0].items()})
    low = lambda m: F.when(F.kll_sketch_get_n_double(m) >= limits.few, at_rank(F.col(m), limits.peak))
    return tops.select(source, *[F.struct(spike(m)[1].alias("spike"), low(m).alias("low")).alias(m) for m in measures])


def is_spike(value: Column, at: Column, profile: Column, limits: Limits) -> Column:
    """Whether value is far beyond what the profile of its source and measure shows."""
    context = F.coalesce(F.pmod(bucket_of(at, DAY // limits.contexts), F.lit(limits.contexts)).cast("int"), F.lit(limits.contexts))
    return F.coalesce(value > F.get(profile["spike"], context), F.lit(False))


#: The days of rows without time are numbered from here downwards.
UNTIMED = -(1 << 40)


def on_days(rows: DataFrame, source: str, at: str, bucket: int = DAY) -> DataFrame:
    """rows (with dedup.with_identity) of a source, spread by source and day; without a time, by their identity, on days of their own.

    All that follows takes these rows as they are, without a condition that would be pushed below the shuffle, so that Spark shuffles them once.
    """
    # never null, nor nullable: a join would ask
    placed = F.coalesce(bucket_of(F.col(at), bucket), F.lit(UNTIMED) - F.pmod("_low", F.lit(64)), F.lit(UNTIMED))
    return rows.filter(F.col(source).isNotNull()).withColumn("_day", placed).repartition(source, "_day")


def once(placed: DataFrame, source: str, at: str, row: list[str], measures: dict[str, bool]) -> DataFrame:
    """Each message of on_days once, as source, at and its measures; copies agree in them. A row without identifier is a message of its own."""
    alone = F.when(F.col("_quotient").isNull(), F.struct(*row)).alias("_alone")
    return placed.groupBy(source, "_day", at, *KEY, alone).agg(*[F.max(m).alias(m) for m in measures]).select(source, "_day", at, *measures)


def timeline(placed: DataFrame, source: str, at: str, row: list[str], measures: dict[str, bool]) -> DataFrame:
    """Rows of on_days, with what their source and day show around them (one pass over each source and day, in order of time; of no meaning for rows without time).

    _first, _last: of the day; _new: not a further copy of a message; per measure _at_ (time and value if the value is usable, that is, neither
    negative nor NaN), _b_ and _a_ (the usable values before and after, but for copies of the same message), _run_ (number of the run of one
    value within the day), _edge_ (the row is alone in its run) and _count_ (messages so far whose value can be stuck).
    """
    by = [source, "_day"]
    line = placed
    along = Window.partitionBy(*by).orderBy(at, *KEY, *row)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    over = f"ignore nulls over (partition by {', '.join(by)} order by {', '.join([at, *KEY, *row])})"
    copies = Window.partitionBy(*by, at, *KEY).orderBy(at, *KEY, *row).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    usable = lambda m: F.when((F.col(m) >= 0) & ~F.isnan(m), F.struct(F.col(at).alias("at"), F.col(m).cast("double").alias("v")))
    same = F.col("_quotient").isNotNull()
    for k in KEY:
        same = same & F.lag(k).over(along).eqNullSafe(F.col(k))
    line = line.withColumns({"_first": F.row_number().over(along) == 1, "_last": F.lead(at).over(along).isNull(), "_new": (~same).cast("int")} | {"_at_" + m: usable(m) for m in measures})
    line = line.withColumns({"_turn_" + m: F.col("_first") | ~F.lag(m).over(along).eqNullSafe(F.col(m)) for m in measures} | {"_ends_" + m: F.col("_last") | ~F.lead(m).over(along).eqNullSafe(F.col(m)) for m in measures})
    line = line.withColumns({n + m: F.expr(f"{f}(_at_{m}) {over}") for m in measures for n, f in (("_b_", "lag"), ("_a_", "lead"))})
    may = lambda m: F.when(may_stick(m, measures), F.col("_new")).otherwise(0)
    line = line.withColumns({"_run_" + m: F.sum(F.col("_turn_" + m).cast("int")).over(upto) for m in measures} | {"_count_" + m: F.sum(may(m)).over(upto) for m in measures})
    line = line.withColumns({"_b_" + m: F.first("_b_" + m).over(copies) for m in measures} | {"_a_" + m: F.last("_a_" + m).over(copies) for m in measures})
    return line.withColumns({"_edge_" + m: F.col("_turn_" + m) & F.col("_ends_" + m) for m in measures}).drop(*["_turn_" + m for m in measures], *["_ends_" + m for m in measures])


def may_stick(m: str, measures: dict[str, bool]) -> Column:
    return F.col(m) > 0 if measures[m] else F.col(m).isNotNull()


def days_of(messages: DataFrame, source: str, at: str, measures: dict[str, bool]) -> DataFrame:
    """Of messages (once) with a time: source, _day, and per measure the usable value (time and value) last before the day (_from_) and first after it (_to_)."""
    by = [source, "_day"]
    usable = lambda m: F.when((F.col(m) >= 0) & ~F.isnan(m), F.struct(F.col(at).alias("at"), F.col(m).cast("double").alias("v")))
    days = messages.groupBy(*by).agg(*[f(usable(m)).alias(n + m) for m in measures for n, f in (("_last_", F.max), ("_first_", F.min))], F.max(at).alias("_timed"))
    in_turn = Window.partitionBy(source).orderBy("_day")
    return days.filter("_timed is not null").select(*by, *[F.lag("_last_" + m).over(in_turn).alias("_from_" + m) for m in measures], *[F.lead("_first_" + m).over(in_turn).alias("_to_" + m) for m in measures])


def jump_parts(at: str, m: str, limits: Limits) -> Column:
    """The value, the one before and the one after (null if farther than limits.apart), in rows of timeline joined with days_of."""
    near = lambda e: F.when(F.abs(e["at"] - F.col(at)) <= limits.apart, e["v"])
    return F.struct(F.col("_at_" + m)["v"].alias("v"), near(F.coalesce("_b_" + m, "_from_" + m)).alias("b"), near(F.coalesce("_a_" + m, "_to_" + m)).alias("a"))


def sudden(near: DataFrame, source: str, at: str, row: list[str], limits: Limits) -> DataFrame:
    """row and measure of values that rise and fall again at an implausible rate: far above the messages before and after, and above
    the 0.9 quantile (low) of their source and all that lasts there for two messages. Jumps that recur at one hour on several days are regular peaks.

    near: source, at, row, measure, low, and _j as of jump_parts. Null and NaN values are passed over. A value whose neighbours are
    farther than limits.apart, or missing, has no rate. Copies of a message aren't its neighbours. Rows may be left out of near if what
    lasts in them, least(v, greatest(b, a)), is at most jump_shoulder / jump times low: they could not stop any value that is high enough.
    """
    some = near.filter(F.col("_j.v").isNotNull()).select(source, at, *row, "measure", "low", "_j.*")
    lasting = some.groupBy(source, "measure").agg(F.max(F.least("v", F.greatest("b", "a"))).alias("_lasting"))
    high = some.filter((F.col("v") > limits.jump * F.greatest("b", "a")) & F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("low") > 0) & (F.col("v") > limits.jump_shoulder * F.col("low")))
    high = high.join(lasting, [source, "measure"]).filter(F.col("v") > limits.jump * F.col("_lasting"))
    hour = Window.partitionBy(source, "measure", F.pmod(bucket_of(F.col(at), HOUR), F.lit(24)))
    return high.withColumn("_days", F.size(F.collect_set(bucket_of(F.col(at), DAY)).over(hour))).filter(F.col("_days") < limits.often).select(*row, "measure")


def run_part(m: str) -> Column:
    return F.struct(F.col(m).cast("double").alias("value"), F.col("_run_" + m).alias("run"), F.col("_count_" + m).alias("count"))


def in_runs(near: DataFrame, source: str, row: list[str], measures: dict[str, bool], limits: Limits) -> DataFrame:
    """row and measure of the values in runs of at least limits.run successive messages of one value.

    near: source, _day, row, _first, _last, _new, measure and _r as of run_part; rows alone in their run, or whose value cannot be stuck, may be left
    out, but for the first and last of a day. Copies of a message count once, and all of them come out. A null value ends a run; of
    measures that map to true, values of 0 or less are never stuck. Sources with a few fixed levels (of values that can be stuck) are left out.
    """
    by = [source, "_day"]
    near = near.select(*by, *row, "_first", "_last", "_new", "measure", "_r.*")
    runs = near.groupBy(*by, "measure", "run").agg(
        F.first("value").alias("value"), F.sum("_new").alias("n"), F.max("_last").alias("last"), F.max(F.when(F.col("_last"), F.col("count"))).alias("in_day")
    ).withColumn("first", F.col("run") == 1)
    inner = runs.filter(~F.col("first") & ~F.col("last")).withColumn("total", F.col("n"))
    order = Window.partitionBy(source, "measure").orderBy("_day", "run")
    goes_on = F.lag("last").over(order) & F.col("first") & F.lag("value").over(order).eqNullSafe(F.col("value"))
    edge = runs.filter(F.col("first") | F.col("last")).withColumn("_starts", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    edge = edge.withColumn("_chain", F.sum("_starts").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(source, "measure", "_chain"))).drop("_chain")
    positive = [m for m, p in measures.items() if p]
    fit = F.col("value").isNotNull() & (~F.col("measure").isin(positive) | (F.col("value") > 0))
    found = inner.unionByName(edge.drop("_starts")).filter(fit & (F.col("total") >= limits.run)).select(*by, "measure", "run")
    # sources with fixed levels: values that come back and back, or (of measures that are never off) the only one ever sent
    total = runs.filter("last").groupBy(source, "measure").agg(F.sum("in_day").alias("in_all"))
    whole = inner.unionByName(edge.filter("_starts = 1").drop("_starts")).filter(fit & (F.col("total") > 1))
    level = whole.groupBy(source, "measure", "value").agg(F.sum("total").alias("n"), F.count(F.lit(1)).alias("times")).join(total, [source, "measure"])
    level = level.filter((F.col("n") >= limits.level * F.col("in_all")) & ((F.col("times") > 1) | (~F.col("measure").isin(positive) & (F.col("n") >= F.col("in_all")))))
    fixed = level.groupBy(source, "measure").agg((F.sum("n") / F.first("in_all")).alias("share")).filter(F.col("share") >= limits.levels).select(source, "measure")
    return near.join(found.join(fixed, [source, "measure"], "left_anti"), [*by, "measure", "run"], "left_semi").select(*row, "measure")


def stuck(rows: DataFrame, source: str, at: str, row: list[str], measures: dict[str, bool], limits: Limits, bucket: int = DAY) -> DataFrame:
    """in_runs of rows with the columns of dedup.with_identity. Rows without source or time are not in a series."""
    line = timeline(on_days(rows, source, at, bucket), source, at, row, measures).filter(F.col(at).isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), run_part(m).alias("_r"), (may_stick(m, measures) & ~F.col("_edge_" + m)).alias("_keep")) for m in measures]))
    near = line.select(source, "_day", *row, "_first", "_last", "_new", each.alias("_m")).select("*", "_m.*").filter(F.coalesce("_keep", F.lit(False)) | F.col("_first") | F.col("_last"))
    return in_runs(cut(near.drop("_m", "_keep")), source, row, measures, limits)


def implausible(readings: DataFrame, sources: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """row and measure of every implausible value, and why (the first rule that it breaks).

    readings: log_partition, log_offset (the row), event_id, meter_id, household_id, power_consumption_kwh,
    solar_generation_kwh, at (microseconds, may be null). sources: meter_id, household_id, has_solar, solar_capacity_kw.
    A reading without meter is judged by its household's, but is in no series. Null and NaN values are not implausible; without a known
    capacity none is exceeded. Copies are rows of their own. Empty tables give an empty result.

    The log is gone through once in order of time, by source and day: each row meets its source's profile there, and only rows that break a
    rule, or that a jump or a run may hang on, are kept for what goes beyond a day.
    """
    row = ["log_partition", "log_offset"]
    use, sun = "power_consumption_kwh", "solar_generation_kwh"
    measures = {use: False, sun: True}
    filled = lambda c: F.when(F.col(c).rlike(r"\S"), F.col(c))
    rows = readings.select(*row, "event_id", filled("meter_id").alias("_meter"), F.concat(F.lit("h:"), filled("household_id")).alias("_home"), *measures, "at")
    series = with_identity(rows.filter("_meter is not null"), "event_id").select(*row, "_meter", *measures, "at", *KEY)
    placed = on_days(series, "_meter", "at")
    messages = once(placed, "_meter", "at", row, measures)
    profile = sketches(messages, "_meter", "at", measures, limits)
    known = sources.groupBy(filled("meter_id").alias("_meter")).agg(F.max("household_id").alias("_household"), F.max("has_solar").alias("has_solar"), F.max("solar_capacity_kw").alias("capacity")).filter("_meter is not null")
    profile = profile.join(known, "_meter", "full").select("_meter", "_household", F.struct(*measures, "has_solar", "capacity").alias("_p"))

    def whys() -> dict[str, Column]:
        p, at = F.col("_p"), F.col("at")
        hour = F.pmod(bucket_of(at, HOUR), F.lit(24))
        dark = (hour >= limits.night[0]) | (hour < limits.night[1])
        real = lambda m, why: F.when(~F.isnan(m), why)
        value = F.col(sun)
        return {
            use: real(use, F.when(F.col(use) < 0, "negative").when(is_spike(F.col(use), at, p[use], limits), "spike")),
            sun: real(
                sun,
                F.when(value < 0, "negative")
                .when((value > 0) & (~p["has_solar"] | (p["capacity"] <= 0)), "no_panels")
                .when(value > p["capacity"], "above_capacity")
                .when((value > 0) & dark, "dark")
                .when(is_spike(value, at, p[sun], limits), "spike"),
            ),
        }

    days = days_of(messages, "_meter", "at", measures).join(profile.drop("_household"), "_meter", "left")
    line = timeline(placed, "_meter", "at", row, measures).join(days, ["_meter", "_day"])
    each = F.array(*[F.struct(F.lit(m).alias("measure"), why.alias("why"), F.col("_p")[m]["low"].alias("low"), jump_parts("at", m, limits).alias("_j"), run_part(m).alias("_r"), F.coalesce(may_stick(m, measures) & ~F.col("_edge_" + m), F.lit(False)).alias("_runs")) for m, why in whys().items()])
    lasts = lambda j: F.least(j["v"], F.greatest(j["b"], j["a"]))
    held = ["_meter", "_day", "at", *row, "_first", "_last", "_new"]
    near = line.select(*held, F.explode(each).alias("_x")).select(*held, "_x.*")  # asked after the explosion, as conditions within arrays are not compiled
    j, low = F.col("_j"), F.col("low")
    hangs = (lasts(j) > limits.jump_shoulder / limits.jump * low) | ((j["v"] > limits.jump_shoulder * low) & (j["v"] > limits.jump * F.greatest(j["b"], j["a"])))
    near = near.filter(F.col("why").isNotNull() | F.col("_runs") | F.coalesce(hangs, F.lit(False)) | F.col("_first") | F.col("_last"))
    # readings without a meter, or without a time, are in no series
    homes = profile.filter("_household is not null").groupBy(F.concat(F.lit("h:"), F.col("_household")).alias("_source")).agg(F.first("_p").alias("_p"))
    judges = profile.select(F.col("_meter").alias("_source"), "_p").unionByName(homes)
    loose = rows.filter("_meter is null or at is null").withColumn("_source", F.coalesce("_meter", "_home")).join(judges, "_source", "left")
    loose = loose.select(*row, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), why.alias("why")) for m, why in whys().items()])).alias("_f")).select(*row, "_f.*")
    near = cut(near.unionByName(loose.filter("why is not null"), allowMissingColumns=True))
    line = near.filter("_meter is not null")
    found = near.filter("why is not null").select(*row, "measure", "why")
    found = found.unionByName(sudden(line, "_meter", "at", row, limits).withColumn("why", F.lit("spike")))
    found = found.unionByName(in_runs(line.filter("_runs or _first or _last"), "_meter", row, measures, limits).withColumn("why", F.lit("stuck")))
    return found.groupBy(*row, "measure").agg(F.min("why").alias("why"))
