"""Problem 8: mixing sources to target weights.

Sizes are token counts of the whole corpus. Temperature mixing gives a source the weight share ** e, its share of the corpus's
tokens put to an exponent: 1 at e = 0, ever less as e grows. Here every source has an exponent of its own, bisected: the least at
which its weight is no more than its target share and the repetition limit holds (weight times the size of the mix is no more than
max_repeats times the source's tokens). Where it is the limit that decides, the source cannot reach its target. What a source
lacks is not given to others, so that they still meet their targets; weights normalised over the mix are reported as well.

A weight times the size of the mix is the source's budget, and budgets become documents by block permutations: a source is drawn
whole as often as its budget allows, and the rest is a prefix of a permutation of its blocks, of which only the last is taken in
part. Documents are put into blocks by hash, so that only sums of blocks, never a source's documents, are put in order as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import ship

#: Blocks of a source; a hot source of 10^9 documents has a million in each.
BLOCKS = 1024
STEPS = 80

WEIGHTS = "mix_name string, source string, target_share double, max_repeats int, total_tokens bigint, n_tokens bigint, capacity double, needed double, reachable boolean, share double, exponent double, weight double, normalised_weight double, budget bigint"


def bisected(holds: Callable[[float], bool], low: float = 0.0) -> float:
    """The least exponent not below low (as near as STEPS halvings come) from which on the condition holds; it must hold for large ones."""
    if holds(low):
        return low
    high = max(1.0, 2 * low)
    while not holds(high):
        low, high = high, 2 * high
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def weigh(mix: pd.DataFrame) -> pd.DataFrame:
    """The weights of one mix (at most as many rows as the plan has). A share of 1 stays 1 at any exponent: such a source has
    what target and limit allow."""
    mix = mix.sort_values("source", na_position="last").reset_index(drop=True)
    exponents, weights, capacities, needs, reachable, shares = [], [], [], [], [], []
    for tokens, corpus, target, repeats, size in zip(mix["n_tokens"], mix["corpus_tokens"], mix["target_share"], mix["max_repeats"], mix["total_tokens"]):
        tokens, size = float(tokens), max(float(size), 0.0)
        target = max(float(target), 0.0) if target == target and target is not None else 0.0
        capacity = float(repeats) * tokens
        share = tokens / float(corpus) if corpus else 0.0
        fits = lambda w, c=capacity, n=size: not c < w * n
        allowed = target if fits(target) else capacity / size
        if 0 < share < 1 and allowed > 0:
            exponent = bisected(lambda e: share**e <= target)  # noqa: B023
            exponent = bisected(lambda e: fits(share**e), exponent)  # noqa: B023
            weight = min(share**exponent, allowed)
        else:
            exponent, weight = None, allowed if share else 0.0
        exponents.append(exponent)
        weights.append(weight)
        capacities.append(capacity)
        needs.append(target * size)
        reachable.append(fits(target))
        shares.append(share)
    total = sum(weights)
    return mix.assign(
        capacity=capacities,
        needed=needs,
        reachable=reachable,
        share=shares,
        exponent=exponents,
        weight=weights,
        normalised_weight=[w / total if total > 0 else 0.0 for w in weights],
        budget=[round(w * float(n)) for w, n in zip(weights, mix["total_tokens"])],
    )


def mix_weights(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan's rows with their source's tokens, weights and budget (schema WEIGHTS; exponent is null where there is nothing to exponentiate).

    sized: source, n_tokens of every document. plan: mix_name, source, target_share, max_repeats, total_tokens; null numbers count
    as 0, repeated rows of a plan as one. Sources without documents have 0 tokens; documents of a null source or of one in no plan belong to no
    mix, but to the corpus. Token counts are summed on the map side, so a source may hold any part of the rows.
    """
    ship(sized.sparkSession)
    totals = sized.groupBy(F.col("source").alias("_source")).agg(F.sum("n_tokens").alias("n_tokens"))
    # one row a source
    totals = totals.withColumn("corpus_tokens", F.sum("n_tokens").over(Window.partitionBy(F.lit(0))))
    rows = plan.groupBy("mix_name", "source").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("target_share", "max_repeats", "total_tokens")])
    rows = rows.join(totals, F.col("source") == F.col("_source"), "left")
    columns = [x.strip().split(" ")[0] for x in WEIGHTS.split(",")]
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_tokens", "corpus_tokens")]
    return rows.select("mix_name", "source", "target_share", "max_repeats", "total_tokens", *counts).groupBy("mix_name").applyInPandas(lambda pdf: weigh(pdf)[columns], WEIGHTS)


def draw(sized: DataFrame, weights: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """mix_name, source, doc_id, n_tokens and copies (> 0) of every document drawn.

    sized: doc_id, source, n_tokens. Whole passes over a source come first. For the last, partial pass documents larger than what is left
    to draw are passed over, the others come in a permuted order, and the one that crosses the end is drawn if that ends nearer to the budget
    than doing without it. Documents without tokens are drawn with the whole passes alone and with full blocks; with a budget of 0 nothing is drawn.
    """
    docs = sized.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    budget = weights.select("mix_name", F.col("source").alias("_s"), "budget", F.col("n_tokens").alias("_all"), "max_repeats").filter("_all > 0 and budget > 0")
    budget = budget.withColumn("_whole", F.least(F.floor(F.col("budget") / F.col("_all")), F.col("max_repeats").cast("bigint"))).withColumn(
        "_rest", F.when(F.col("_whole") < F.col("max_repeats"), F.col("budget") - F.col("_whole") * F.col("_all")).otherwise(0)
    )
    # a row for each block of a plan's row, so that no source is joined as one key
    planned = budget.select("mix_name", "_s", "_whole", "_rest", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    on_block = (F.col("source") == F.col("_s")) & (F.col("_block") == F.col("_b"))
    fits = F.col("n_tokens") <= F.col("_rest")
    sums = docs.join(planned, on_block).groupBy("mix_name", "_s", "_b", "_whole", "_rest").agg(F.sum(F.when(fits, F.col("n_tokens")).otherwise(0)).alias("_size"))
    order = Window.partitionBy("mix_name", "_s").orderBy(F.xxhash64("mix_name", "_b"), "_b").rowsBetween(Window.unboundedPreceding, 0)
    left = sums.withColumn("_left", F.col("_rest") - (F.sum("_size").over(order) - F.col("_size"))).filter("_whole > 0 or _left > 0")
    met = docs.join(left, on_block)
    split = (F.col("_left") > 0) & (F.col("_left") < F.col("_size"))
    inside = Window.partitionBy("mix_name", "source", "_block").orderBy(F.xxhash64("mix_name", "doc_id"), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    size = F.when(fits, F.col("n_tokens")).otherwise(0)
    upto = F.sum(size).over(inside)
    part = met.filter(split).withColumn("_upto", upto).withColumn("_before", F.col("_upto") - size)
    nearer = (F.col("_upto") <= F.col("_left")) | (F.col("_upto") - F.col("_left") < F.col("_left") - F.col("_before"))
    part = part.withColumn("_extra", (fits & (F.col("_before") < F.col("_left")) & nearer).cast("bigint")).drop("_upto", "_before")
    whole = met.filter(~split).withColumn("_extra", (fits & (F.col("_left") > 0)).cast("bigint"))
    drawn = whole.unionByName(part).withColumn("copies", F.col("_whole") + F.col("_extra")).filter("copies > 0")
    return drawn.select("mix_name", "source", "doc_id", "n_tokens", "copies")
