import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators.changefeed import advance, apply_changes, operation, signed_images, standing

FEED = "h string, op string, at bigint, seq bigint, off bigint, rate double"
ARGS = ("h", "op", "at", "seq", ["off"], ["rate"])


def test_operations(spark):
    df = spark.createDataFrame([(x,) for x in ["I", " insert", "u", "UPDATE ", "d", "Delete", "x", "", None]], "op string")
    assert [r[0] for r in df.select(operation(F.col("op"))).collect()] == ["i", "i", "u", "u", "d", "d", None, None, None]


@pytest.mark.parametrize("seed", range(4))
def test_against_replay(spark, seed):
    rng = random.Random(seed)
    feed = []
    for seq in range(250):
        h, at, op = rng.choice(["hot"] * 9 + ["a", "b", "c", "d"]), rng.randrange(100), rng.choice("iuuud")
        copies = [(h, rng.choice([op, op.upper(), {"i": "insert", "u": "update", "d": "delete"}[op]]), at, seq, None, None if op == "d" else float(seq % 3)) for _ in range(rng.choice([1, 1, 1, 2, 5]))]
        feed += copies
    rng.shuffle(feed)
    feed = [(*r[:4], off, r[5]) for off, r in enumerate(feed)]
    noise = [(None, "i", 1, 9000, 10_000, 1.0), ("", "i", 1, 9001, 10_001, 1.0), ("zz", "i", None, 9002, 10_002, 1.0), ("zz", "?", 1, 9003, 10_003, 1.0)]
    out = apply_changes(spark.createDataFrame(feed + noise, FEED).repartition(5), *ARGS, bucket=7)
    state = {}
    for h, op, at, seq, _, rate in sorted({(r[0], r[1].lower()[0], r[2], r[3], 0, r[5]) for r in feed}, key=lambda r: (r[2], r[3])):
        if op == "d":
            state.pop(h, None)
        else:
            state[h] = (seq, rate)
    assert {r.h: (r.seq, r.rate) for r in out.collect()} == state


def test_base_and_empty_feed(spark):
    base = spark.createDataFrame([("a", 1, 1, 5.0), ("b", 1, 1, 6.0)], "h string, at bigint, seq bigint, rate double")
    none = spark.createDataFrame([], FEED)
    assert {r.h for r in apply_changes(none, *ARGS, base=base).collect()} == {"a", "b"}
    assert apply_changes(none, *ARGS).count() == 0
    feed = spark.createDataFrame([("a", "d", 3, 2, 1, None), ("b", "u", 3, 3, 2, 7.0), ("c", "d", 3, 4, 3, None)], FEED)
    assert {(r.h, r.rate) for r in apply_changes(feed, *ARGS, base=base).collect()} == {("b", 7.0)}


def test_images_cancel(spark):
    feed = spark.createDataFrame([("a", "i", 1, 1, 1, 5.0), ("a", "u", 2, 2, 2, 6.0), ("a", "d", 3, 3, 3, None)], FEED)
    images = signed_images(feed, "h", "op", "at", "seq", ["rate"])
    assert images.count() == 5
    left = images.groupBy("op", "at", "seq", "rate").agg(F.sum("multiplicity").alias("n")).filter("n <> 0").collect()
    assert [tuple(r) for r in left] == [("d", 3, 3, None, 1)]  # the tombstone


@pytest.mark.parametrize("seed", range(3))
def test_any_split_of_a_shuffled_feed_ends_as_the_whole(spark, seed):
    rng = random.Random(seed)
    feed = []
    for seq in range(120):
        op = rng.choice("iud")
        feed += [(rng.choice("aaab"), op, rng.randrange(40), seq, None if op == "d" else float(seq % 3))] * rng.choice([1, 1, 3])
    rng.shuffle(feed)
    feed = [(*r[:4], off, r[4]) for off, r in enumerate(feed)]
    whole = sorted(map(tuple, apply_changes(spark.createDataFrame(feed, FEED), *ARGS).collect()))
    state, at = None, 0
    while at < len(feed):
        n = rng.choice([1, 60, 100])
        state = spark.createDataFrame(advance(state, spark.createDataFrame(feed[at : at + n], FEED), *ARGS).collect(), "h string, op string, at bigint, seq bigint, off bigint, rate double")
        at += n
    assert sorted(map(tuple, standing(state, "op").drop("off").select("h", "at", "seq", "rate").collect())) == sorted((r[0], *r[1:]) for r in whole)


def test_a_late_change_does_not_bring_back_what_was_deleted(spark):
    one = advance(None, spark.createDataFrame([("a", "i", 1, 1, 1, 5.0), ("a", "d", 3, 3, 2, None)], FEED), *ARGS)
    two = advance(one, spark.createDataFrame([("a", "u", 2, 2, 3, 6.0)], FEED), *ARGS)
    assert standing(two, "op").count() == 0 and [r.op for r in two.collect()] == ["d"]
    assert apply_changes(spark.createDataFrame([("a", "u", 2, 2, 3, 6.0)], FEED), *ARGS, base=one).count() == 0
