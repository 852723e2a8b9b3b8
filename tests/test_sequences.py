import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.timeparse import bucket_of
from gridloom.operators.sequences import with_least_after, with_previous


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_neighbours_across_buckets(spark, bucket):
    rng = random.Random(bucket)
    # key 'hot' has most of the rows
    rows = [(rng.choice(["hot"] * 8 + ["a", "b"]), t, rng.choice([None, *range(50)])) for t in rng.sample(range(-200, 800), 400)]
    df = spark.createDataFrame(rows, "k string, t bigint, v int")
    got = {(r.k, r.t): (r.prev_v, r.prev_t, r.later) for r in with_least_after(with_previous(df, ["k"], ["t"], ["v", "t"], bucket_of(F.col("t"), bucket)), ["k"], ["t"], "v", bucket_of(F.col("t"), bucket), "later").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        line = sorted(r[1:] for r in rows if r[0] == key)
        for i, (t, _) in enumerate(line):
            after = [v for _, v in line[i + 1 :] if v is not None]
            want[key, t] = (line[i - 1][1] if i else None, line[i - 1][0] if i else None, min(after, default=None))
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t bigint, v int")
    assert with_previous(df, ["k"], ["t"], ["v"], bucket_of(F.col("t"), 5)).count() == 0
