import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.timeparse import DAY
from gridloom.operators.lateness import window_totals, windows_to_correct
from gridloom.streaming.lambda_store import LambdaStore

LOG = T.StructType([T.StructField(n, t) for n, t in (("event_id", T.StringType()), ("zone", T.StringType()), ("at", T.LongType()), ("emitted", T.LongType()), ("log_offset", T.LongType()), ("log_partition", T.IntegerType()), ("c", T.DoubleType()), ("s", T.DoubleType()))])
SUMS = {"use": "c", "sun": "s"}


def log(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = rng.randrange(1000)
        row = [f"{i:032x}", rng.choice(["hot"] * 6 + ["a", None]), rng.choice([at] * 9 + [None]), at + rng.choice([-5, 1, 3, 40, 90]), i, 0, rng.choice([None, round(rng.uniform(-1, 5), 4)]), float("nan") if rng.random() < 0.02 else round(rng.random(), 4)]
        out.append(row)
        if rng.random() < 0.2:  # delivered again, later
            again = list(row)
            again[0], again[3], again[4] = row[0].upper(), row[3] + rng.randrange(60), n + i
            out.append(again)
    return out


def brute(rows, as_of, window=100, cutoff=50):
    first = {}
    for r in sorted(rows, key=lambda r: (r[3], r[4])):
        first.setdefault(r[0].lower(), r)
    out = {}
    for r in first.values():
        if r[1] is not None and r[2] is not None and r[3] <= as_of and r[3] - r[2] <= cutoff:
            d = Decimal
            c, s = (d(0) if v is None or v != v else d(str(v)) for v in (r[6], r[7]))
            a, b, n = out.get((r[1], r[2] - r[2] % window), (d(0), d(0), 0))
            out[r[1], r[2] - r[2] % window] = (a + c, b + s, n + 1)
    return out


def collected(df):
    return {(r.zone, r.window_at): (r.use, r.sun, r.counted) for r in df.filter("counted > 0").collect()}


KEYS = T.StructType([LOG["zone"]])


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], LOG)


def test_totals_against_brute_force(spark):
    rows = log(400)
    first = {}
    for r in sorted(rows, key=lambda r: (r[3], r[4])):
        first.setdefault(r[0].lower(), r)
    assert collected(window_totals(frame(spark, first.values()), ["zone"], "at", "emitted", SUMS, 100, 50)) == brute(rows, 10_000)


@pytest.mark.parametrize("as_of", [300, 1200])
def test_catching_up_ends_as_one_pass(spark, tmp_path, as_of):
    rows = log(400, 1)
    store = LambdaStore(spark, str(tmp_path), KEYS, SUMS, 100, 50)
    store.catch_up(frame(spark, rows), as_of, 70)
    assert collected(store.view()) == brute(rows, as_of)
    last = as_of - as_of % 70
    for r in store.view().collect():
        assert r.frozen == (r.window_at + 150 <= last) and not (r.frozen and r.provisional)


def test_layers_through_deliveries(spark, tmp_path):
    """Every view equals the sums over what has come so far, whatever lies in which layer."""
    rows = sorted(log(300, 5), key=lambda r: (r[3], r[4]))
    store = LambdaStore(spark, str(tmp_path), KEYS, SUMS, 100, 50)
    before = -1
    for k in range(0, len(rows), 60):
        come = frame(spark, rows)
        now = rows[min(k + 60, len(rows)) - 1][3]
        for _ in range(2 if k == 120 else 1):  # run again
            store.increment(come, before, now)
        assert collected(store.view()) == brute(rows, now)
        if k % 120:
            store.recompute(come, now, now)
            assert collected(store.view()) == brute(rows, now) and not store.fast.parts
            store.recompute(come, now, now)  # run again
        before = now
    assert collected(store.view()) == brute(rows, 10**9)


def test_freezing_cuts_off(spark, tmp_path):
    """A record that turns up in the log before its window is frozen changes it at the next batch, one that turns up after does not."""
    one = ["a" * 32, "z", 10, 20, 1, 0, 1.0, 1.0]
    before = ["b" * 32, "z", 20, 60, 2, 0, 2.0, 2.0]
    after = ["c" * 32, "z", 30, 70, 3, 0, 4.0, 4.0]
    open_ = ["d" * 32, "z", 130, 170, 4, 0, 8.0, 8.0]
    store = LambdaStore(spark, str(tmp_path), KEYS, SUMS, 100, 50)
    store.recompute(frame(spark, [one]), 120, 120)
    assert collected(store.view()) == {("z", 0): (1, 1, 1)} and not store.view().first().frozen
    store.recompute(frame(spark, [one, before]), 150, 150)  # at 150 the window's cut-off has passed
    assert collected(store.view()) == {("z", 0): (3, 3, 2)} and store.view().first().frozen
    store.recompute(frame(spark, [one, before, after, open_]), 180, 180)
    store.increment(frame(spark, [one, before, after, open_]), 180, 190)
    assert collected(store.view()) == {("z", 0): (3, 3, 2), ("z", 100): (8, 8, 1)}


def test_batches_read_open_windows_alone(spark, tmp_path):
    rows = [["%032x" % i, "z", i * DAY // 10, i * DAY // 10 + 1, i, 0, 1.0, 1.0] for i in range(100)]
    frame(spark, rows).withColumn("day", F.floor(F.col("at") / DAY).cast("int")).write.partitionBy("day").parquet(str(tmp_path / "log"))
    kept = spark.read.parquet(str(tmp_path / "log"))
    pruned = kept.filter(F.col("day") >= 8)
    store = LambdaStore(spark, str(tmp_path / "s"), KEYS, SUMS, DAY // 5, DAY // 4)
    store.recompute(kept, 9 * DAY, 9 * DAY)
    assert store.open_from == (9 * DAY - DAY // 5 - DAY // 4) // (DAY // 5) * (DAY // 5) + DAY // 5
    totals = store._totals(kept, 10 * DAY, "emitted")
    assert f"at#" in (plan := totals._jdf.queryExecution().executedPlan().toString()) and f">= {store.open_from}" in plan and "GreaterThanOrEqual(at," in plan  # reaches the scan
    old = store.batch._manifest()["parts"]
    store.recompute(pruned, 10 * DAY, 10 * DAY)  # the days before are not needed
    new = store.batch._manifest()["parts"]
    assert {p for p in new if old.get(p) == new[p]} == {str(d) for d in range(8)}  # parts of frozen days keep their files
    assert sum(r.counted for r in store.view().collect()) == 100


def test_windows_to_correct(spark):
    views = spark.createDataFrame([("a", 0, Decimal("1.0"), 1), ("a", 100, Decimal("2.0"), 1), ("b", 0, Decimal("3.0"), 2), ("c", 0, Decimal("0"), 0)], "zone string, window_at bigint, use decimal(28,9), counted bigint")
    published = spark.createDataFrame([("a", 0, Decimal("1.0005")), ("a", 100, Decimal("2.000501")), ("d", 0, Decimal("0.0")), ("d", 100, Decimal("0.1")), ("e", 0, None)], "zone string, window_at bigint, total decimal(18,6)")
    out = windows_to_correct(views, published, ["zone"], {"use": "total"}, 0.0005)
    assert {tuple(r) for r in out.collect()} == {("a", 100), ("b", 0), ("d", 100), ("e", 0)}


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], LOG)
    out = window_totals(df, ["zone"], "at", "emitted", SUMS, 100, 50)
    assert out.count() == 0
    assert windows_to_correct(out, out.withColumn("total", F.lit(0).cast("decimal(18,6)")), ["zone"], {"use": "total"}, 0.1).count() == 0
    store = LambdaStore(spark, str(tmp_path), KEYS, SUMS, 100, 50)
    assert store.view().count() == 0
    store.catch_up(df, 0)
    assert store.view().count() == 0
