import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridloom.functions.amounts import decimal_of

from gridloom.functions.identifiers import hex_halves, permuted, uuid_hex
from gridloom.functions.timeparse import DAY, HOUR, bucket_of, iso_micros, micros, micros_text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_iso_times(spark):
    base = 1_741_000_000_000_000  # 2025-03-03T11:06:40Z
    good = {
        "2025-03-03T11:06:40Z": base,
        "2025-03-03T11:06:40.5Z": base + 500_000,
        "2025-03-03T16:36:40+05:30": base,
        "2025-03-03T16:36:40+0530": base,
        "2025-03-03T08:06:40.000-03:00": base,
        "2025-03-03 11:06:40": base,
        " 2025-03-03T11:06:40z ": base,
        "2025-03-03T11:06Z": base - 40_000_000,
    }
    bad = ["2025-02-30T25:61:00Z", "2025-03-03", "0000-00-00", "17/03 about 4pm", "", "n/a", "unknown", None, "2025-13-01T00:00:00Z", "2025-03-03T11:06:40+99:00"]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = [r[0] for r in column(spark, [*good, *bad]).select(iso_micros(F.col("x"))).collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == [*good.values()] + [None] * len(bad)


def test_micros_of_other_types(spark):
    df = spark.sql("select timestamp_ntz'2025-03-30 02:30:00.5' a, date'2025-03-30' b, cast(null as timestamp_ntz) c")
    types = dict(df.dtypes)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # this local time doesn't exist there
    try:
        row = df.select(*[micros(F.col(c), types[c]) for c in "abc"]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == (1_743_301_800_500_000, 1_743_292_800_000_000, None)


def test_buckets_and_text_before_1970(spark):
    df = column(spark, [-1, 0, DAY - 1, DAY, -DAY, None], "bigint")
    assert [r[0] for r in df.select(bucket_of(F.col("x"), DAY)).collect()] == [-1, 0, 0, 1, -1, None]
    assert [r[0] for r in df.select(micros_text(F.col("x"))).collect()] == ["1969-12-31 23:59:59", "1970-01-01 00:00:00", "1970-01-01 23:59:59", "1970-01-02 00:00:00", "1969-12-31 00:00:00", None]
    assert column(spark, [-HOUR - 1], "bigint").select(bucket_of(F.col("x"), HOUR)).first()[0] == -2


def test_uuid_spellings(spark):
    u = str(uuid.UUID(int=0x1234567890ABCDEF1234567890ABCDEF))
    same = [u, u.upper(), f" {u} ", f"\t{u}\n", "{" + u.upper() + "}", "urn:uuid:" + u, "URN:UUID:" + u, u.replace("-", "")]
    other = [None, "", "  ", "x" + u, u[:-1], u + "0", "not an id"]
    got = [r[0] for r in column(spark, [*same, *other]).select(uuid_hex(F.col("x"))).collect()]
    assert got == [u.replace("-", "")] * len(same) + [None] * len(other)


def test_permutation_is_one_to_one(spark):
    rng = random.Random(3)
    hexes = {f"{rng.getrandbits(128):032x}" for _ in range(2000)} | {f"{i:032x}" for i in range(500)} | {f"{i << 64:032x}" for i in range(1, 500)} | {"f" * 32}
    df = column(spark, sorted(hexes))
    high, low = hex_halves(F.col("x"))
    halves = df.select(F.struct(high, low).alias("h"), high.alias("a"), low.alias("b"))
    out = permuted(halves, "a", "b").agg(F.count_distinct("h"), F.count_distinct("a", "b"), F.count_distinct(F.shiftrightunsigned("a", 60))).first()
    assert tuple(out) == (len(hexes), len(hexes), 16)
    row = df.filter(f"x = '{'f' * 32}'").select(high, low).first()
    assert tuple(row) == (-1, -1)


def test_sums_drop_nothing(spark):
    df = column(spark, [1e21, 0.0000005, float("nan"), None, -2.0], "double")
    assert [r[0] for r in df.select(decimal_of(F.col("x"), 28, 6)).collect()] == [Decimal("1e21"), Decimal("0.000001"), None, None, Decimal(-2)]
    for much in (1e22, float("inf"), float("-inf")):
        with pytest.raises(Exception, match="too large for a sum"):
            column(spark, [much], "double").select(decimal_of(F.col("x"), 28, 6)).collect()
