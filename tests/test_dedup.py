import random
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.dedup import SALTS, first_copies, later_copies, with_identity
from gridloom.store.quotients import QuotientTables

SCHEMA = "event_id string, at bigint, off bigint, part int, v double"
TIE = ["off", "part"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_spellings_ties_and_ids_that_are_none(spark):
    u, w = str(uuid.UUID(int=5)), str(uuid.UUID(int=6))
    rows = [
        (u, 20, 1, 0, 1.0),
        (u.upper(), 10, 2, 0, 2.0),  # kept: the earliest
        ("{" + u + "}", 10, 3, 0, 3.0),
        ("urn:uuid:" + u, None, 0, 0, 4.0),  # no time: last
        (w, 5, 9, 1, 5.0),
        (w, 5, 9, 0, 6.0),  # kept: same time and offset, lower partition
        (None, 1, 10, 0, 7.0),
        (None, 1, 11, 0, 8.0),
        ("  ", 1, 12, 0, 9.0),
        ("", 1, 13, 0, 10.0),
        ("serial 7", 3, 14, 0, 11.0),
        (" serial 7", 2, 15, 0, 12.0),  # kept
        ("SERIAL 7", 1, 16, 0, 13.0),  # other text, other id
    ]
    df = frame(spark, rows)
    kept = {r.v for r in first_copies(df, "event_id", F.col("at"), TIE, ["v"]).collect()}
    lost = {(r.off, r.part) for r in later_copies(df, "event_id", F.col("at"), TIE).collect()}
    assert kept == {2.0, 6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 13.0}
    assert lost == {(1, 0), (3, 0), (0, 0), (9, 1), (14, 0)}


def test_a_third_of_the_rows_is_one_message(spark):
    hot = str(uuid.UUID(int=99))
    rows = [(hot, 1000 - i % 500, i, 0, 0.0) for i in range(3000)] + [(str(uuid.UUID(int=1000 + i)), i, 10_000 + i, 0, 0.0) for i in range(6000)]
    df = frame(spark, rows).repartition(6)
    assert first_copies(df, "event_id", F.col("at"), TIE, []).count() == 6001
    lost = later_copies(df, "event_id", F.col("at"), TIE)
    assert lost.count() == 2999
    assert lost.filter("off = 499").count() == 0  # the earliest, with the lowest offset


def test_identifiers_never_meet_by_chance(spark):
    df = frame(spark, [(str(uuid.UUID(int=i)), 0, i, 0, 0.0) for i in range(5000)])
    # even with a single quotient bit all remainders are complete
    keys = with_identity(df, "event_id", 1).select("_quotient", "_high", "_low", "_other")
    assert keys.distinct().count() == 5000
    assert keys.select("_quotient").distinct().count() == 2


def test_empty_and_clashing_names(spark):
    df = frame(spark, [])
    assert first_copies(df, "event_id", F.col("at"), TIE, ["v"]).count() == 0
    assert later_copies(df, "event_id", F.col("at"), TIE).count() == 0
    more = frame(spark, [(None, 1, 1, 1, 1.0)]).withColumns({"n": F.lit(1), "kept": F.lit(2), "quotient": F.lit(3), "first": F.lit(4)})
    assert first_copies(more, "event_id", F.col("at"), TIE, ["n", "kept", "quotient", "first"]).first()["first"] == 4


def test_copies_of_a_hot_message_are_looked_up_in_many_parts(spark):
    hot = str(uuid.UUID(int=7))
    df = frame(spark, [(hot, i, i, 0, 0.0) for i in range(2000)])
    lost = later_copies(df, "event_id", F.col("at"), TIE)
    assert lost.count() == 1999
    salts = df.select(F.pmod(F.xxhash64(*TIE), F.lit(SALTS))).distinct().count()
    assert salts == SALTS


def test_tables_kept_between_batches(spark, tmp_path):
    rng = random.Random(2)
    ids = [str(uuid.UUID(int=i)) for i in range(60)] + ["serial", None, "  "]
    rows = [(i.upper() if i and rng.random() < 0.3 else i, rng.randrange(100), k, 0, float(k)) for k, i in enumerate(rng.choice(ids) for _ in range(300))]
    t = QuotientTables(spark, str(tmp_path / "q"), {"off": T.LongType(), "part": T.IntegerType()}, shard_bits=2)
    first = t.unknown(frame(spark, rows[:100]), "event_id")
    assert first.count() == 100  # nothing is known yet
    for k, at in enumerate((0, 100, 200)):
        t.insert(frame(spark, rows[at : at + 100]), "event_id", F.col("at"), batch_id=k)
        t.insert(frame(spark, rows[at : at + 100]), "event_id", F.col("at"), batch_id=k)  # run again
    df = frame(spark, rows)
    want = {tuple(r) for r in later_copies(df, "event_id", F.col("at"), TIE).collect()}
    got = [tuple(r) for r in t.later(df, "event_id", F.col("at")).collect()]
    assert set(got) == want and len(got) == len(want)
    assert t.table.read().agg(F.sum("_n")).first()[0] == sum(1 for r in rows if r[0] and r[0].strip())
    assert {r.event_id for r in t.unknown(df, "event_id").collect()} == {None, "  "}


def test_a_batch_touches_only_its_shards(spark, tmp_path):
    t = QuotientTables(spark, str(tmp_path / "q"), {"off": T.LongType(), "part": T.IntegerType()}, shard_bits=4)
    t.insert(frame(spark, [(str(uuid.UUID(int=i)), 0, i, 0, 0.0) for i in range(200)]), "event_id", F.col("at"))
    before = t.table._manifest()["parts"]
    assert len(before) == 16
    t.insert(frame(spark, [(str(uuid.UUID(int=5)), 1, 999, 0, 0.0)]), "event_id", F.col("at"))
    after = t.table._manifest()["parts"]
    assert sum(before[p] != after[p] for p in before) == 1
