import pytest
from pyspark.sql import types as T

from gridloom.sources import sinks
from gridloom.store.keyed import Conflict, KeyedTable, merge_statement, safe, staging_name

SCHEMA = T.StructType([T.StructField("h", T.StringType()), T.StructField("d", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("since", T.LongType())])
ROWS = "h string, d string, v int, since bigint"


def rows(t):
    return sorted(tuple(r) for r in t.read().collect())


def test_merge_overwrites_and_is_idempotent(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["h", "d"], part="d")
    assert rows(t) == []
    t.merge(spark.createDataFrame([("a", "d1", 1, 10), ("b", "d/2 x", 2, 10)], ROWS), batch_id=0)
    batch = spark.createDataFrame([("a", "d1", 5, 20), ("c", "d1", 3, 20)], ROWS)
    v = t.merge(batch, batch_id=1)
    want = [("a", "d1", 5, 20), ("b", "d/2 x", 2, 10), ("c", "d1", 3, 20)]
    assert rows(t) == want
    assert t.merge(batch, batch_id=1) == v and rows(t) == want  # the batch is known
    t.merge(batch)
    assert rows(t) == want  # and would change nothing
    t.merge(spark.createDataFrame([("a", "d1", 9, 99), (None, None, 1, 1)], ROWS), keep_first=("since",))
    assert ("a", "d1", 9, 20) in [tuple(r) for r in t.read().collect()]
    t.merge(spark.createDataFrame([(None, None, 2, 2)], ROWS))
    assert [tuple(r) for r in t.read().filter("h is null").collect()] == [(None, None, 2, 2)]
    before = rows_set(t)
    t.vacuum()
    assert rows_set(t) == before
    t.replace(spark.createDataFrame([("z", "d9", 1, 1)], ROWS))
    assert rows(t) == [("z", "d9", 1, 1)]


def rows_set(t):
    return {tuple(r) for r in t.read().collect()}


def test_untouched_parts_keep_their_files(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["h", "d"], part="d")
    t.merge(spark.createDataFrame([("a", "d1", 1, 1), ("a", "d2", 1, 1)], ROWS))
    old = t._manifest()["parts"]
    t.merge(spark.createDataFrame([("a", "d2", 2, 2)], ROWS))
    new = t._manifest()["parts"]
    assert old["d1"] == new["d1"] and old["d2"] != new["d2"]


def test_second_writer_of_a_version_is_refused(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["h", "d"])
    t.merge(spark.createDataFrame([("a", "d1", 1, 1)], ROWS))
    stale = t._manifest()
    t.merge(spark.createDataFrame([("a", "d1", 2, 1)], ROWS))
    t._manifest = lambda: stale
    with pytest.raises(Conflict):
        t.merge(spark.createDataFrame([("a", "d1", 3, 1)], ROWS))
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "u"), SCHEMA, ["h"], part="d")


def test_merge_statement():
    s = merge_statement("zone_load", staging_name("b", "zone_load"), ["z", "w", "x"], ["z", "w"])
    assert "UPDATE SET t.x = s.x" in s and "t.z = s.z" not in s and "+" not in s
    for bad in ("x;drop table y", "1x", "a b", ""):
        with pytest.raises(ValueError):
            safe(bad)
    with pytest.raises(ValueError):
        merge_statement("t", "s", ["a"], ["b"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0), ("a", None), ("c<", 3.0)], "k string, bill double")
    sinks.csv_report(df, str(tmp_path / "r"), "bill", "k")
    text = next((tmp_path / "r").glob("part*.csv")).read_text().split()
    assert text[0] == "k,bill" and [x.split(",")[0] for x in text[1:]] == ["c<", "b", "a"]
    assert "c&lt;" in sinks.html_report(df, "t", df["k"])
    m = spark.createDataFrame([("k", "v")], "key string, value string")
    for _ in range(2):
        sinks.append_messages(m, str(tmp_path / "log"), 3)
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    with pytest.raises(Exception, match="without a key"):
        sinks.append_messages(spark.createDataFrame([("", "v")], "key string, value string"), str(tmp_path / "log"), 4)
    p = sinks.drop_file(str(tmp_path), "x.csv", b"1")
    assert p.read_bytes() == b"1" and not [q for q in tmp_path.iterdir() if q.name.startswith(".")]
