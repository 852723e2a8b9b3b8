import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.llm.mixing import bisected, draw, mix_weights, weigh

PLAN = "mix_name string, source string, target_share double, max_repeats int, total_tokens bigint"
DOCS = "doc_id bigint, source string, n_tokens bigint"


def corpus(spark, seed=0, n=3000):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["big"] * 8 + ["mid"] * 3 + ["small", None]), rng.choice([0, 1, 5, 50, rng.randrange(400)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_weights_and_what_cannot_be_reached(spark):
    rows, docs = corpus(spark)
    tokens = {s: sum(r[2] for r in rows if r[1] == s) for s in ("big", "mid", "small")}
    size, corpus_tokens = sum(tokens.values()), sum(r[2] for r in rows)
    plan = [("even", "big", 0.4, 1, size), ("even", "mid", 0.3, 2, size), ("even", "small", 0.3, 2, size), ("ok", "big", 0.5, 1, 1000), ("ok", "small", 0.5, 1, 1000), ("gone", "nowhere", 1.0, 9, 10), ("nil", None, 0.0, 1, 0)]
    out = {(r.mix_name, r.source): r for r in mix_weights(docs, spark.createDataFrame(plan, PLAN)).collect()}
    for m, s, share, repeats, total in plan:
        r = out[m, s]
        assert r.reachable == (not repeats * tokens.get(s, 0) < share * total)
        if r.exponent is not None:  # the weight is the source's share of the corpus put to its exponent
            assert r.weight == pytest.approx((tokens[s] / corpus_tokens) ** r.exponent, rel=1e-9)
            assert r.weight == pytest.approx(min(share, repeats * tokens[s] / total), rel=1e-9)
            assert r.budget == pytest.approx(min(share * total, repeats * tokens[s]), abs=1)
    assert not out["even", "small"].reachable and out["even", "big"].reachable and not out["gone", "nowhere"].reachable
    assert out["ok", "big"].weight == pytest.approx(0.5) and out["ok", "big"].normalised_weight == pytest.approx(0.5)
    assert sum(out["even", s].normalised_weight for s in ("big", "mid", "small")) == pytest.approx(1) and out["gone", "nowhere"].budget == 0


def test_the_repetition_limit_drives_the_draw(spark):
    rows, docs = corpus(spark, 5)
    tokens = sum(r[2] for r in rows if r[1] == "small")
    drawn = {}
    for limit in (1, 2, 3):
        w = mix_weights(docs, spark.createDataFrame([("m", "small", 0.5, limit, 6 * tokens), ("m", "big", 0.5, 9, 6 * tokens)], PLAN))
        drawn[limit] = {r.source: (r.t, r.most) for r in draw(docs, w).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.max("copies").alias("most")).collect()}
        exponent = w.filter("source = 'small'").first()
        assert exponent.reachable == (limit == 3)
    assert [drawn[k]["small"] for k in (1, 2, 3)] == [(tokens, 1), (2 * tokens, 2), (3 * tokens, 3)]
    assert drawn[1]["big"] == drawn[2]["big"] == drawn[3]["big"]  # the others keep their targets


def test_bisection():
    assert bisected(lambda e: 0.1**e <= 0.01) == pytest.approx(2) and bisected(lambda e: True) == 0 and bisected(lambda e: e >= 1000, 3) == pytest.approx(1000)
    one = pd.DataFrame({"mix_name": ["m"], "source": [None], "target_share": [float("nan")], "max_repeats": [1], "total_tokens": [5], "n_tokens": [0], "corpus_tokens": [0]})
    assert list(weigh(one).reachable) == [True]
    alone = weigh(one.assign(target_share=1.0, n_tokens=4, corpus_tokens=4)).iloc[0]  # a share of 1 has no exponent
    assert alone.exponent is None and alone.weight == 0.8 and alone.budget == 4 and not alone.reachable


@pytest.mark.parametrize("blocks", [1, 16])
def test_draws_keep_budgets_and_limits(spark, blocks):
    rows, docs = corpus(spark, 3)
    tokens = {s: sum(r[2] for r in rows if r[1] == s) for s in ("big", "mid", "small")}
    plan = [("m", "big", 0.5, 3, 100_000), ("m", "mid", 0.3, 3, 100_000), ("m", "small", 0.2, 2, 10 * tokens["small"]), ("n", "big", 0.9, 5, 3 * tokens["big"]), ("n", "small", 0.0, 5, 10), ("n", "void", 0.1, 5, 1000)]
    weights = mix_weights(docs, spark.createDataFrame(plan, PLAN))
    out = draw(docs, weights, blocks)
    got = {(r.mix_name, r.source): r for r in out.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()}
    largest = max(r[2] for r in rows)
    for m, s, share, repeats, total in plan:
        budget = min(share * total, repeats * tokens.get(s, 0))
        if budget <= 0:
            assert (m, s) not in got
            continue
        r = got[m, s]
        assert r.most <= repeats and r.most - r.least <= 1 and abs(budget - r.t) <= largest / 2 + 1
    assert got["m", "small"].t == 2 * tokens["small"] and got["m", "small"].least == 2  # the limit, reached exactly
    assert out.groupBy("mix_name", "doc_id").count().filter("count > 1").count() == 0
    assert out.exceptAll(draw(docs.repartition(7), weights, blocks)).count() == 0  # the same whatever the partitions


def test_one_long_text_does_not_use_up_the_partial_pass(spark):
    docs = spark.createDataFrame([(0, "s", 15_000), *[(i, "s", 100) for i in range(1, 200)]], DOCS)
    w = mix_weights(docs, spark.createDataFrame([("m", "s", 1.0, 3, 14_000)], PLAN))
    got = draw(docs, w, 4).agg(F.sum("n_tokens"), F.min("doc_id")).first()
    assert got[0] == 14_000 and got[1] > 0


def test_shares_against_sql_over_token_counts(spark):
    """Reachability, budgets and shares by DuckDB, from token counts alone."""
    rows, docs = corpus(spark, 8)
    plan = [(m, s, t, k, n) for m, n in (("x", 50_000), ("y", 5_000_000)) for s, t, k in (("big", 0.5, 2), ("mid", 0.3, 4), ("small", 0.2, 3))]
    weights = mix_weights(docs, spark.createDataFrame(plan, PLAN))
    d, p = pd.DataFrame(rows, columns=["doc_id", "source", "n_tokens"]), pd.DataFrame(plan, columns=["mix_name", "source", "target_share", "max_repeats", "total_tokens"])  # noqa: F841
    sql = """SELECT mix_name, p.source, max_repeats * t >= target_share * total_tokens AS reachable, least(target_share, max_repeats * t / total_tokens) AS weight
      FROM p LEFT JOIN (SELECT source, sum(n_tokens) AS t FROM d GROUP BY 1) s ON s.source = p.source ORDER BY 1, 2"""
    want = [(*r[:3], pytest.approx(r[3], rel=1e-9)) for r in duckdb.sql(sql).fetchall()]
    assert [tuple(r) for r in weights.orderBy("mix_name", "source").select("mix_name", "source", "reachable", "weight").collect()] == want


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    weights = mix_weights(docs, spark.createDataFrame([("m", "s", 0.5, 1, 10)], PLAN))
    assert [r.reachable for r in weights.collect()] == [False] and draw(docs, weights).count() == 0
    assert mix_weights(docs, spark.createDataFrame([], PLAN)).count() == 0


def test_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "s", 10), (1, "s", 10), (None, "s", 10), (2, None, 10), (3, "s", 0)], DOCS).withColumns({"mix_name": F.lit("x"), "budget": F.lit(1)})
    plan = spark.createDataFrame([("m", "s", 1.0, 2, 60), ("m", "s", 1.0, 2, 60), ("z", "s", None, None, None), (None, "s", 1.0, 1, 30)], PLAN).withColumn("n_tokens", F.lit(9))
    weights = mix_weights(docs.select("source", "n_tokens"), plan)
    assert {(r.mix_name, r.n_tokens, r.reachable) for r in weights.collect()} == {("m", 30, True), ("z", 30, True), (None, 30, True)}
    drawn = draw(docs.drop("mix_name", "budget"), weights)
    assert sorted((r.doc_id or 0, r.copies) for r in drawn.filter("mix_name = 'm'").collect()) == [(0, 2), (1, 2), (1, 2), (3, 2)]
