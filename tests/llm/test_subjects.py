import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm.subjects import Model, Scorer, Shard, Training, assign, features, labelled, train, words_of

SUBJECTS = ["birds", "ships"]
VOCABULARY = {"birds": ["sparrow", "plumage", "nesting", "feather", "warbler", "fledgling"], "ships": ["keel", "rudder", "mainsail", "harbour", "ballast", "bowsprit"]}
PLAIN = ["index", "value", "list", "token", "buffer", "queue", "string", "return", "count", "total"]
SMALL = Training(buckets=1 << 12, size=8, steps=40, shards=3)


def text(rng, areas):
    words = rng.choices(PLAIN, k=60)
    for a in areas:
        words += rng.choices(VOCABULARY[a], k=15)
    if rng.random() < 0.3:
        words.append(rng.choice(VOCABULARY[rng.choice(SUBJECTS)]))  # in passing
    rng.shuffle(words)
    return " ".join(rng.choice([w, w.title() + "Count", w + "_item", w.upper()]) for w in words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    truth = {i: rng.choice([[], ["birds"], ["ships"], ["birds", "ships"]]) for i in range(900)}
    docs = spark.createDataFrame([(i, text(rng, a)) for i, a in truth.items()], "doc_id bigint, text string")
    labels = []
    for i in range(600):
        for ann in ("x", "y")[: rng.choice([1, 2])]:
            said = truth[i] if rng.random() > 0.05 else [rng.choice(SUBJECTS)]
            labels += [(i, s, ann) for s in said or ["none"]]
    return truth, docs, spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string")


def test_words():
    assert [w.lower() for w in words_of("snake_case camelCase 12 naïve")] == ["snake", "case", "camel", "case", "naïve"]
    assert words_of(None) == words_of("") == words_of(" ​﻿ 123 ") == []
    assert "".join(words_of("a" * 1000)) == "a" * 1000
    assert features("Keel", 100) == features("keel", 100) and len(features("keel", 1 << 20)) > 1


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    t = Training(buckets=64, size=3)
    s = Shard(["keel sparrow keel", "index", "rudder plumage index", ""], [[1.0, 0.0], [0.0, 0.5], [0.0, 1.0], [1.0, 1.0]], [False, False, True, False], t)
    p = [rng.normal(size=(64, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)]

    def loss(table, out, bias):
        z = s.outputs(table, out, bias)
        each = np.log1p(np.exp(z)) - s.labels * z
        return each[~s.held].sum()

    bucket, g_table, g_out, g_bias = s.gradient(*p)
    whole = np.zeros((64, 3))
    whole[bucket] = g_table
    for j, g in enumerate((whole, g_out, g_bias)):
        for at in np.ndindex(*g.shape):
            q = [x.copy() for x in p]
            q[j][at] += 1e-5
            high = loss(*q)
            q[j][at] -= 2e-5
            assert (high - loss(*q)) / 2e-5 == pytest.approx(g[at], abs=2e-4)


def test_held_out_accuracy(spark, corpus):
    truth, docs, labels = corpus
    model = train(docs, labels, SUBJECTS, SMALL)
    got = {}
    for r in assign(docs.filter("doc_id >= 600"), model).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    right = sum(sorted(got.get(i, [])) == truth[i] for i in range(600, 900))
    assert right >= 285
    again = train(docs.repartition(5), labels.repartition(2), SUBJECTS, SMALL)
    assert np.allclose(again.bias, model.bias, atol=1e-2)  # whatever the partitions


def test_scorer_agrees_with_shard_and_survives_forgetting(corpus):
    rng = np.random.default_rng(1)
    model = Model(SUBJECTS, rng.normal(size=(256, 4)).astype(np.float32), rng.normal(size=(4, 2)).astype(np.float32), rng.normal(size=2).astype(np.float32), 0.0, {})
    texts = [text(random.Random(i), SUBJECTS[: i % 3]) for i in range(20)]
    want = Shard(texts, [[0.0, 0.0]] * 20, [False] * 20, Training(buckets=256, size=4)).outputs(model.table, model.out, model.bias)
    scorer = Scorer(model)
    assert np.allclose(scorer.score(texts), want, atol=1e-4)
    scorer.KEEP = 3
    assert np.allclose(scorer.score(texts), want, atol=1e-4) and np.allclose(scorer.score([texts[0], None, "", texts[1]])[[0, 3]], want[:2], atol=1e-4)
    assert not np.isfinite(scorer.score([None, ""])).any()


def test_labels_are_shares_of_annotators_and_bounded(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "doc_id bigint, text string").withColumn("labels", F.lit(1))
    labels = spark.createDataFrame([(1, "birds", "x"), (1, "none", "y"), (1, "birds", "x"), (2, "ships", None), (3, "birds", "x"), (9, "birds", "x"), (None, "birds", "x"), (4, None, "x")], "doc_id bigint, subject string, annotator string")
    assert {r.text: r.labels for r in labelled(docs, labels, SUBJECTS, SMALL).collect()} == {"a": [0.5, 0.0], "b": [0.0, 1.0], None: [1.0, 0.0]}
    assert labelled(docs, labels, SUBJECTS, Training(most_labelled=1)).count() <= 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "keel")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, subject string, annotator string")
    assert assign(docs, train(docs, none, SUBJECTS, SMALL)).count() == 0
    assert assign(docs.filter("false"), train(docs, none, [], SMALL)).count() == 0


def test_nulls_repeats_long_texts_and_other_columns(spark, corpus):
    _, docs, labels = corpus
    model = train(docs, labels, SUBJECTS, SMALL)
    clear = " ".join(VOCABULARY["ships"] * 3 + PLAIN * 5)
    rows = [(1, None), (2, ""), (3, " 123 "), (4, clear), (4, clear), (None, clear), (5, "index value list " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"subject": F.lit("x"), "labels": F.lit(1)})
    assert sorted((r.doc_id or 0, r.subject) for r in assign(df, model).collect()) == [(0, "ships"), (4, "ships"), (4, "ships")]
