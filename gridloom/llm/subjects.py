"""Problem 9: the subject areas a document is about, none, one or several.

A word's vector is the average of the embeddings of the word and of its subwords (character n-grams), all hashed into one table;
a document's is the sum of its distinct words' vectors, weighted by log(1 + count) and divided by the root of its length, so that
one mention in passing carries little. Each area has a logistic output of its own. Training is synchronous: the labelled
documents are spread over partitions, each returns its gradient for the current parameters, the driver adds them up and makes an
Adam step. As the model is linear in the words, a trained word is ten numbers, and every document is scored by looking its words up.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut, ship

_LOWER = "a-zÀ-῿Ⰰ-퟿豈-﻾０-ￜ\U00010000-\U0001efff"
#: Words, and the parts of names in camel or snake case; longer ones fall in pieces.
WORD = re.compile(f"[A-Z]?[{_LOWER}]{{1,64}}|[A-Z]{{1,64}}(?![a-z])")


@dataclass(frozen=True)
class Training:
    """The model's parameters, the same at every size of data."""

    most_labelled: int = 12_000  # documents the model is fitted to; of more, those with the least hash are taken
    buckets: int = 1 << 16
    size: int = 16
    steps: int = 32
    rate: float = 0.1
    decay: float = 1e-5
    shards: int = 8
    held_out: float = 0.1  # share of the labelled documents by which the threshold is chosen
    threshold: float = -1.25  # where the choice of the threshold starts from
    away: float = 0.05  # the F1 on the held-out documents that a threshold farther by 1 must gain
    seed: int = 7


def features(word: str, buckets: int) -> list[int]:
    """Hash buckets of a word and its subwords: n-grams of 4 and 5 characters, of 2 in scripts without spaces."""
    word = word.lower()
    marked = f"<{word}>"
    sizes = (2,) if any(ord(c) >= 0x2E80 for c in word) else (4, 5)
    grams = {marked[i : i + n] for n in sizes for i in range(len(marked) - n + 1)} - {marked}
    return [zlib.crc32(g.encode()) % buckets for g in [marked, *sorted(grams)]]


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall(text if text.isascii() else unicodedata.normalize("NFC", text))


def weights_of(counts: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (np.log1p(counts) / np.sqrt(length)).astype(np.float32)


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, starts, axis=0) if len(starts) else np.zeros((0, rows.shape[1]), dtype=rows.dtype)


class Shard:
    """Labelled documents of a partition, laid out for gradients."""

    def __init__(self, texts: list[str | None], labels: list[list[float]], held: list[bool], training: Training):
        vocabulary: dict[str, int] = {}
        word, count, pointer, length = [], [], [], []
        use = []
        for k, text in enumerate(texts):
            counts = Counter(w.lower() for w in words_of(text))
            if counts:
                use.append(k)
                pointer.append(len(word))
                word += [vocabulary.setdefault(w, len(vocabulary)) for w in counts]
                count += counts.values()
                length += [sum(counts.values())] * len(counts)
        self.pointer, self.word = np.array(pointer, dtype=np.int64), np.array(word, dtype=np.int64)
        self.weight = weights_of(np.array(count, dtype=np.float64), np.array(length, dtype=np.float64))
        self.labels = np.array([labels[k] for k in use], dtype=np.float32).reshape(len(use), -1)
        self.held = np.array([held[k] for k in use], dtype=bool)
        self.document = np.repeat(np.arange(len(use)), np.diff(np.append(self.pointer, len(word))))
        self.by_word = np.argsort(self.word, kind="stable")
        self.word_starts = np.searchsorted(self.word[self.by_word], np.arange(len(vocabulary)))
        parts = [features(w, training.buckets) for w in vocabulary]
        self.parts = np.array([len(p) for p in parts], dtype=np.float32).reshape(-1, 1)
        self.feature = np.array([f for p in parts for f in p], dtype=np.int64)
        self.feature_starts = np.concatenate([[0], np.cumsum(self.parts[:, 0])[:-1]]).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
        order = np.argsort(self.feature, kind="stable")
        self.bucket, self.bucket_starts = np.unique(self.feature[order], return_index=True)
        self.word_of_feature = np.repeat(np.arange(len(parts)), self.parts[:, 0].astype(np.int64))[order]

    def vectors(self, table: np.ndarray) -> np.ndarray:
        words = _sums(table[self.feature], self.feature_starts) / self.parts
        return _sums(words[self.word] * self.weight[:, None], self.pointer)

    def outputs(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray) -> np.ndarray:
        return self.vectors(table) @ out + bias

    def gradient(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, their gradients, and those of the outputs and biases, summed over the documents that aren't held out."""
        x = self.vectors(table)
        off = (1 / (1 + np.exp(-np.clip(x @ out + bias, -30, 30))) - self.labels) * ~self.held[:, None]
        back = (off @ out.T).astype(np.float32)
        words = _sums(back[self.document[self.by_word]] * self.weight[self.by_word][:, None], self.word_starts) / self.parts
        return self.bucket, _sums(words[self.word_of_feature], self.bucket_starts), (x.T @ off).astype(np.float32), off.sum(axis=0)


@dataclass
class Model:
    """A trained model: scores of an area above the threshold say that the document is about it."""

    subjects: list[str]
    table: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    threshold: float
    held_out: dict[str, float]

    def word_scores(self, word: str) -> np.ndarray:
        return self.table[features(word, len(self.table))].mean(axis=0) @ self.out


class Scorer:
    """Scores texts with a model; keeps the scores of the words it has met."""

    KEEP = 300_000

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.used = 0
        self.scores = np.zeros((1024, len(self.model.subjects)), dtype=np.float32)

    def _meet(self, word: str) -> int:
        n = self.number.get(word.lower())
        if n is None:
            n = self.used
            self.used += 1
            if n == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[n] = self.model.word_scores(word)
            self.number[word.lower()] = n
        self.number[word] = n
        return n

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Outputs of every text; a text without words has the least of all outputs, and is about nothing."""
        if len(self.number) > self.KEEP:
            self._forget()
        out = np.full((len(texts), len(self.model.subjects)), -np.inf, dtype=np.float32)
        codes, lengths = [], []
        get = self.number.get
        for text in texts:
            words = words_of(text)
            found = [get(w) for w in words]
            if None in found:
                found = [self._meet(w) if n is None else n for n, w in zip(found, words)]
            codes.append(np.array(found, dtype=np.int64))
            lengths.append(len(found))
        length = np.array(lengths, dtype=np.int64)
        if not length.sum():
            return out
        key, count = np.unique(np.repeat(np.arange(len(texts)), length) * np.int64(1 << 32) + np.concatenate(codes), return_counts=True)
        text, word = key >> 32, key & ((1 << 32) - 1)
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        weight = weights_of(count.astype(np.float64), length[text].astype(np.float64))
        out[text[starts]] = _sums(self.scores[word] * weight[:, None], starts) + self.model.bias
        return out


_decoded: dict[tuple[str, int], Shard] = {}


def decoded(run: str, k: int, blob: bytes) -> Shard:
    """A shard, kept in the worker from step to step; of an earlier run nothing is kept."""
    if (run, k) not in _decoded:
        for old in [key for key in _decoded if key[0] != run]:
            del _decoded[old]
        _decoded[run, k] = pickle.loads(blob)
    return _decoded[run, k]


def labelled(documents: DataFrame, labels: DataFrame, subjects: list[str], training: Training) -> DataFrame:
    """text, labels (for each subject the share of the document's annotators that gave it) and held, of at most most_labelled documents."""
    per = labels.filter("doc_id is not null and subject is not null").groupBy("doc_id").agg(
        F.greatest(F.count_distinct(F.coalesce("annotator", F.lit(""))), F.lit(1)).alias("_n"), *[F.count_distinct(F.when(F.col("subject") == s, F.coalesce("annotator", F.lit("")))).alias(f"_{k}") for k, s in enumerate(subjects)]
    )
    few = per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.most_labelled)
    share = F.array(*[(F.col(f"_{k}") / F.col("_n")).cast("float") for k in range(len(subjects))])
    chosen = few.select("doc_id", share.alias("labels"), (F.pmod(F.xxhash64("doc_id", F.lit(training.seed)), F.lit(1000)) < int(1000 * training.held_out)).alias("held"))
    # at most most_labelled short rows, so they may be broadcast
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "labels", "held")


def train(documents: DataFrame, labels: DataFrame, subjects: list[str], training: Training = Training()) -> Model:
    """Fits a model; without labelled documents it says that no document is about anything."""
    spark = documents.sparkSession
    ship(spark)
    k = len(subjects)
    rng = np.random.default_rng(training.seed)
    table = rng.normal(0, 0.05, (training.buckets, training.size)).astype(np.float32)
    out = rng.normal(0, 0.3, (training.size, k)).astype(np.float32)
    bias = np.full(k, -2.0, dtype=np.float32)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys, held = [], [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
            held += b.column(2).to_pylist()
        if texts:
            shard = Shard(texts, ys, held, training)
            yield pa.RecordBatch.from_pydict({"k": [TaskContext.get().partitionId()], "n": [int((~shard.held).sum())], "shard": pa.array([pickle.dumps(shard)], type=pa.binary())})

    rows = labelled(documents, labels, subjects, training)
    # bounded: most_labelled documents in a fixed number of shards
    shards = cut(rows.repartition(training.shards, F.xxhash64("text", "labels")).mapInArrow(lay_out, "k bigint, n bigint, shard binary"))
    n = shards.agg(F.sum("n")).first()[0] or 0
    if not n or not k:
        return Model(subjects, table[:1] * 0, out * 0, np.full(k, -np.inf, dtype=np.float32), 0.0, {})

    name = uuid.uuid4().hex

    def on_shards(work):
        given = spark.sparkContext.broadcast((table, out, bias))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                    result = work(decoded(name, k, blob.as_buffer()), *given.value)
                    yield pa.RecordBatch.from_pydict({"result": pa.array([pickle.dumps(result)], type=pa.binary())})

        got = [pickle.loads(bytes(r[0])) for r in shards.select("k", "shard").mapInArrow(run, "result binary").collect()]
        given.destroy()
        return got

    first, second = [np.zeros_like(p) for p in (table, out, bias)], [np.zeros_like(p) for p in (table, out, bias)]
    for step in range(1, training.steps + 1):
        sums = [np.zeros_like(p) for p in (table, out, bias)]
        for bucket, g_table, g_out, g_bias in on_shards(lambda s, *p: s.gradient(*p)):
            sums[0][bucket] += g_table
            sums[1] += g_out
            sums[2] += g_bias
        sums[0] = sums[0] / n + training.decay * table
        for j, (p, g) in enumerate(zip((table, out, bias), (sums[0], sums[1] / n, sums[2] / n))):
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.98 * second[j] + 0.02 * g * g
            p -= training.rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.98**step)) + 1e-9)
    pairs = on_shards(lambda s, *p: (s.outputs(*p)[s.held], s.labels[s.held]))
    scores, truth = np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]) >= 0.5

    def f1(at: float) -> float:
        said = scores > at
        return 2 * float((said & truth).sum()) / max(1.0, float(said.sum() + truth.sum()))

    threshold = max(np.arange(-2.0, 0.51, 0.25), key=lambda t: f1(t) - training.away * abs(t - training.threshold))
    return Model(subjects, table, out, bias, float(threshold), {"documents": float(len(scores)), "f1": f1(threshold)})


def assign(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and subject of each area a document is about; null, empty and wordless texts are about nothing.

    Row by row, without a shuffle: repeated rows come out as often as they go in.
    """
    spark = documents.sparkSession
    ship(spark)
    given = spark.sparkContext.broadcast(model)
    model_subjects = list(model.subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(given.value)
        names = np.array(model_subjects, dtype=object)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                text, area = np.nonzero(scorer.score(part.column(1).to_pylist()) > scorer.model.threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(names[area].tolist(), type=pa.string())], names=["doc_id", "subject"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, subject string")
