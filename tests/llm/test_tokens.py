import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridloom.llm import tokens
from gridloom.llm.tokens import VOCABULARY, ForcedBoundaryEncoder, count_tokens, encode_corpus


@pytest.fixture(scope="module")
def encoder():
    return ForcedBoundaryEncoder(VOCABULARY)


def peculiar(n, seed=0):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\r\n", "\t", "'", "''", "'s", "'re", "'re'", "re", "é", "é", "漢", "字", "かな", " ", " ", "　", "\u0085", " ", "a", "B", "1", "22", "(", ")", "_", "-", "🙂", "👩‍🚀", "हि", "न्दी", ".", "§", '"', "<|endoftext|>", "​", "\x1c", "\x0b", "\x00", "\x7f", "ʼ", "ß", "İ", "xxx", "word", " the", "﻿", "\U0001f9ea"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(n)]


def test_equal_to_encoding_whole_texts(encoder):
    texts = peculiar(20_000)
    assert encoder.encode(pa.array(texts)).to_pylist() == [encoder.plain(t) for t in texts]
    assert encoder.encode(pa.array(texts), True).to_pylist() == [len(encoder.plain(t)) for t in texts]


def test_equal_to_the_other_library(encoder):
    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = peculiar(500, 7)
    assert encoder.encode(pa.array(texts)).to_pylist() == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_small_chunks_and_forgetting_change_nothing(encoder, monkeypatch):
    texts = peculiar(300, 3) + ["a" * 5000, " " * 3000, "word " * 2000, "漢" * 3000]
    want = [encoder.plain(t) for t in texts]
    monkeypatch.setattr(tokens, "CHUNK", 64)
    monkeypatch.setattr(tokens, "KEEP", 20)
    assert ForcedBoundaryEncoder(VOCABULARY).encode(pa.array(texts)).to_pylist() == want


def test_round_trip(encoder):
    import base64

    with open(VOCABULARY, "rb") as f:
        token = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
    texts = peculiar(500, 5)
    assert [b"".join(token[i] for i in ids).decode() for ids in encoder.encode(pa.array(texts)).to_pylist()] == texts


def test_cuts_are_certain(encoder):
    cut = encoder.cut.reshape(256, 256)
    assert cut[ord("a"), ord("(")] and cut[ord("a"), ord(" ")] and not cut[ord("t"), ord("h")] and not cut[ord(" "), ord("t")]
    assert not cut[:, 0x80:0xC0].any() and not cut[:, ord("'")].any()


def test_frames(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "  "), (1, "hello world"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    plain = ForcedBoundaryEncoder.of(VOCABULARY).plain
    assert sorted(((r.doc_id or 0, r.ids) for r in encode_corpus(df, ["doc_id"]).collect())) == sorted((d or 0, plain(t or "")) for d, t in rows)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(df, ["doc_id"]).collect()) == sorted((d or 0, len(plain(t or ""))) for d, t in rows)
    assert encode_corpus(df.filter("false"), ["doc_id"]).count() == 0
    assert dict(encode_corpus(df, ["doc_id"]).dtypes)["ids"] == "array<int>"


def test_very_long_texts(encoder):
    texts = ["a" * 200_000, " " * 200_000, "漢" * 100_000, "return value(" * 60_000, "\n" * 100_000]
    assert encoder.encode(pa.array(texts)).to_pylist() == [encoder.plain(t) for t in texts]
