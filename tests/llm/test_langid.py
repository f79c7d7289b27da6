"""The byte network against finite differences, and its accuracy on held-out documents."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import langid

FOLDER = "/root/testdata/sf0.001"


def test_gradients():
    net = langid.ByteNetwork(["a", "b", "c"], 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, label = langid.pad([b" ab ", b"xyz", b"q"]), np.array([0, 2, 1])
    _, grad = net.gradients(codes, label)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in v.shape)
            at = (ord("a"), at[1]) if k[0] == "x" else at
            v[at] += 1e-3
            up, _ = net.gradients(codes, label)
            v[at] -= 2e-3
            down, _ = net.gradients(codes, label)
            v[at] += 1e-3
            assert abs((up - down) / 2e-3 - grad[k][at]) < 1e-4


def test_padding_does_not_matter():
    net = langid.ByteNetwork(["a", "b"], 5)
    alone = net.probabilities(langid.pad([b"word"]))[:, 0]
    padded = net.probabilities(langid.pad([b"word", b"much longer word"]))[:4, 0]
    assert np.allclose(alone, padded, atol=1e-6)


@pytest.fixture(scope="module")
def model(spark):
    if not Path(FOLDER).exists():
        pytest.skip("test tables not available")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return langid.train_model(docs.where(~langid.held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where(langid.held_out(F.col("doc_id")))
    got = langid.predict_language(docs, model).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got) and all(0 < r["score"] <= 1 for r in got)


def test_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "日本"), (5, "e" * 100000), (None, "the of and"), (5, "the of and"), (5, "the of and")]
    docs = spark.createDataFrame([(*r, "x", 9.0) for r in rows], "doc_id bigint, text string, lang_pred string, score double")
    got = langid.predict_language(docs, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    by = [(r["doc_id"], r["lang_pred"], r["score"]) for r in got.collect()]
    assert [b[1:] for b in by[:3]] == [("und", 0.0)] * 3 and all(b[1] in model.langs for b in by[3:])
    assert len({b[1] for b in by[5:]}) == 1 and max(b[2] for b in by[5:]) - min(b[2] for b in by[5:]) < 1e-5
    assert langid.predict_language(docs.limit(0), model).count() == 0
    assert langid.predict_language(docs, None).where("lang_pred = 'und' and score = 0").count() == len(rows)


def test_mean_over_positions(spark, model):
    text = "The  quick\nbrown " + "x" * 70
    row = langid.predict_language(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).first()
    parts = [p for w in text.lower().encode().split() for p in langid._pieces(w)]
    total = sum(model.probabilities(langid.pad([p]))[:, 0].sum(axis=0) for p in parts) / sum(map(len, parts))
    assert abs(row["score"] - total.max()) < 1e-5 and row["lang_pred"] == model.langs[int(total.argmax())]


def test_learns_only_from_the_rows_given(spark):
    docs = spark.createDataFrame([(i, "aaa bbb" if i % 2 else "ccc ddd", "x" if i % 2 else "y") for i in range(40)] + [(99, "q", None)],
                                 "doc_id bigint, text string, lang string")
    small = langid.train_model(docs, 5, 2, steps=60)
    assert small.langs == ["x", "y"]
    got = {r["text"]: r["lang_pred"] for r in langid.predict_language(docs, small).collect()}
    assert got["aaa bbb"] == "x" and got["ccc ddd"] == "y"
    assert langid.train_model(docs.limit(0)) is None


def test_pieces_end_between_characters():
    for word in ["a" * 30, "a" * 31, "日本語" * 40, "é" * 33, "x\U0001F600" * 20, ""]:
        pieces = langid._pieces(word.encode())
        assert b"".join(pieces).decode() == f" {word} " and max(map(len, pieces)) <= langid.PIECE
        assert all(p.decode() for p in pieces)
    assert langid._pieces(b"\x80" * 70) and b"".join(langid._pieces(b"\x80" * 70)) == b" " + b"\x80" * 70 + b" "


def test_learns_languages_without_spaces(spark):
    rng = random.Random(3)
    signs = {"th": "กขคงจฉชซฌญ", "km": "កខគឃងចឆជឈញ", "zh": "的一是不了人我在有他", "ja": "のにはをたがでてと人"}
    text = lambda lang: "".join(rng.choice(signs[lang]) for _ in range(rng.choice([12, 40, 300])))
    rows = [(i, " ".join(rng.choice(["the", "of", "and", "house"]) for _ in range(30)), "en") for i in range(40)]
    rows += [(100 * k + i, text(lang), lang) for k, lang in enumerate(signs, 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = langid.train_model(docs.where("doc_id % 2 = 0"), 30, 20, steps=200)
    assert learned.langs == ["en", "ja", "km", "th", "zh"]
    got = langid.predict_language(docs.where("doc_id % 2 = 1").select("doc_id", "lang", "text"), learned).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got) and len(got) == 140
