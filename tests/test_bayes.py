"""The closed-form learner against a plain version."""

import math
import re
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from glossa.plans import bayes

DOMAIN = ["a", "b", "c"]


def plain(train, text, alpha, weighted):
    """Posteriors of one text after training on (text, label) rows."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    counts = {x: Counter(w for t, y in train if y == x for w in words(t)) for x in DOMAIN}
    vocabulary = {w for c in counts.values() for w in c}
    rows = Counter(y for _, y in train)
    weight = {x: 1 / max(weighted.get(x, 0), 1) if weighted else 1.0 for x in DOMAIN}
    total = sum(weight[x] * rows[x] for x in DOMAIN)
    z = {}
    for x in DOMAIN:
        if not rows[x]:
            continue
        mass = weight[x] * sum(counts[x].values()) + alpha * len(vocabulary)
        z[x] = math.log(weight[x] * rows[x] / total) + sum(
            math.log((weight[x] * counts[x][w] + alpha) / mass) for w in words(text) if w in vocabulary)
    peak = max(z.values())
    parts = {x: math.exp(v - peak) for x, v in z.items()}
    return {x: parts.get(x, 0) / sum(parts.values()) for x in DOMAIN}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, f"{'red green'.split()[i % 2]} {'Sea sky É'.split()[i % 3]} w{i % 4}x word", "ab"[i % 2 if i % 7 else 0], i % 3) for i in range(40)]
    rows += [(100, None, "a", 0), (101, "", "b", 1), (102, "only here", "c", 2), (103, "12 !", "a", 1), (104, "other", "zzz", 0)]
    return rows, spark.createDataFrame(rows, "id int, text string, label string, fold int")


@pytest.mark.parametrize("weighted", [True, False])
def test_posteriors(spark, labelled, weighted):
    rows, frame = labelled
    train = [(t, y) for _, t, y, _ in rows if y in DOMAIN]
    asked = [(1, "red sea never", 5), (2, None, 6), (3, "only", 7), (4, "unknown", 8), (5, "Red red GREEN é", 9)]
    got = bayes.posteriors(frame, spark.createDataFrame(asked, "id int, text string, extra int"), DOMAIN, ["id"], 0.5, weighted)
    assert got.columns == ["id", "extra", "pred", "pred_score", "pred_probs"]
    sizes = Counter(y for _, y in train)
    for r in got.collect():
        want = plain(train, asked[r["id"] - 1][1], 0.5, sizes if weighted else {})
        assert {p["label"]: p["score"] for p in r["pred_probs"]} == pytest.approx(want)
        assert r["pred"] == max(DOMAIN, key=lambda x: want[x]) and r["pred_score"] == pytest.approx(max(want.values()))


def test_every_fold_from_one_count(spark, labelled):
    rows, frame = labelled
    inside = [r for r in rows if r[2] in DOMAIN]
    own = frame.select("id", "label", "fold")
    counted = bayes.word_counts(frame, ["id", "label", "fold"])
    model = bayes.fit_bayes(own, counted, DOMAIN, 3, True)
    logits = bayes.bayes_logits(own, counted, model, ["id"], [0.1, 2.0])
    got = {(r["alpha"], r["id"]): r for r in bayes.bayes_predictions(logits, DOMAIN).collect()}
    sizes = Counter(y for _, _, y, _ in inside)
    for alpha in (0.1, 2.0):
        for i, text, _, fold in inside:
            want = plain([(t, y) for _, t, y, f in inside if f != fold], text, alpha, sizes)
            assert {p["label"]: p["score"] for p in got[alpha, i]["pred_probs"]} == pytest.approx(want)
    scores = bayes.bayes_search(frame, DOMAIN, ["id"], 3, [0.1, 2.0], [True, False])
    assert scores.count() == 12 and bayes.best_parameters(scores).count() == 4


def test_empty_tables(spark, labelled):
    _, frame = labelled
    none = frame.where("false")
    assert bayes.posteriors(frame, none.select("id", "text"), DOMAIN, ["id"]).count() == 0
    assert bayes.bayes_search(none, DOMAIN, ["id"], 2).where(F.col("macro_f1") > 0).count() == 0


@pytest.mark.parametrize("frequent", [0.5, 8, 1 << 20])
def test_frequent_and_rare_words_add_up(spark, labelled, frequent):
    """words that are broadcast and words that are shuffled, all of one kind or of both."""
    rows, frame = labelled
    inside = [r for r in rows if r[2] in DOMAIN]
    own, counted = frame.select("id", "label", "fold"), bayes.word_counts(frame, ["id", "label", "fold"])
    model = bayes.fit_bayes(own, counted, DOMAIN, 3, True)
    logits = bayes.bayes_logits(own, counted, model, ["id"], [0.1, 2.0], [False, True], frequent)
    got = {(r["alpha"], r["weighted"], r["id"]): r for r in bayes.bayes_predictions(logits, DOMAIN).collect()}
    assert len(got) == 4 * len(rows)
    sizes = Counter(y for _, _, y, _ in inside)
    for (alpha, weighted), (i, text, _, fold) in product(product([0.1, 2.0], [False, True]), inside):
        want = plain([(t, y) for _, t, y, f in inside if f != fold], text, alpha, sizes if weighted else {})
        assert {p["label"]: p["score"] for p in got[alpha, weighted, i]["pred_probs"]} == pytest.approx(want)


def test_words_are_not_shuffled_to_be_counted(labelled, capsys):
    """a row's words are counted where it is read."""
    _, frame = labelled
    bayes.word_counts(frame, ["id"]).explain()
    assert "Exchange" not in capsys.readouterr().out
    got = {(r["id"], r["word"]): r["n"] for r in bayes.word_counts(frame.where("id IN (3, 100, 101, 103)"), ["id"]).collect()}
    assert got == {(3, w): 1 for w in ("green", "sea", "w", "x", "word")}


def test_counting_holds_one_row(spark, capsys):
    """no hash table of a task's documents and words; runs of equal words, blanks and nulls inside one row."""
    frame = spark.createDataFrame([(1, "b a b, B a c"), (2, None), (3, " 1 "), (1, "b")], "id int, text string")
    counted = bayes.word_counts(frame, ["id"])
    counted.explain()
    assert "Aggregate" not in capsys.readouterr().out
    assert sorted(map(tuple, counted.collect())) == [(1, "a", 2), (1, "b", 1), (1, "b", 3), (1, "c", 1)]


def test_words_of_one_table_are_counted_once(labelled, monkeypatch):
    """the table that a model is fitted on and judges is split into words once, with the result of two tables."""
    _, frame = labelled
    calls, count = [], bayes.word_counts
    monkeypatch.setattr(bayes, "word_counts", lambda *a: calls.append(a) or count(*a))
    got, want = (bayes.posteriors(frame, asked, DOMAIN, ["id"], 0.5).orderBy("id").collect() for asked in (frame, frame.select("*")))
    assert len(calls) == 3 and len(got) == 45
    for a, b in zip(got, want):
        assert (a["id"], a["label"], a["pred"]) == (b["id"], b["label"], b["pred"])
        assert [p["score"] for p in a["pred_probs"]] == pytest.approx([p["score"] for p in b["pred_probs"]])


def test_as_many_words_as_allowed_are_broadcast(spark):
    """words stay unshuffled while there is room for them, however small their share."""
    texts = [(i, "often " * 500 + " ".join(f"w{'abcdefghij'[j // 10]}{'abcdefghij'[j % 10]}" for j in range(100)), "ab"[i]) for i in range(2)]
    frame = spark.createDataFrame(texts, "id int, text string, label string")
    counted = bayes.word_counts(frame, ["id", "label"])
    model = bayes.fit_bayes(frame, counted, DOMAIN)
    sizes = {most: [part.count() for part in bayes._met(counted.withColumn("fold", F.lit(0)), model, ["id"], most)] for most in (0, 1, 100, 101)}
    assert sizes == {0: [0, 202], 1: [2, 200], 100: [2, 200], 101: [202, 0]}
