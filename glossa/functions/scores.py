"""Expressions over classifier output: ``array<struct<label,score>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.labels import lookup


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def zip_predictions(labels: Column, scores: Column) -> Column:
    """Parallel arrays -> predictions."""
    return F.zip_with(labels, scores, lambda l, s: F.struct(l.alias("label"), s.alias("score")))


def top_prediction(preds: Column) -> Column:
    """Highest score, the first listed wins ties; null for no predictions."""
    def best(found):
        scores = F.transform(found, lambda p: p["score"])
        return F.get(found, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))

    return let(preds, best)


def top_label(preds: Column) -> Column:
    return top_prediction(preds)["label"]


def top_score(preds: Column) -> Column:
    return top_prediction(preds)["score"]


def labels_above(preds: Column, threshold: float = 0.7) -> Column:
    """Every label with score >= threshold, in classifier order."""
    return F.transform(F.filter(preds, lambda p: p["score"] >= threshold), lambda p: p["label"])


def ranked(preds: Column) -> Column:
    """Predictions by falling score, input order on ties."""
    keyed = F.transform(preds, lambda p, i: F.struct((-p["score"]).alias("k"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def override_neutral(preds: Column, mapping: dict, threshold: float = 0.35,
                     has_neutral: bool = True) -> Column:
    """A weak neutral top prediction gives way to the best non-neutral one.

    Returns a struct (label, mapped, score).
    """
    def mapped(p):
        return lookup(p["label"], mapping, "neutral")

    def out(p):
        return F.when(p.isNotNull(), F.struct(
            p["label"].alias("label"), mapped(p).alias("mapped"), p["score"].alias("score")))

    if not has_neutral:
        return let(top_prediction(preds), out)

    def choose(found):
        other = F.get(ranked(F.filter(found, lambda p: mapped(p) != "neutral")), F.lit(0))
        return let(F.struct(top_prediction(found).alias("top"), other.alias("other")), lambda x: F.when(
            (mapped(x["top"]) == "neutral") & (x["top"]["score"] < threshold) & x["other"].isNotNull(),
            out(x["other"])).otherwise(out(x["top"])))

    return let(preds, choose)


def softmax(logits: Column) -> Column:
    """numerically stable softmax of an array of doubles."""
    powers = let(logits, lambda z: let(F.array_max(z), lambda peak: F.transform(z, lambda x: F.exp(x - peak))))
    return let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x),
                                     lambda total: F.transform(p, lambda x: x / total)))
