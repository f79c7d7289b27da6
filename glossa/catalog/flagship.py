"""The flagship query: clean, label and evaluate all documents in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.catalog.registry import Tables
from glossa.catalog.roles import LEXICON
from glossa.functions.labels import join_labels
from glossa.functions.scores import labels_above, top_label
from glossa.functions.text import ascii_punctuation, clean_text
from glossa.operators.evaluate import classification_report
from glossa.operators.scoring import lexicon_predictions


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).spread("documents").select(
        "doc_id", "lang", ascii_punctuation(clean_text(F.col("text"))).alias("text"))
    labelled = lexicon_predictions(docs, "text", LEXICON).select(
        "doc_id", "lang", top_label(F.col("preds")).alias("pred"),
        join_labels(labels_above(F.col("preds"), 0.3)).alias("labels"))
    return classification_report(labelled, "lang", "pred")
