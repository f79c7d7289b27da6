"""The published quality numbers, from rows with the published counts per class."""

import pytest
from pyspark.sql import functions as F

from glossa.operators.evaluate import classification_report, macro_f1

# Pairs (expected, predicted, rows) with the true positives, false positives and false negatives
# per class of the published evaluation: anger 4,2,0; fear 10,0,0; joy 8,1,0; neutral 0,6,0; sadness 10,0,0;
# trust 0,0,9, and Faith 7,5,7; Fear 14,5,1; Forgiveness 0,0,5; Hope 1,2,2; Love 2,5,2.
EMOTION = [("anger", "anger", 4), ("fear", "fear", 10), ("joy", "joy", 8), ("sadness", "sadness", 10),
           ("trust", "anger", 2), ("trust", "joy", 1), ("trust", "neutral", 6)]
THEME = [("Faith", "Faith", 7), ("Fear", "Fear", 14), ("Hope", "Hope", 1), ("Love", "Love", 2),
         ("Faith", "Fear", 4), ("Faith", "Love", 3), ("Fear", "Faith", 1), ("Forgiveness", "Faith", 3),
         ("Forgiveness", "Hope", 2), ("Hope", "Love", 2), ("Love", "Faith", 1), ("Love", "Fear", 1)]


@pytest.mark.parametrize("pairs,accuracy,weighted,macro", [(EMOTION, 0.7805, 0.7495, 0.6235), (THEME, 0.5854, 0.5450, 0.4118)])
def test_published_scores(spark, pairs, accuracy, weighted, macro):
    rows = spark.createDataFrame(pairs, "truth string, pred string, n int").withColumn(
        "_", F.explode(F.sequence(F.lit(1), F.col("n"))))
    assert rows.count() == 41
    report = {r["label"]: r for r in classification_report(rows, "truth", "pred").collect()}
    assert round(report["accuracy"]["f1"], 4) == accuracy
    assert round(report["weighted avg"]["f1"], 4) == weighted
    labels = sorted({x for t, p, _ in pairs for x in (t, p)})
    assert round(macro_f1(rows, "truth", "pred", labels).first()["macro_f1"], 4) == macro == round(report["macro avg"]["f1"], 4)


def test_single_classes(spark):
    rows = spark.createDataFrame(EMOTION, "truth string, pred string, n int").withColumn(
        "_", F.explode(F.sequence(F.lit(1), F.col("n"))))
    report = {r["label"]: r["f1"] for r in classification_report(rows, "truth", "pred").collect()}
    assert report["trust"] == 0 and all(report[x] > 0.94 for x in ("fear", "joy", "sadness"))
