"""Agreement and classification quality."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.plans.ranking import first_per_group


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (truth, prediction): the one pass over the rows that the reports need."""
    return (df.where(F.col(truth).isNotNull())
            .groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_counts(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """True positives, predictions and support of every label seen on either side."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    roles = F.array(
        F.struct(F.col("truth").alias("label"), F.coalesce(hit, F.lit(0)).alias("tp"),
                 F.lit(0).cast("bigint").alias("predicted"), F.col("n").alias("support")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("support")))
    long = confusion(df, truth, pred, by).select(*by, F.explode(roles).alias("_r")).select(*by, "_r.*")
    return (long.where(F.col("label").isNotNull()).groupBy(*by, "label")
            .agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"),
                 F.sum("support").alias("support")))


def _ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def per_class(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label; a zero denominator gives 0."""
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return class_counts(df, truth, pred, by).select(
        *by, "label", "tp", (predicted - tp).alias("fp"), (support - tp).alias("fn"),
        _ratio(tp, predicted).alias("precision"), _ratio(tp, support).alias("recall"),
        _ratio(2.0 * tp, predicted + support).alias("f1"), "support")


def classification_report(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Per-class rows followed by accuracy, macro and weighted averages.

    The averages are computed from the class rows, whose number is the number of
    labels, by one grouping-sets pass.
    """
    classes = per_class(df, truth, pred, by)
    weight = F.col("support")
    total = F.sum(weight)
    accuracy = F.sum("tp") / total
    averages = classes.groupBy(*by).agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), accuracy.alias("precision"), accuracy.alias("recall"),
                     accuracy.alias("f1"), total.alias("support")),
            F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")),
            F.struct(F.lit("weighted avg").alias("label"),
                     (F.sum(F.col("precision") * weight) / total).alias("precision"),
                     (F.sum(F.col("recall") * weight) / total).alias("recall"),
                     (F.sum(F.col("f1") * weight) / total).alias("f1"), total.alias("support")),
        ).alias("_rows"))
    averages = averages.select(*by, F.explode("_rows").alias("_r")).select(*by, "_r.*")
    columns = [*by, "label", "precision", "recall", "f1", "support"]
    return classes.select(*columns).unionByName(averages.select(*columns))


def macro_f1(df: DataFrame, truth: str, pred: str, domain: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean F1 over a fixed label domain, absent labels counting as 0."""
    inside = F.when(F.col("label").isin(*domain), F.col("f1")).otherwise(0.0)
    return per_class(df, truth, pred, by).groupBy(*by).agg(
        (F.sum(inside) / F.lit(len(domain))).alias("macro_f1"))


def agreement_rates(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Agreement of every pair of labelings in one pass; missing never agrees."""
    pairs = list(combinations(models, 2))
    rate = [F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("double")).alias(f"_{i}")
            for i, (a, b) in enumerate(pairs)]
    rows = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                              F.col(f"_{i}").alias("agreement")) for i, (a, b) in enumerate(pairs)])
    return df.agg(*rate).select(F.explode(rows).alias("_r")).select("_r.*")


def set_agreement(df: DataFrame, left: str, right: str) -> DataFrame:
    """Exact-set match rate and mean Jaccard of two label-array columns.

    Two empty sets match exactly but have Jaccard 0.
    """
    a, b = F.array_distinct(left), F.array_distinct(right)
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    same = F.array_sort(a) == F.array_sort(b)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(same.cast("double")).alias("exact_match"),
        F.avg(both / F.greatest(either, F.lit(1))).alias("mean_jaccard"))


def error_examples(df: DataFrame, truth: str, pred: str, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` false positives and false negatives of every class."""
    kinds = F.array(
        F.struct(F.col(pred).alias("label"), F.lit("false_positive").alias("error_type")),
        F.struct(F.col(truth).alias("label"), F.lit("false_negative").alias("error_type")))
    wrong = (df.where(F.col(truth) != F.col(pred)).withColumn("_k", F.explode(kinds))
             .select("*", "_k.label", "_k.error_type").drop("_k"))
    return first_per_group(wrong, ["label", "error_type"], order_by, n)


def class_weights(df: DataFrame, label: str, domain: Sequence[str]) -> DataFrame:
    """``1 / max(count, 1)`` for every domain label, absent ones included, in domain order."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    known = domain_frame(df.sparkSession, domain)
    n = F.coalesce(F.col("n"), F.lit(0))
    return (known.join(counts, "label", "left")
            .select("label_id", "label", n.alias("n"), (F.lit(1.0) / F.greatest(n, F.lit(1))).alias("weight"))
            .orderBy("label_id"))


def domain_frame(spark: SparkSession, domain: Sequence[str]) -> DataFrame:
    """Label domain as (label_id, label) rows."""
    return spark.createDataFrame([(i, label) for i, label in enumerate(domain)], "label_id int, label string")


def fold_summary(metrics: DataFrame, value: str) -> DataFrame:
    """Mean and population standard deviation over folds."""
    return metrics.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def evaluate_examples(df: DataFrame, expected: Sequence[str], predicted: Sequence[str],
                      names: Sequence[str]) -> DataFrame:
    """Add ``<name>_match`` flags comparing predictions with expectations."""
    out = df
    for want, got, name in zip(expected, predicted, names):
        out = out.withColumn(f"{name}_match", F.coalesce(F.col(want) == F.col(got), F.lit(False)))
    return out
