"""Training and applying a text classifier on a labelled table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import product

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.labels import label_id, label_name
from glossa.functions.scores import top_prediction, zip_predictions
from glossa.operators.evaluate import class_weights, macro_f1
from glossa.operators.sampling import stratified_folds
from glossa.session import scratch_path


def _counting(features: int) -> list:
    """Stages that need no training: words and their hashed counts."""
    return [RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}]+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)]


def _learning(iterations: int, regularization: float, elastic: float, min_docs: int) -> list:
    """Stages that learn: inverse document frequencies and the weighted classifier."""
    return [IDF(inputCol="_tf", outputCol="_features", minDocFreq=min_docs),
            LogisticRegression(featuresCol="_features", labelCol="label_id", weightCol="weight",
                               maxIter=iterations, regParam=regularization, elasticNetParam=elastic)]


def text_classifier(features: int = 1 << 16, iterations: int = 20, regularization: float = 0.01,
                    elastic: float = 0.0, min_docs: int = 1) -> Pipeline:
    """Word counts -> TF-IDF -> weighted multinomial logistic regression."""
    return Pipeline(stages=_counting(features) + _learning(iterations, regularization, elastic, min_docs))


def training_frame(df: DataFrame, text: str, label: str, domain: Sequence[str], weighted: bool = True,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Rows with a domain label as (text, label, label_id, weight, kept columns)."""
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).alias("label"), *keep)
    rows = rows.where(F.col("label").isin(*domain)).withColumn("label_id", label_id(F.col("label"), domain))
    if not weighted:
        return rows.withColumn("weight", F.lit(1.0))
    # one weight per domain label, so the broadcast side has a fixed size
    weights = class_weights(rows, "label", domain).select("label", "weight")
    return rows.join(F.broadcast(weights), "label")


def fit(df: DataFrame, **params) -> PipelineModel:
    """Train on a training frame."""
    data = df.select("text", F.col("label_id").cast("double").alias("label_id"), "weight")
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return text_classifier(**params).fit(data)
    finally:
        data.unpersist()


def predict(model: PipelineModel, df: DataFrame, domain: Sequence[str], out: str = "pred") -> DataFrame:
    """Top label, its score and all class probabilities of each text.

    ``<out>_probs`` is an array of (label, score) in domain order.
    """
    keep = df.columns
    scored = model.transform(df)
    classes = model.stages[-1].numClasses
    probs = zip_predictions(F.array(*[F.lit(x) for x in list(domain)[:classes]]),
                            F.slice(vector_to_array(F.col("probability")), F.lit(1), F.lit(min(classes, len(domain)))))
    scored = scored.withColumn(f"{out}_probs", probs)
    best = top_prediction(F.col(f"{out}_probs"))
    return scored.select(*keep, best["label"].alias(out), best["score"].alias(f"{out}_score"), f"{out}_probs")


def counted_folds(df: DataFrame, fold: str = "fold", features: int = 1 << 16) -> DataFrame:
    """Word counts of a training frame, written once and partitioned by fold.

    They do not depend on the model, so every model of a cross-validation or search
    reads counts instead of texts, and only the partitions of its folds.
    """
    path = scratch_path(df.sparkSession, "folds")
    counted = PipelineModel(_counting(features)).transform(df)
    counted.select("label", "label_id", "weight", "_tf", fold).write.partitionBy(fold).parquet(path)
    return df.sparkSession.read.parquet(path).withColumn("label_id", F.col("label_id").cast("double"))


def cross_validate(df: DataFrame, domain: Sequence[str], fold: str = "fold", k: int = 5,
                   features: int = 1 << 16, **learning) -> DataFrame:
    """Macro-F1 per fold over a training frame with a fold column, as (fold, macro_f1)."""
    return validate(counted_folds(df, fold, features), domain, fold, k, **learning)


def validate(stored: DataFrame, domain: Sequence[str], fold: str = "fold", k: int = 5, iterations: int = 20,
             regularization: float = 0.01, elastic: float = 0.0, min_docs: int = 1) -> DataFrame:
    """M14 over ``counted_folds``."""
    tested = None
    for i in range(k):
        learner = Pipeline(stages=_learning(iterations, regularization, elastic, min_docs))
        model = learner.fit(stored.where(F.col(fold) != i))
        part = predict(model, stored.where(F.col(fold) == i), domain).select(fold, "label", "pred")
        tested = part if tested is None else tested.unionByName(part)
    return macro_f1(tested, "label", "pred", domain, by=[fold])


def train_and_validate(df: DataFrame, text: str, label: str, domain: Sequence[str], key: Sequence[str],
                       k: int = 5, seed=42, **params) -> DataFrame:
    """M11 + M14: stratified folds, one model per fold, macro-F1 per fold."""
    frame = training_frame(df, text, label, domain, keep=key)
    return cross_validate(stratified_folds(frame, "label", key, k, seed), domain, k=k, **params)


def search(df: DataFrame, domain: Sequence[str], grid: Mapping[str, Iterable], fold: str = "fold",
           k: int = 5) -> DataFrame:
    """Mean macro-F1 of every parameter combination, best first.

    ``df`` is a training frame with folds. Combinations run one after the other;
    each fit is a distributed job of its own.
    """
    names = list(grid)
    scores, counted = None, {}
    for values in product(*grid.values()):
        params = dict(zip(names, values))
        learning = {n: v for n, v in params.items() if n != "features"}
        size = params.get("features", 1 << 16)
        if size not in counted:
            counted[size] = counted_folds(df, fold, size)
        mean = validate(counted[size], domain, fold, k, **learning).agg(F.avg("macro_f1").alias("macro_f1"))
        row = mean.select(*[F.lit(v).alias(n) for n, v in params.items()], "macro_f1")
        scores = row if scores is None else scores.unionByName(row)
    return scores.orderBy(F.desc("macro_f1"), *names)


def label_names(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Label ids back to names."""
    return df.withColumn(column, label_name(F.col(column), list(domain)))
