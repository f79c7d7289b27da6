"""A closed-form text classifier: weighted multinomial naive Bayes from grouped word counts.

Beside the iterative learner of ``plans/training.py``. A model is a table of whole-number counts, so all folds of a
cross-validation come from one count: a fold's model is the total less the fold's own counts. A whole grid of
parameters is scored in one pass over the words.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.scores import softmax, top_prediction, zip_predictions
from glossa.operators.evaluate import macro_f1
from glossa.operators.scoring import counted_words, split_words
from glossa.session import scratch_path

FREQUENT = 1 << 19  # rows of a model that may be broadcast


class BayesModel(NamedTuple):
    """Counts of each word by class (fold, word, counts) and of each class (fold, docs, every, weights, total, known).

    Arrays are in the order of ``domain``. Without folds every row has fold 0. ``every`` are the rows of a class in all folds.
    """

    words: DataFrame
    classes: DataFrame
    domain: tuple[str, ...]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_counts(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` columns, word and n: how often each lower-case word occurs in a row's text, counted inside the row.

    ``keep`` identifies rows. Rows without words, null texts among them, have none.
    """
    return counted_words(df, keep, split_words(F.col(text)))


def _by_class(domain: Sequence[str], value: Column) -> Column:
    """Sum of a value for each class, as an array."""
    return F.array(*[F.coalesce(F.sum(F.when(F.col("label") == x, value)), F.lit(0).cast("bigint")) for x in domain])


def _sums(array: str, size: int) -> Column:
    return F.array(*[F.sum(F.get(F.col(array), F.lit(i))) for i in range(size)])


def _weights(every: Column, weighted: bool) -> Column:
    return F.transform(every, lambda n: F.lit(1.0) / F.greatest(n, F.lit(1)) if weighted else F.lit(1.0))


def fit_bayes(rows: DataFrame, counted: DataFrame, domain: Sequence[str], k: int | None = None, weighted: bool = True) -> BayesModel:
    """The model of a labelled table, or with ``k`` the ``k`` models that leave out one fold each.

    ``rows`` has label (and fold), ``counted`` label, word and n (and fold); rows with other labels are left out. ``weighted`` gives
    every class the weight 1 / its rows (A15), so that rare classes count like common ones.
    """
    size = len(domain)
    rows, counted = (df.where(F.col("label").isin(*domain)) for df in (rows, counted))
    docs = rows.groupBy(*([] if k is None else ["fold"])).agg(_by_class(domain, F.lit(1).cast("bigint")).alias("own"))
    if k is None:
        model = counted.groupBy("word").agg(_by_class(domain, F.col("n")).alias("counts")).select(F.lit(0).alias("fold"), "word", "counts")
        left = docs.select(F.lit(0).alias("fold"), F.col("own").alias("docs"), F.col("own").alias("every"))
    else:
        folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
        less = F.zip_with("every", F.coalesce("own", F.array_repeat(F.lit(0).cast("bigint"), size)), lambda a, b: a - b)
        # a word's counts of all folds come together as one row
        owns = F.array(*[_by_class(domain, F.when(F.col("fold") == i, F.col("n"))) for i in range(k)])
        model = (counted.groupBy("word").agg(_by_class(domain, F.col("n")).alias("every"), owns.alias("owns"))
                 .select("word", "every", F.posexplode("owns").alias("fold", "own")).select("fold", "word", less.alias("counts")))
        left = (docs.agg(_sums("own", size).alias("every")).select("every", folds).join(docs, "fold", "left")
                .select("fold", less.alias("docs"), "every"))
    model = _written(model.where(F.exists("counts", lambda c: c > 0)), "bayes")
    masses = model.groupBy("fold").agg(_sums("counts", size).alias("total"), F.count(F.lit(1)).alias("known"))
    classes = left.withColumn("weights", _weights(F.col("every"), weighted)).join(masses, "fold", "left")  # one row per fold
    return BayesModel(model, _written(classes, "classes"), tuple(domain))


def _met(counted: DataFrame, model: BayesModel, key: Sequence[str], frequent: int) -> list[DataFrame]:
    """Counted words with their model rows (key, fold, n, counts), each in one of two tables.

    The most frequent words, as many as have ``frequent`` rows at most, are broadcast, and the counted words that meet them,
    most of a text, stay where they are. Words are ranked by the binary digits of their occurrences, so only a count for
    each number of digits is read here. The others meet by shuffle and are dealt by ``key``, counts and not yet sums, which are wider.
    """
    mass = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    ranked = model.words.withColumn("_digits", F.length(F.bin(mass)))
    left, least = frequent, 65
    for digits, n in sorted(ranked.groupBy("_digits").count().collect(), reverse=True):  # 63 rows at most
        left -= n
        if left < 0:
            break
        least = digits
    often, rare = (ranked.where(c).drop("_digits") for c in (F.col("_digits") >= least, F.col("_digits") < least))
    on, asked = ["fold", "word"], counted.select(*key, "fold", "word", "n")
    near = asked.join(F.broadcast(often), on)
    far = asked.join(F.broadcast(often), on, "left").where("counts IS NULL").drop("counts").join(rare, on)  # the same broadcast
    kept = [*key, *[c for c in ("fold", "n", "counts") if c not in key]]
    return [near.select(*kept), far.select(*kept).repartition(*key)]


def bayes_logits(rows: DataFrame, counted: DataFrame, model: BayesModel, key: Sequence[str], alphas: Sequence[float] = (1.0,),
                 weightings: Sequence[bool] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """``rows`` with alpha and logits, the logarithms of prior times likelihood of each class, for every ``alpha``.

    ``rows`` and ``counted`` (key, fold, word, n) name by fold the model that judges a row. Words that the model never
    saw are left out; a class without rows has minus infinity. With ``weightings`` there is a row for each of them and each
    alpha, with a column weighted, instead of the weights that the model was fitted with. ``counted`` is read more than
    once, so it should be a written table, as the model is. At most ``frequent`` rows of the model are broadcast.
    """
    size = len(model.domain)
    classes, weights = model.classes, ["weights"]
    if weightings is not None:
        weights = [f"_weights{int(w)}" for w in weightings]
        classes = classes.select("*", *[_weights(F.col("every"), w).alias(c) for c, w in zip(weights, weightings)])
    classes = F.broadcast(classes)
    options = [(a, i) for i in range(len(weights)) for a in alphas]

    def likelihood(alpha: float, weight: str, i: int) -> Column:
        of_weight, of_word, of_class = (F.get(F.col(c), F.lit(i)) for c in (weight, "counts", "total"))
        return F.sum(F.col("n") * F.ln((of_weight * of_word + alpha) / (of_weight * of_class + alpha * F.col("known"))))

    near, far = (met.join(classes, "fold").groupBy(*key).agg(
        F.array(*[F.array(*[likelihood(a, weights[w], i) for i in range(size)]) for a, w in options]).alias(out))
        for met, out in zip(_met(counted, model, key, frequent), ("_near", "_far")))

    def prior(weight: str) -> Column:
        mass = F.zip_with(weight, "docs", lambda w, n: w * n)
        shift = F.ln(F.aggregate(mass, F.lit(0.0), lambda a, m: a + m))
        return F.transform(mass, lambda m: F.when(m > 0, F.ln(m)).otherwise(F.lit(float("-inf"))) - shift)

    none = F.array_repeat(F.lit(0.0), size)
    listed = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), *([] if weightings is None else [F.lit(weightings[w]).alias("weighted")]),
                                prior(weights[w]).alias("prior"), F.coalesce(F.get("_near", F.lit(j)), none).alias("near"),
                                F.coalesce(F.get("_far", F.lit(j)), none).alias("far")) for j, (a, w) in enumerate(options)])
    judged = rows.join(near, list(key), "left").join(far, list(key), "left").join(classes, "fold").withColumn("_o", F.explode(listed))
    sums = F.zip_with("_o.near", "_o.far", lambda a, b: a + b)
    return judged.select(*rows.columns, "_o.alpha", *([] if weightings is None else ["_o.weighted"]),
                         F.zip_with("_o.prior", sums, lambda p, s: p + s).alias("logits"))


def bayes_predictions(logits: DataFrame, domain: Sequence[str], out: str = "pred") -> DataFrame:
    """Top label, its posterior and all posteriors of each row of ``bayes_logits``."""
    probs = zip_predictions(F.array(*[F.lit(x) for x in domain]), softmax(F.col("logits")))
    scored = logits.withColumn(f"{out}_probs", probs)
    best = top_prediction(F.col(f"{out}_probs"))
    return scored.select(*[c for c in logits.columns if c != "logits"], best["label"].alias(out), best["score"].alias(f"{out}_score"),
                         f"{out}_probs")


def bayes_search(frame: DataFrame, domain: Sequence[str], key: Sequence[str], k: int, alphas: Sequence[float] = (1.0,),
                 weightings: Sequence[bool] = (True,)) -> DataFrame:
    """Macro-F1 of every fold for every parameter combination: alpha, weighted, fold, macro_f1.

    ``frame`` has text, label, fold and the key that identifies rows. Words are counted once and written; one count of
    classes and one pass serve all weightings and alphas.
    """
    rows = _written(frame.select(*key, "label", "fold"), "rows")
    counted = _written(word_counts(frame, [*key, "label", "fold"]), "words")
    model = fit_bayes(rows, counted, domain, k)
    tested = bayes_predictions(bayes_logits(rows, counted, model, key, alphas, weightings), domain)
    by = ["alpha", "weighted", "fold"]
    return macro_f1(tested, "label", "pred", domain, by=by).select(*by, "macro_f1")


def best_parameters(scores: DataFrame) -> DataFrame:
    """Mean macro-F1 of every combination, best first."""
    means = scores.groupBy("alpha", "weighted").agg(F.avg("macro_f1").alias("macro_f1"))
    return means.orderBy(F.desc("macro_f1"), "alpha", "weighted")


def posteriors(train: DataFrame, asked: DataFrame, domain: Sequence[str], key: Sequence[str], alpha: float = 1.0,
               weighted: bool = True) -> DataFrame:
    """Fit on ``train`` (text, label, key) and judge ``asked`` (text, key, further columns).

    If both are the same table, its words are counted and written once.
    """
    counted = word_counts(train, [*key, "label"])
    counted = _written(counted, "words") if asked is train else counted
    model = fit_bayes(train, counted, domain, None, weighted)
    rows = asked.withColumn("fold", F.lit(0))
    counted = counted.withColumn("fold", F.lit(0)) if asked is train else _written(word_counts(rows, [*key, "fold"]), "words")
    judged = bayes_logits(rows.drop("text"), counted, model, key, [alpha])
    return bayes_predictions(judged, domain).drop("fold", "alpha")
