"""Applying text classifiers on executors, and combining their output.

A scorer is a factory without arguments that returns a callable. The factory
runs once per Python worker, which serves many tasks, so a heavy model loads once.
Only the text column crosses to Python, in Arrow batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa import domains
from glossa.functions.labels import join_labels, lookup, sql_literal
from glossa.functions.scores import labels_above, override_neutral, top_prediction, zip_predictions
from glossa.plans.guard import once
from glossa.plans.skew import filter_join
from glossa.session import scratch_path

BATCH = 32
LITERAL_WORDS = 5_000  # words of a lexicon that is written into the plan
_NOT_LETTERS = r"[^\p{L}]+"
_RESULT = "labels array<string>, scores array<double>, error string"


# The scorer of a Python worker. It holds one at a time, so a worker's memory does not grow with jobs.
_LOADED: dict[str, Callable] = {}


def loaded(name: str, factory: Callable[[], Callable]) -> Callable:
    """The worker's scorer of that name, made on first use."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = factory()
    return _LOADED[name]


def _scorer_udf(factory: Callable[[], Callable], batch: int, unpack: Callable, call: Callable):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = loaded(name, factory)
        for texts in batches:
            rows = []
            for start in range(0, len(texts), batch):
                chunk = texts.iloc[start:start + batch]
                wanted = [t for t in chunk if t is not None]
                try:
                    scored = [unpack(r) for r in call(scorer, wanted)] if wanted else []
                    if len(scored) != len(wanted):
                        raise ValueError(f"{len(scored)} predictions for {len(wanted)} rows")
                    answers = iter([(*s, None) for s in scored])
                except Exception as problem:  # a failing batch must not end the job
                    message = f"{type(problem).__name__}: {problem}"
                    answers = iter([(None, None, message)] * len(wanted))
                rows.extend(next(answers) if t is not None else (None, None, None) for t in chunk)
            yield pd.DataFrame(rows, columns=["labels", "scores", "error"])

    # written out instead of inferred: the closure travels to the workers by value
    return F.pandas_udf(run, _RESULT).asNondeterministic()


def _with_predictions(df: DataFrame, text: Column, udf, out: str) -> DataFrame:
    scored = df.withColumn("_scored", udf(text))
    preds = zip_predictions(F.col("_scored.labels"), F.col("_scored.scores"))
    return scored.withColumn(out, preds).withColumn(f"{out}_error", F.col("_scored.error")).drop("_scored")


def score_texts(df: DataFrame, text: str | Column, factory: Callable[[], Callable], out: str = "preds",
                batch: int = BATCH) -> DataFrame:
    """Apply ``classifier(texts) -> [[{label, score}]]`` batch by batch.

    Adds ``out`` (array of label/score structs, null for null text) and
    ``<out>_error``. A failing batch, or one answering with the wrong number of
    rows (M07), leaves a message for each of its rows; the job goes on (M06).
    """
    text = F.col(text) if isinstance(text, str) else text

    def unpack(result):
        result = [result] if isinstance(result, Mapping) else list(result)
        return [p["label"] for p in result], [float(p["score"]) for p in result]

    return _with_predictions(df, text, _scorer_udf(factory, batch, unpack, lambda s, t: s(t)), out)


def score_candidates(df: DataFrame, text: str | Column, factory: Callable[[], Callable],
                     labels: Sequence[str], out: str = "preds", batch: int = BATCH,
                     multi_label: bool = True) -> DataFrame:
    """Apply ``classifier(texts, candidate_labels=, multi_label=) -> {labels, scores}``."""
    text = F.col(text) if isinstance(text, str) else text
    labels = list(labels)

    def call(scorer, texts):
        found = scorer(texts, candidate_labels=labels, multi_label=multi_label)
        return found if isinstance(found, list) else [found]

    def unpack(result):
        return list(result["labels"]), [float(s) for s in result["scores"]]

    return _with_predictions(df, text, _scorer_udf(factory, batch, unpack, call), out)


def emotion_label(preds: str = "preds") -> Column:
    """M02 + M06: top label, ``error`` for rows of a failed batch."""
    return F.when(F.col(f"{preds}_error").isNotNull(), F.lit(domains.ERROR_LABEL)).otherwise(
        top_prediction(F.col(preds))["label"])


def theme_labels(preds: str = "preds", threshold: float = 0.7) -> Column:
    """M03 + M06: packed labels at or above the threshold, ``error`` for failed batches."""
    return F.when(F.col(f"{preds}_error").isNotNull(), F.lit(domains.ERROR_LABEL)).otherwise(
        join_labels(labels_above(F.col(preds), threshold)))


def top_theme(preds: Column, lang: Column) -> Column:
    """The single best theme with its score, localised; struct (label, score)."""
    spanish = {en.capitalize(): es.capitalize() for en, es in domains.THEMES_ES.items()}
    top = top_prediction(preds)
    label = F.when(lang == "es", lookup(top["label"], spanish, top["label"])).otherwise(top["label"])
    return F.struct(label.alias("label"), top["score"].alias("score"))


def without_failed_units(df: DataFrame, unit: str, error: str) -> DataFrame:
    """Only units none of whose rows failed to be scored.

    Reads the rows twice, so ``df`` should be a written table.
    """
    return filter_join(df, df.where(F.col(error).isNotNull()), [unit], "left_anti")


def split_words(text: Column) -> Column:
    """Lower-case words of a text, with empty ones at its ends."""
    return F.split(F.lower(text), _NOT_LETTERS, -1)


def words(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.filter(split_words(text), lambda w: w != "")


def counted_words(df: DataFrame, keep: Sequence[str], found: Column) -> DataFrame:
    """``keep`` columns, word and n: how often each word of the array ``found`` occurs in a row; empty ones are left out.

    Every row is counted by itself, as runs of its sorted words, so nothing is shuffled and no task holds the words of other rows.
    """
    listed = df.select(*keep, once(F.sort_array(found)).alias("_words")).where("size(_words) > 0")
    begun = listed.withColumn("_from", once(F.expr("filter(sequence(1, size(_words)), i -> i = 1 OR _words[i - 1] != _words[i - 2])")))
    runs = "transform(_from, (a, j) -> struct(_words[a - 1] AS word, bigint(coalesce(get(_from, j + 1), size(_words) + 1) - a) AS n))"
    return begun.select(*keep, once(F.expr(runs)).alias("_runs")).select(*keep, F.inline("_runs")).where("word != ''")


def with_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the lower-case words of a text, split once for all lexicons that score them."""
    return df.withColumn(out, once(split_words(F.col(text))))


def lexicon_predictions(df: DataFrame, text: str, lexicon: Mapping[str, Mapping[str, float]],
                        out: str = "preds", split: str | None = None) -> DataFrame:
    """Share of lexicon weight per label, as predictions in lexicon order.

    ``split`` names a column that already holds the text's words (``with_words``).

    Works inside the row, so no text is shuffled or exploded; the lexicon is a
    small dictionary that travels with the plan. One of more than ``LITERAL_WORDS`` words becomes a
    table instead (``lexicon_table_predictions``), with the same result. Null when no word is known.
    """
    known = sorted({w for entries in lexicon.values() for w in entries})
    if len(known) > LITERAL_WORDS:
        entries = pd.DataFrame([(label, w, float(x)) for label, ws in lexicon.items() for w, x in ws.items()], columns=["label", "word", "weight"])
        table = df.sparkSession.createDataFrame(entries, "label string, word string, weight double")
        return lexicon_table_predictions(df, text, table, list(lexicon), out, split=split)

    def listed(some) -> str:
        return ", ".join(sql_literal(w) for w in some)

    def weight(entries: Mapping[str, float]) -> str:
        groups: dict[float, list[str]] = {}
        for word, value in entries.items():
            groups.setdefault(float(value), []).append(word)
        return " + ".join(f"{value!r}D * size(filter(hits, w -> w IN ({listed(ws)})))" for value, ws in groups.items())

    found = f"`{split}`" if split else f"split(lower(`{text}`), {sql_literal(_NOT_LETTERS)}, -1)"
    hits = f"filter({found}, w -> w IN ({listed(known)}))"
    weights = f"transform(array({hits}), hits -> array({', '.join(map(weight, lexicon.values()))}))[0]"
    shares = f"""transform(array({weights}), ws -> transform(array(aggregate(ws, 0D, (a, x) -> a + x)), total ->
        CASE WHEN total > 0 THEN zip_with(array({listed(lexicon)}), ws,
            (l, x) -> named_struct('label', l, 'score', x / total)) END)[0])[0]"""
    return df.withColumn(out, once(F.expr(shares)))


def lexicon_table_predictions(df: DataFrame, text: str, lexicon: DataFrame, labels: Sequence[str], out: str = "preds",
                              key: Sequence[str] | None = None, split: str | None = None) -> DataFrame:
    """M17 for a lexicon of any size: a table of (label, word, weight), several rows of a word and label added up.

    Each row's words are counted where it is read, meet the weights of the words that are in the lexicon by an equi-join, and come
    together as one partial sum per row and label, in the order of ``labels``. Only ``key`` and words are shuffled; the
    sums meet the rows by ``key``, which identifies them and is never null. Without a key the rows are written first and
    told apart by their place. Adaptive execution splits the partitions of very frequent words.
    """
    spark = df.sparkSession
    df = df.drop(out) if out != text else df
    if key is None:
        path, key = scratch_path(spark, "scored"), ["_row"]
        df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
        df = spark.read.parquet(path)
    weights = F.array(*[F.coalesce(F.sum(F.when(F.col("label") == x, F.col("weight"))), F.lit(0.0)) for x in labels])
    known = lexicon.where(F.col("label").isin(*labels)).groupBy("word").agg(weights.alias("_w"))
    found = F.col(split) if split else split_words(F.col(text))
    parts = counted_words(df, key, found).join(known, "word").groupBy(*key).agg(
        F.array(*[F.sum(F.col("n") * F.get(F.col("_w"), F.lit(i))) for i in range(len(labels))]).alias("_sums"))
    total = F.aggregate("_sums", F.lit(0.0), lambda a, x: a + x)
    shares = parts.select(*key, total.alias("_total"), "_sums").where("_total > 0").select(
        *key, zip_predictions(F.array(*[F.lit(x) for x in labels]), F.transform("_sums", lambda x: x / F.col("_total"))).alias(out))
    return df.join(shares, list(key), "left").select(*[c for c in df.columns if c != "_row"], out)


def compare_models(df: DataFrame, models: Mapping[str, bool], mapping: Mapping[str, str] | None = None,
                   threshold: float = 0.35) -> DataFrame:
    """Per model ``<m>_label``, ``<m>_mapped``, ``<m>_score`` from its predictions column ``<m>``.

    ``models`` tells whether a model knows a neutral label (M04 applies then).
    """
    mapping = dict(domains.FINE_TO_COARSE if mapping is None else mapping)
    out = df
    for model, has_neutral in models.items():
        best = override_neutral(F.col(model), mapping, threshold, has_neutral)
        out = (out.withColumn("_best", best)
               .withColumn(f"{model}_label", F.col("_best.label"))
               .withColumn(f"{model}_mapped", F.col("_best.mapped"))
               .withColumn(f"{model}_score", F.col("_best.score")).drop("_best", model))
    return out
