"""Scoring, training and labelling-job queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog.aggregates import LABELED_SQL, rounded
from glossa.catalog.filters import MODELS, MODELS_SQL
from glossa.catalog.registry import Tables, query
from glossa.catalog.roles import LANGS, LEXICON, lexicon_cte, predicted, top_sql
from glossa.domains import FINE_TO_COARSE
from glossa.functions.labels import join_labels
from glossa.functions.scores import labels_above, top_prediction, zip_predictions
from glossa.operators import evaluate as E
from glossa.operators import recommend
from glossa.operators import scoring as M
from glossa.operators.sampling import stratified_folds
from glossa.plans import bayes, labeling, training
from glossa.session import scratch_path


def vowel_scorer(fail_on: str | None = None, short_by: int = 0, short_on: str = ""):
    """Factory of a checkable emotion scorer: vowel counts per character.

    It can fail on texts that contain a mark, or answer with too few rows, if a text holds ``short_on``.
    """
    def factory():
        def classify(texts):
            if fail_on and any(fail_on in t for t in texts):
                raise RuntimeError("cannot score")
            found = [[{"label": label, "score": t.count(vowel) / max(len(t), 1)}
                      for label, vowel in (("joy", "e"), ("fear", "i"), ("anger", "o"))] for t in texts]
            return found[:len(found) - short_by] if any(short_on in t for t in texts) else found

        return classify

    return factory


def theme_scorer():
    """Factory of a checkable theme scorer: every label scored by its own letter."""
    def factory():
        def classify(texts, candidate_labels, multi_label):
            def one(text):
                size = max(len(text), 1)
                return {"labels": list(candidate_labels),
                        "scores": [min(1.0, 10 * text.count(label[0]) / size) for label in candidate_labels]}
            return [one(t) for t in texts]

        return classify

    return factory


def _count(letter: str) -> str:
    return f"(length(text) - length(replace(text, '{letter}', '')))"


_E, _I, _O = _count("e"), _count("i"), _count("o")
_BEST = f"greatest({_E}, {_I}, {_O})"
_EMOTION = f"CASE WHEN {_E} = {_BEST} THEN 'joy' WHEN {_I} = {_BEST} THEN 'fear' ELSE 'anger' END"


@query("m01_batched_scorer", f"""SELECT doc_id, {_EMOTION} AS label, round({_BEST} / greatest(length(text), 1), 6) AS score FROM documents""")
def m01(spark, sf_dir):
    scored = M.score_texts(Tables(spark, sf_dir).spread("documents"), "text", vowel_scorer())
    best = top_prediction(F.col("preds"))
    return scored.select("doc_id", best["label"].alias("label"), F.round(best["score"], 6).alias("score"))


_LABEL, _SCORE = top_sql(LEXICON)


@query("m02_top_label", f"""WITH {lexicon_cte('hits', LEXICON)}
SELECT doc_id, CASE WHEN w0 IS NOT NULL THEN {_LABEL} END AS label FROM documents LEFT JOIN hits USING (doc_id)""")
def m02(spark, sf_dir):
    return predicted(Tables(spark, sf_dir)).select("doc_id", top_prediction(F.col("preds"))["label"].alias("label"))


_ABOVE = ", ".join(f"CASE WHEN w{i} / (w0 + w1 + w2 + w3) >= 0.25 THEN '{x}' END" for i, x in enumerate(LANGS))


@query("m03_multi_label", f"WITH {lexicon_cte('hits', LEXICON)} SELECT doc_id, CASE WHEN w0 IS NOT NULL THEN concat_ws(';', {_ABOVE}) END AS labels FROM documents LEFT JOIN hits USING (doc_id)")
def m03(spark, sf_dir):
    labels = F.when(F.col("preds").isNotNull(), join_labels(labels_above(F.col("preds"), 0.25)))
    return predicted(Tables(spark, sf_dir)).select("doc_id", labels.alias("labels"))


# Four fine-grained labels scored from the text; the first maps to neutral.
_FINE = ("neutral", "grief", "pride", "zeal")
_LETTERS = ("e", "i", "o", "t")
_TOTAL = " + ".join(_count(x) for x in _LETTERS)


@query("m04_neutral_override", f"""WITH c AS (SELECT doc_id, {_count('e')} AS n, {_count('i')} AS g, {_count('o')} AS p, {_count('t')} AS z,
  {_TOTAL} AS s FROM documents),
t AS (SELECT *, greatest(n, g, p, z) AS best FROM c),
l AS (SELECT *, CASE WHEN n = best THEN 'neutral' WHEN g = best THEN 'grief' WHEN p = best THEN 'pride' ELSE 'zeal' END AS top FROM t),
o AS (SELECT *, top IN ('neutral', 'zeal') AND s > 0 AND best / nullif(s, 0) < 0.45 AS weak, CASE WHEN g >= p THEN 'grief' ELSE 'pride' END AS other FROM l)
SELECT doc_id, CASE WHEN s = 0 THEN NULL WHEN weak THEN other ELSE top END AS label,
  CASE WHEN s = 0 THEN NULL WHEN weak THEN CASE other WHEN 'grief' THEN 'sadness' ELSE 'joy' END
    ELSE CASE top WHEN 'grief' THEN 'sadness' WHEN 'pride' THEN 'joy' ELSE 'neutral' END END AS mapped,
  CASE WHEN s > 0 THEN round(CASE WHEN weak THEN greatest(g, p) ELSE best END / s, 6) END AS score FROM o""")
def m04(spark, sf_dir):
    counts = F.array(*[F.regexp_count("text", F.lit(x)) for x in _LETTERS])
    docs = Tables(spark, sf_dir).spread("documents").select("doc_id", counts.alias("c"))
    total = F.aggregate("c", F.lit(0), lambda a, x: a + x)
    preds = zip_predictions(F.array(*[F.lit(x) for x in _FINE]), F.transform("c", lambda x: x / F.col("total")))
    docs = docs.withColumn("total", F.nullif(total, F.lit(0))).withColumn("best", F.when(F.col("total").isNotNull(), preds))
    found = M.compare_models(docs, {"best": True}, FINE_TO_COARSE, 0.45)
    return found.select("doc_id", F.col("best_label").alias("label"), F.col("best_mapped").alias("mapped"),
                        F.round("best_score", 6).alias("score"))


_THEME_LETTERS = {"Love": "L", "Faith": "F", "Hope": "H", "Fear": "F"}
_COUNTS = {label: _count(letter) for label, letter in _THEME_LETTERS.items()}
_TOP_THEME = f"greatest({', '.join(_COUNTS.values())})"


@query("m05_top_theme", f"""SELECT doc_id, CASE WHEN {_COUNTS['Love']} = {_TOP_THEME} THEN CASE WHEN lang = 'es' THEN 'Amor' ELSE 'Love' END
  WHEN {_COUNTS['Faith']} = {_TOP_THEME} THEN CASE WHEN lang = 'es' THEN 'Fe' ELSE 'Faith' END
  ELSE CASE WHEN lang = 'es' THEN 'Esperanza' ELSE 'Hope' END END AS theme,
  round(least(1.0, 10 * {_TOP_THEME} / greatest(length(text), 1)), 6) AS score FROM documents""")
def m05(spark, sf_dir):
    docs = Tables(spark, sf_dir).spread("documents")
    scored = M.score_candidates(docs, "text", theme_scorer(), list(_THEME_LETTERS), multi_label=False)
    top = M.top_theme(F.col("preds"), F.col("lang"))
    return scored.withColumn("_t", top).select("doc_id", F.col("_t.label").alias("theme"), F.round("_t.score", 6).alias("score"))


@query("m05_analyze_requests", f"""WITH r AS (SELECT conv_id, turn, role, text, CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'es' END AS lang FROM conversations)
SELECT conv_id, turn, {_EMOTION} AS emotion, round({_BEST} / greatest(length(text), 1), 6) AS emotion_score,
  CASE WHEN {_COUNTS['Love']} = {_TOP_THEME} THEN CASE WHEN lang = 'es' THEN 'Amor' ELSE 'Love' END
  WHEN {_COUNTS['Faith']} = {_TOP_THEME} THEN CASE WHEN lang = 'es' THEN 'Fe' ELSE 'Faith' END
  ELSE CASE WHEN lang = 'es' THEN 'Esperanza' ELSE 'Hope' END END AS theme FROM r WHERE length(trim(text)) >= 3""")
def m05_requests(spark, sf_dir):
    asks = Tables(spark, sf_dir).spread("conversations").withColumn(
        "lang", F.when(F.col("conv_id") % 2 == 0, "en").otherwise("es"))
    found = recommend.analyze_requests(asks, vowel_scorer(), theme_scorer(), list(_THEME_LETTERS))
    return found.select("conv_id", "turn", "emotion", F.round("emotion_score", 6).alias("emotion_score"), "theme")


@query("m06_failure_isolation", f"""SELECT doc_id, CASE WHEN contains(text, ' que ') THEN 'error' ELSE {_EMOTION} END AS emotion FROM documents""")
def m06(spark, sf_dir):
    scored = M.score_texts(Tables(spark, sf_dir).spread("documents"), "text", vowel_scorer(fail_on=" que "), batch=1)
    return scored.select("doc_id", M.emotion_label().alias("emotion"))


@query("m07_failed_units", "SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE contains(text, 'Que '))")
def m07(spark, sf_dir):
    scored = M.score_texts(Tables(spark, sf_dir).spread("documents"), "text", vowel_scorer(fail_on="Que "), batch=1)
    # the scored rows are needed twice, to find failed units and to drop them: write them once
    path = scratch_path(spark, "scored")
    scored.select("doc_id", "source", "preds_error").write.parquet(path)
    scored = spark.read.parquet(path)
    return M.without_failed_units(scored, "source", "preds_error").select("doc_id")


@query("m07_short_answers", "SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE contains(text, 'Les '))")
def m07_short(spark, sf_dir):
    scorer = vowel_scorer(short_by=1, short_on="Les ")
    scored = M.score_texts(Tables(spark, sf_dir).spread("documents"), "text", scorer, batch=1)
    path = scratch_path(spark, "scored")
    scored.select("doc_id", "source", "preds_error").write.parquet(path)
    return M.without_failed_units(spark.read.parquet(path), "source", "preds_error").select("doc_id")


_THEME_OF = ", ".join(f"CASE WHEN 10 * {_count(x)} / greatest(length(text), 1) >= 0.5 THEN '{label}' END"
                      for label, x in (("love", "l"), ("faith", "f"), ("hope", "h"), ("forgiveness", "f"), ("fear", "f")))


@query("m08_two_stage_labeling", f"""SELECT doc_id, {_EMOTION} AS emotion, concat_ws(';', {_THEME_OF}) AS theme
FROM documents WHERE source <> 'src3'""")
def m08(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text", "source", "lang")
    done = docs.where("source = 'src3'")
    out = labeling.run_labeling(docs, vowel_scorer(), theme_scorer(), unit=["source"], done=done, threshold=0.5)
    return out.select("doc_id", "emotion", "theme")


_WIDE = ", ".join(f"{m} AS {m}_label, round({m}_score, 6) AS {m}_score" for m in MODELS)


@query("m09_compare_models", f"WITH {MODELS_SQL} SELECT doc_id, {_WIDE} FROM models")
def m09(spark, sf_dir):
    df = M.with_words(Tables(spark, sf_dir).spread("documents").select("doc_id", "text"), "text", "split")
    for name, lexicon in MODELS.items():
        df = M.lexicon_predictions(df, "text", lexicon, name, split="split")
    wide = M.compare_models(df, {m: False for m in MODELS}, {x: x for x in LANGS})
    return wide.select("doc_id", *[c for m in MODELS for c in (f"{m}_label", F.round(f"{m}_score", 6).alias(f"{m}_score"))])


@query("m10_evaluate_examples", f"""WITH {LABELED_SQL} SELECT doc_id, lang, pred, round(score, 6) AS score, coalesce(lang = pred, false) AS lang_match FROM labeled""")
def m10(spark, sf_dir):
    from glossa.catalog.roles import labeled
    out = E.evaluate_examples(labeled(Tables(spark, sf_dir)), ["lang"], ["pred"], ["lang"])
    return rounded(out.select("doc_id", "lang", "pred", "score", "lang_match"), "score")


def _frame(spark, sf_dir):
    docs = Tables(spark, sf_dir).spread("documents").select("doc_id", "text", "lang")
    return training.training_frame(docs, "text", "lang", LANGS, keep=["doc_id"])


_TRAINING = {"features": 1 << 12, "iterations": 5}


@query("m14_cross_validation")
def m14(spark, sf_dir):
    folds = stratified_folds(_frame(spark, sf_dir), "label", ["doc_id"], 3, 42)
    return training.cross_validate(folds, LANGS, k=3, **_TRAINING)


@query("m15_parameter_search")
def m15(spark, sf_dir):
    folds = stratified_folds(_frame(spark, sf_dir), "label", ["doc_id"], 2, 42)
    return training.search(folds, LANGS, {"regularization": [0.01, 1.0], "features": [1 << 12], "iterations": [5]}, k=2)


@query("m16_batch_inference")
def m16(spark, sf_dir):
    frame = _frame(spark, sf_dir)
    model = training.fit(frame, **_TRAINING)
    found = training.predict(model, frame.select("doc_id", "text", "label"), LANGS)
    return found.select("doc_id", "label", "pred", F.round("pred_score", 6).alias("pred_score"))


_BAYES_DOCS = f"""d AS MATERIALIZED (SELECT doc_id, lang AS label, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}]+') AS w,
  @fold AS fold FROM documents WHERE lang IN ({', '.join(f"'{x}'" for x in LANGS)})),
t AS MATERIALIZED (SELECT doc_id, label, fold, word, count(*) AS n FROM (SELECT doc_id, label, fold, unnest(w) AS word FROM d)
  WHERE word <> '' GROUP BY ALL),
labels(id, label) AS (VALUES {', '.join(f"({i}, '{x}')" for i, x in enumerate(LANGS))}),
own AS (SELECT fold, label, word, sum(n) AS c FROM t GROUP BY ALL), tot AS (SELECT label, word, sum(n) AS c FROM t GROUP BY ALL)"""


def _bayes_sql(folds: int, alphas: list[float], weights: list[bool]) -> str:
    """DuckDB: (doc_id, label, fold, alpha, weighted, pred, score) of the closed-form learner; fold -1 leaves nothing out."""
    grid = ", ".join(f"({a}::DOUBLE, {w})" for a in alphas for w in weights)
    fold = f"((row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) - 1) % {folds})::INT" if folds else "0"
    left_out = "0" if folds else "1"  # without folds nothing is taken off
    return f"""{_BAYES_DOCS.replace('@fold', fold)},
f AS (SELECT DISTINCT fold FROM d), vocabulary AS (SELECT DISTINCT word FROM t),
train AS MATERIALIZED (SELECT f.fold, l.label, v.word, coalesce(tot.c, 0) - CASE WHEN {left_out} = 1 THEN 0 ELSE coalesce(own.c, 0) END AS c
  FROM f, labels l, vocabulary v LEFT JOIN tot ON tot.label = l.label AND tot.word = v.word
  LEFT JOIN own ON own.fold = f.fold AND own.label = l.label AND own.word = v.word),
known AS (SELECT fold, word FROM train GROUP BY ALL HAVING sum(c) > 0), size AS (SELECT fold, count(*) AS v FROM known GROUP BY ALL),
mass AS (SELECT fold, label, sum(c) AS t FROM train GROUP BY ALL),
grid(alpha, weighted) AS (VALUES {grid}),
cls AS (SELECT f.fold, l.label, l.id, g.alpha, g.weighted, CASE WHEN weighted THEN 1.0::DOUBLE / greatest(count(d.doc_id), 1) ELSE 1.0::DOUBLE END AS w,
  count(d.doc_id) FILTER (d.fold <> f.fold OR {left_out} = 1) AS docs
  FROM f, grid g, labels l LEFT JOIN d ON d.label = l.label GROUP BY f.fold, l.label, l.id, alpha, weighted),
prior AS (SELECT *, ln(w * docs) - ln(sum(w * docs) OVER (PARTITION BY fold, alpha, weighted)) AS p FROM cls),
likely AS (SELECT t.doc_id, p.label, p.alpha, p.weighted, sum(t.n * ln((p.w * train.c + p.alpha) / (p.w * mass.t + p.alpha * size.v))) AS s
  FROM t JOIN known ON known.fold = t.fold AND known.word = t.word JOIN train ON train.fold = t.fold AND train.word = t.word
  JOIN prior p ON p.fold = t.fold AND p.label = train.label JOIN mass ON mass.fold = t.fold AND mass.label = train.label
  JOIN size ON size.fold = t.fold GROUP BY ALL),
logit AS (SELECT d.doc_id, d.label, d.fold, p.alpha, p.weighted, p.id, p.label AS guess, p.p + coalesce(s, 0) AS z
  FROM d JOIN prior p ON p.fold = d.fold LEFT JOIN likely l ON l.doc_id = d.doc_id AND l.label = p.label AND l.alpha = p.alpha AND l.weighted = p.weighted),
top AS (SELECT *, max(z) OVER (PARTITION BY doc_id, alpha, weighted) AS peak FROM logit),
judged AS MATERIALIZED (SELECT doc_id, label, fold, alpha, weighted, arg_min(guess, id) FILTER (z = peak) AS pred, 1 / sum(exp(z - peak)) AS score
  FROM top GROUP BY ALL),
folds AS (SELECT alpha, weighted, fold, l.label, 2.0::DOUBLE * count(*) FILTER (j.label = l.label AND pred = l.label)
    / greatest(count(*) FILTER (j.label = l.label) + count(*) FILTER (pred = l.label), 1) AS f1
  FROM judged j, labels l GROUP BY ALL),
macro AS (SELECT alpha, weighted, fold, sum(f1) / {len(LANGS)} AS macro_f1 FROM folds GROUP BY ALL)"""


def _folded(spark, sf_dir, k: int):
    docs = Tables(spark, sf_dir).spread("documents").select("doc_id", "text", "lang")
    return stratified_folds(training.training_frame(docs, "text", "lang", LANGS, weighted=False, keep=["doc_id"]), "label", ["doc_id"], k, 42)


@query("m14_bayes_folds", f"WITH {_bayes_sql(3, [1.0], [True])} SELECT fold, round(macro_f1, 6) AS macro_f1 FROM macro")
def m14_bayes(spark, sf_dir):
    return bayes.bayes_search(_folded(spark, sf_dir, 3), LANGS, ["doc_id"], 3).select("fold", F.round("macro_f1", 6).alias("macro_f1"))


@query("m15_bayes_search", f"""WITH {_bayes_sql(2, [0.01, 1.0, 300.0], [True, False])}
SELECT alpha, weighted, round(avg(macro_f1), 6) AS macro_f1 FROM macro GROUP BY ALL""")
def m15_bayes(spark, sf_dir):
    found = bayes.bayes_search(_folded(spark, sf_dir, 2), LANGS, ["doc_id"], 2, [0.01, 1.0, 300.0], [True, False])
    return bayes.best_parameters(found).select("alpha", "weighted", F.round("macro_f1", 6).alias("macro_f1"))


@query("m16_bayes_posteriors", f"WITH {_bayes_sql(0, [0.5], [True])} SELECT doc_id, label, pred, round(score, 6) AS score FROM judged")
def m16_bayes(spark, sf_dir):
    docs = Tables(spark, sf_dir).spread("documents").select("doc_id", "text", "lang")
    frame = training.training_frame(docs, "text", "lang", LANGS, weighted=False, keep=["doc_id"]).select("doc_id", "text", "label")
    return bayes.posteriors(frame, frame, LANGS, ["doc_id"], 0.5).select("doc_id", "label", "pred", F.round("pred_score", 6).alias("score"))


_SHARES = ", ".join(f"round(w{i} / (w0 + w1 + w2 + w3), 6) AS {x}" for i, x in enumerate(LANGS))


@query("m17_lexicon_scores", f"WITH {lexicon_cte('hits', LEXICON)} SELECT doc_id, {_SHARES} FROM documents LEFT JOIN hits USING (doc_id)")
def m17(spark, sf_dir):
    return predicted(Tables(spark, sf_dir)).select("doc_id", *[F.round(F.get("preds", F.lit(i))["score"], 6).alias(x) for i, x in enumerate(LANGS)])


_TABLE_SHARES = ", ".join(f"round(sum(n * weight) FILTER (label = '{x}') / sum(n * weight), 6) AS {x}" for x in LANGS)


@query("m17_table_lexicon", f"""WITH w AS (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM documents),
n AS (SELECT doc_id, lang, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
lexicon AS (SELECT lang AS label, word, 1 + count(*) % 4 AS weight FROM n GROUP BY lang, word),
s AS (SELECT doc_id, {_TABLE_SHARES} FROM n JOIN lexicon USING (word) GROUP BY doc_id)
SELECT doc_id, {', '.join(f"CASE WHEN s.doc_id IS NOT NULL THEN coalesce({x}, 0) END AS {x}" for x in LANGS)} FROM documents LEFT JOIN s USING (doc_id)""")
def m17_table(spark, sf_dir):
    """Every word of the corpus is in the lexicon, weighted by the documents of a language that hold it."""
    docs = Tables(spark, sf_dir).spread("documents").select("doc_id", "lang", "text")
    held = docs.select(F.col("lang").alias("label"), F.explode(F.array_distinct(M.words(F.col("text")))).alias("word"))
    lexicon = held.groupBy("label", "word").agg((1.0 + F.count(F.lit(1)) % 4).alias("weight"))
    found = M.lexicon_table_predictions(docs, "text", lexicon, LANGS, key=["doc_id"])
    return found.select("doc_id", *[F.round(F.get("preds", F.lit(i))["score"], 6).alias(x) for i, x in enumerate(LANGS)])
