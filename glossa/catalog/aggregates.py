"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog.filters import MODELS, MODELS_SQL, four_models
from glossa.catalog.registry import Tables, query
from glossa.catalog.roles import CORPUS_SQL, LABELED_SQL, LANGS, corpus, labeled
from glossa.domains import EMOTIONS, EMOTIONS_ES, THEMES_ES
from glossa.functions.labels import split_labels, theme_set
from glossa.operators import aggregates as A
from glossa.operators import evaluate as E

_NAMES = list(MODELS)


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("a01_label_counts", f"WITH {CORPUS_SQL} SELECT emotion, count(*) AS n FROM corpus WHERE emotion IS NOT NULL GROUP BY ALL")
def a01(spark, sf_dir):
    return A.label_counts(corpus(Tables(spark, sf_dir)), "emotion")


_SHARES = ", ".join(
    f"round(coalesce(count(*) FILTER (WHERE model = '{m}') / max(total) FILTER (WHERE model = '{m}'), 0), 6) AS {m}"
    for m in _NAMES)


@query("a02_label_shares", f"""WITH {MODELS_SQL}, long AS (
  {' UNION ALL '.join(f"SELECT '{m}' AS model, {m} AS label FROM models WHERE {m} IS NOT NULL" for m in _NAMES)}),
counted AS (SELECT *, count(*) OVER (PARTITION BY model) AS total FROM long)
SELECT label, {_SHARES} FROM counted GROUP BY label""")
def a02(spark, sf_dir):
    return rounded(A.label_shares(four_models(Tables(spark, sf_dir)), _NAMES), *_NAMES)


@query("a03_multi_label_counts", f"""WITH {CORPUS_SQL} SELECT label, count(*) AS n
FROM (SELECT unnest(string_split(theme, ';')) AS label FROM corpus) WHERE label <> '' GROUP BY ALL""")
def a03(spark, sf_dir):
    return A.multi_label_counts(corpus(Tables(spark, sf_dir)), "theme")


@query("a04_rows_per_group", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def a04(spark, sf_dir):
    return A.rows_per_group(Tables(spark, sf_dir).documents, "source", "lang")


@query("a05_mean_length", "SELECT source, round(avg(length(text)), 6) AS mean_length FROM documents GROUP BY ALL")
def a05(spark, sf_dir):
    return rounded(A.mean_length(Tables(spark, sf_dir).documents, "text", "source"), "mean_length")


@query("a06_first_values", f"""WITH {CORPUS_SQL} SELECT book, arg_min(theme, doc_id) FILTER (WHERE theme IS NOT NULL) AS theme,
  arg_min(text, doc_id) AS text, min(doc_id) AS doc_id FROM corpus GROUP BY book""")
def a06(spark, sf_dir):
    return A.first_values(corpus(Tables(spark, sf_dir)), ["book"], ["theme", "text", "doc_id"], ["doc_id"])


_PROFILE = ["doc_id", "text", "book", "emotion", "theme"]


@query("a07_null_counts", f"""WITH {CORPUS_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM corpus" for c in _PROFILE)}""")
def a07(spark, sf_dir):
    return A.null_counts(corpus(Tables(spark, sf_dir)).select(*_PROFILE))


def _describe_sql(columns: list[tuple[str, bool]], table: str) -> str:
    parts = []
    for c, numeric in columns:
        if numeric:
            quart = ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {n}" for q, n in ((.25, "q25"), (.5, "q50"), (.75, "q75")))
            parts.append(f"""SELECT '{c}' AS column, count({c}) AS count, NULL::BIGINT AS unique, NULL::VARCHAR AS top,
  NULL::BIGINT AS freq, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, {quart},
  max({c})::DOUBLE AS max FROM {table}""")
        else:
            parts.append(f"""SELECT '{c}', sum(n)::BIGINT, count(*), arg_min(v, (-n, v)), max(n),
  NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM (SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})""")
    return "\nUNION ALL\n".join(parts)


_DESCRIBED = [("value", True), ("event_id", True), ("event_type", False), ("props", False)]


@query("a08_describe", _describe_sql(_DESCRIBED, "events"))
def a08(spark, sf_dir):
    out = A.describe(Tables(spark, sf_dir).events, [c for c, _ in _DESCRIBED])
    return rounded(out, "mean", "std", "q25", "q50", "q75")


@query("a09_column_profile", """SELECT 'doc_id' AS column, count(doc_id) AS non_null, 'bigint' AS type FROM documents
UNION ALL SELECT 'text', count(text), 'string' FROM documents UNION ALL SELECT 'lang', count(lang), 'string' FROM documents
UNION ALL SELECT 'source', count(source), 'string' FROM documents UNION ALL SELECT 'n_chars', count(n_chars), 'bigint' FROM documents""")
def a09(spark, sf_dir):
    return A.column_profile(Tables(spark, sf_dir).documents)


@query("a10_crosstab", f"WITH {LABELED_SQL} SELECT lang, pred, count(*) AS n FROM labeled WHERE pred IS NOT NULL GROUP BY ALL")
def a10(spark, sf_dir):
    return A.crosstab(labeled(Tables(spark, sf_dir)), "lang", "pred")


@query("a10_crosstab_wide", f"""WITH {LABELED_SQL}
SELECT lang, {', '.join(f"count(*) FILTER (WHERE pred = '{x}') AS {x}" for x in LANGS)} FROM labeled GROUP BY lang""")
def a10_wide(spark, sf_dir):
    return A.crosstab_wide(labeled(Tables(spark, sf_dir)), "lang", "pred", LANGS)


PER_CLASS_SQL = """truth AS (SELECT lang AS label, count(*) AS support FROM labeled GROUP BY 1),
preds AS (SELECT pred AS label, count(*) AS predicted FROM labeled WHERE pred IS NOT NULL GROUP BY 1),
hit AS (SELECT lang AS label, count(*) AS tp FROM labeled WHERE lang = pred GROUP BY 1),
classes AS (SELECT label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp
  FROM truth FULL JOIN preds USING (label) LEFT JOIN hit USING (label)),
report AS (SELECT label, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
  CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1, support, tp FROM classes)"""


@query("a11_classification_report", f"""WITH {LABELED_SQL}, {PER_CLASS_SQL}, long AS (
SELECT label, precision, recall, f1, support FROM report
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM report
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM report
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM report)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM long""")
def a11(spark, sf_dir):
    return rounded(E.classification_report(labeled(Tables(spark, sf_dir)), "lang", "pred"), "precision", "recall", "f1")


_RATES = " UNION ALL ".join(
    f"SELECT '{a}' AS model_a, '{b}' AS model_b, round(avg(CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM models"
    for i, a in enumerate(_NAMES) for b in _NAMES[i + 1:])


@query("a12_agreement_rates", f"WITH {MODELS_SQL} {_RATES}")
def a12(spark, sf_dir):
    return rounded(E.agreement_rates(four_models(Tables(spark, sf_dir)), _NAMES), "agreement")


_SET = "coalesce(list_sort(list_distinct(string_split({0}, ';'))), [])"


@query("a13_set_agreement", f"""WITH {CORPUS_SQL}, pairs AS (
  SELECT {_SET.format('c.theme_en')} AS a, coalesce(list_sort(list_distinct(list_transform(string_split(o.theme_en, ';'), lambda x: x))), []) AS b
  FROM corpus0 c JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'hope' ELSE theme_en END AS theme_en FROM corpus0) o USING (doc_id))
SELECT count(*) AS rows, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS exact_match,
  round(avg(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1)), 6) AS mean_jaccard FROM pairs""")
def a13(spark, sf_dir):
    from glossa.catalog.roles import themes_of
    docs = Tables(spark, sf_dir).documents
    english = themes_of(F.col("n_chars"))
    from glossa.functions.labels import translate_themes
    spanish = F.when(english.isNotNull(), translate_themes(english))
    other = F.when(F.col("doc_id") % 10 == 0, "Esperanza").otherwise(spanish)
    sets = docs.select(theme_set(english).alias("a"), theme_set(other, THEMES_ES).alias("b"))
    return rounded(E.set_agreement(sets, "a", "b"), "exact_match", "mean_jaccard")


@query("a14_error_examples", f"""WITH {LABELED_SQL}, wrong AS (
  SELECT doc_id, lang, pred, pred AS label, 'false_positive' AS error_type FROM labeled WHERE lang <> pred
  UNION ALL SELECT doc_id, lang, pred, lang, 'false_negative' FROM labeled WHERE lang <> pred)
SELECT doc_id, lang, pred, label, error_type FROM wrong
QUALIFY row_number() OVER (PARTITION BY label, error_type ORDER BY doc_id) <= 10""")
def a14(spark, sf_dir):
    wrong = E.error_examples(labeled(Tables(spark, sf_dir)), "lang", "pred", ["doc_id"])
    return wrong.select("doc_id", "lang", "pred", "label", "error_type")


_BOTH = [*EMOTIONS, *EMOTIONS_ES.values(), "awe"]


@query("a15_class_weights", f"""WITH {CORPUS_SQL}, counts AS (SELECT emotion, count(*) AS n FROM corpus GROUP BY 1)
SELECT (i - 1)::INT AS label_id, d AS label, coalesce(n, 0) AS n, round(1 / greatest(coalesce(n, 0), 1), 6) AS weight
FROM (SELECT unnest({_BOTH}) AS d, unnest(range(1, {len(_BOTH) + 1})) AS i) LEFT JOIN counts ON d = emotion""")
def a15(spark, sf_dir):
    return rounded(E.class_weights(corpus(Tables(spark, sf_dir)), "emotion", _BOTH), "weight")


_BY_SOURCE = """f AS (SELECT source, label, sum(tp) AS tp, sum(predicted) AS predicted, sum(support) AS support FROM (
  SELECT source, lang AS label, CASE WHEN lang = pred THEN 1 ELSE 0 END AS tp, 0 AS predicted, 1 AS support FROM labeled
  UNION ALL SELECT source, pred, 0, 1, 0 FROM labeled WHERE pred IS NOT NULL) GROUP BY 1, 2),
macro AS (SELECT source, sum(2 * tp / (predicted + support)) / 4 AS macro_f1 FROM f GROUP BY source)"""


@query("a16_fold_summary", f"WITH {LABELED_SQL}, {_BY_SOURCE} SELECT round(avg(macro_f1), 6) AS mean, round(stddev_pop(macro_f1), 6) AS std FROM macro")
def a16(spark, sf_dir):
    per_source = E.macro_f1(labeled(Tables(spark, sf_dir)), "lang", "pred", LANGS, by=["source"])
    return rounded(E.fold_summary(per_source, "macro_f1"), "mean", "std")


_SCORES = [f"{m}_score" for m in _NAMES]


@query("a17_score_histogram", f"""WITH {MODELS_SQL}, long AS (
  {' UNION ALL '.join(f"SELECT '{s}' AS model, round({s}, 9) AS score FROM models WHERE {s} IS NOT NULL" for s in _SCORES)}),
span AS (SELECT model, min(score) AS low, max(score) AS high FROM long GROUP BY model)
SELECT model, least(floor((score - low) / ((high - low) / 20)) + 1, 20)::BIGINT AS bin, count(*) AS n,
  round(min(low), 6) AS low, round(max(high), 6) AS high FROM long JOIN span USING (model) GROUP BY 1, 2""")
def a17(spark, sf_dir):
    df = four_models(Tables(spark, sf_dir))
    for s in _SCORES:
        df = df.withColumn(s, F.round(s, 9))
    return rounded(A.score_histogram(df, _SCORES), "low", "high")


@query("a18_distinct_values", f"WITH {CORPUS_SQL} SELECT DISTINCT lang, emotion FROM corpus")
def a18(spark, sf_dir):
    return A.distinct_values(corpus(Tables(spark, sf_dir)), "lang", "emotion")


@query("a19_duplicate_keys", """SELECT source, n_chars % 50 AS verse, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1""")
def a19(spark, sf_dir):
    return A.duplicate_keys(Tables(spark, sf_dir).documents.withColumn("verse", F.col("n_chars") % 50), "source", "verse")


@query("a20_dedupe_first", "SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def a20(spark, sf_dir):
    from glossa.operators.transfer import first_wins
    docs = Tables(spark, sf_dir).documents.select(F.md5("text").alias("text_md5"), "doc_id")
    return first_wins(docs, ["text_md5"], ["doc_id"])


@query("a21_audit_counts", f"""WITH {CORPUS_SQL} SELECT source, count(*) AS rows,
  count(*) FILTER (WHERE theme IS NULL) AS unlabeled, count(*) FILTER (WHERE length(text) < 500) AS short
FROM corpus GROUP BY source""")
def a21(spark, sf_dir):
    return A.audit_counts(corpus(Tables(spark, sf_dir)), ["source"], unlabeled=F.col("theme").isNull(),
                          short=F.length("text") < 500)


@query("a21_unknown_values", "SELECT DISTINCT source FROM documents WHERE source NOT IN ('src1', 'src3', 'src7')")
def a21_unknown(spark, sf_dir):
    return A.unknown_values(Tables(spark, sf_dir).documents, "source", F.col("source").isin("src1", "src3", "src7"))


@query("a22_macro_f1", f"WITH {LABELED_SQL}, {_BY_SOURCE} SELECT source, round(macro_f1, 6) AS macro_f1 FROM macro")
def a22(spark, sf_dir):
    return rounded(E.macro_f1(labeled(Tables(spark, sf_dir)), "lang", "pred", LANGS, by=["source"]), "macro_f1")


@query("a23_summary_lines", f"""WITH {CORPUS_SQL}, c AS (SELECT book, emotion, count(*) AS n FROM corpus GROUP BY ALL)
SELECT book, book || ' — ' || string_agg(emotion || ': ' || n, ', ' ORDER BY n DESC, emotion) AS line FROM c GROUP BY book""")
def a23(spark, sf_dir):
    return A.summary_lines(corpus(Tables(spark, sf_dir)), "book", "emotion")
