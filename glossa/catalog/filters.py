"""Projection, filter and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog.registry import Tables, query
from glossa.catalog.roles import (
    CORPUS_SQL, LABELED_SQL, LEXICON, REVERSED, SHORT, VERSES_SQL, WEIGHTED, corpus, labeled, lexicon_cte, top_sql,
    verses,
)
from glossa.domains import EMOTIONS, EMOTIONS_ES
from glossa.functions.scores import top_prediction
from glossa.operators import filters as P
from glossa.operators.scoring import lexicon_predictions, with_words

# Four models over all documents: label and score each.
MODELS = {"plain": LEXICON, "weighted": WEIGHTED, "short": SHORT, "reversed": REVERSED}


def four_models(t: Tables):
    df = with_words(t.spread("documents").select("doc_id", "text", "lang"), "text", "_w")
    for name, lexicon in MODELS.items():
        df = lexicon_predictions(df, "text", lexicon, "_p", split="_w")
        best = top_prediction(F.col("_p"))
        df = df.withColumn(name, best["label"]).withColumn(f"{name}_score", best["score"]).drop("_p")
    return df.drop("_w")


def _model_columns() -> str:
    out = []
    for name, lexicon in MODELS.items():
        label, score = top_sql(lexicon, f"{name}_hits.")
        out.append(f"CASE WHEN {name}_hits.doc_id IS NULL THEN NULL ELSE {label} END AS {name}, {score} AS {name}_score")
    return ", ".join(out)


_JOINS = " ".join(f"LEFT JOIN {n}_hits ON d.doc_id = {n}_hits.doc_id" for n in MODELS)
MODELS_SQL = ",\n".join(lexicon_cte(f"{n}_hits", lx) for n, lx in MODELS.items()) + f""",
models AS (SELECT d.doc_id, d.lang, {_model_columns()} FROM documents d {_JOINS})"""


@query("p01_valid_row", """SELECT conv_id, turn FROM conversations
WHERE conv_id % 5 <> 0 AND NOT (conv_id % 7 = 3) AND turn >= 1""")
def p01(spark, sf_dir):
    c = F.col("conv_id")
    book = F.when(c % 5 == 0, "  \t ").otherwise(F.col("role"))
    chapter = F.when(c % 7 == 3, "abc").otherwise(F.concat(c + 1, F.lit(".9")))
    verse = F.when(F.col("turn") == 0, "0.5").otherwise(F.col("turn").cast("string"))
    return Tables(spark, sf_dir).conversations.where(P.valid_row(book, chapter, verse)).select("conv_id", "turn")


_INITCAP = "upper(book[1]) || book[2:]"


@query("p02_annotation_frame", f"""WITH {VERSES_SQL} SELECT row_id AS id, book, chapter, verse, text,
  {_INITCAP} || '_' || chapter || '_' || verse AS verse_id, '' AS theme, '' AS emotion
FROM (SELECT * REPLACE (chapter + 1 AS chapter), chapter * 100 + verse AS row_id FROM verses)""")
def p02(spark, sf_dir):
    raw = verses(Tables(spark, sf_dir)).drop("verse_id").withColumn("id", F.expr("chapter * 100 + verse"))
    return P.annotation_frame(raw.withColumn("chapter", F.col("chapter") + 1))


@query("p03_project", "SELECT doc_id, lang FROM documents")
def p03(spark, sf_dir):
    return P.project(Tables(spark, sf_dir).documents, keep=["doc_id", "lang", "n_chars"], drop=["n_chars"])


@query("p04_labelable", """SELECT 'd' || doc_id AS verse_id, text AS verse FROM documents
WHERE doc_id % 4 <> 0 AND lang <> 'fr'""")
def p04(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    return P.labelable(docs.select(
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("d"), "doc_id")).alias("verse_id"),
        F.when(F.col("lang") != "fr", F.col("text")).alias("text"), "source"))


@query("p05_in_domain", f"WITH {CORPUS_SQL} SELECT doc_id, emotion FROM corpus WHERE emotion IN {tuple(EMOTIONS)}")
def p05(spark, sf_dir):
    return P.in_domain(corpus(Tables(spark, sf_dir)), "emotion", EMOTIONS).select("doc_id", "emotion")


@query("p06_outside_domain", f"""WITH {CORPUS_SQL}
SELECT DISTINCT emotion FROM corpus WHERE emotion NOT IN {tuple(EMOTIONS)}""")
def p06(spark, sf_dir):
    return P.outside_domain(corpus(Tables(spark, sf_dir)), "emotion", EMOTIONS)


@query("p07_matches", f"""WITH {CORPUS_SQL}
SELECT doc_id FROM corpus WHERE emotion IN ('Alegría', 'joy') AND lang = 'es' AND emotion = 'Alegría'
  AND list_contains(string_split(theme, ';'), 'perdón')""")
def p07(spark, sf_dir):
    c = corpus(Tables(spark, sf_dir))
    return c.where(P.matches(F.col("emotion"), F.col("theme"), " ALEGRIA ", "Perdon")).select("doc_id")


@query("p07_matches_compat", f"""WITH {CORPUS_SQL}
SELECT doc_id FROM corpus WHERE emotion = 'joy' AND contains(coalesce(strip_accents(theme), 'nan'), 'a')""")
def p07_compat(spark, sf_dir):
    c = corpus(Tables(spark, sf_dir))
    return c.where(P.matches(F.col("emotion"), F.col("theme"), "joy", "a", compat_contains=True)).select("doc_id")


@query("p08_admissible", """SELECT conv_id, turn FROM conversations
WHERE turn % 3 = 0 OR NOT (turn % 3 = 1)""")
def p08(spark, sf_dir):
    text = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.lit("  x y"[:4])).otherwise(F.col("text"))
    return Tables(spark, sf_dir).conversations.where(P.admissible(text)).select("conv_id", "turn")


@query("p09_mismatches", f"""WITH {LABELED_SQL} SELECT doc_id, lang, pred FROM labeled
WHERE pred IS NULL OR pred <> lang ORDER BY doc_id LIMIT 10""")
def p09(spark, sf_dir):
    return P.mismatches(labeled(Tables(spark, sf_dir)), "lang", "pred", ["doc_id"]).select("doc_id", "lang", "pred")


@query("p10_any_null", f"WITH {CORPUS_SQL} SELECT doc_id FROM corpus WHERE theme IS NULL")
def p10(spark, sf_dir):
    return P.any_null(corpus(Tables(spark, sf_dir)), ["emotion", "theme", "book"]).select("doc_id")


_PAIRS = [(a, b) for i, a in enumerate(MODELS) for b in list(MODELS)[i + 1:]]
_ALL_DIFFER = " AND ".join(f"{a} IS DISTINCT FROM {b} AND {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS)
_ALL_DIFFER = " AND ".join(f"coalesce({a} <> {b}, true)" for a, b in _PAIRS)


@query("p11_agree_or_differ", f"""WITH {MODELS_SQL}
SELECT doc_id, coalesce(plain = weighted AND plain = short AND plain = reversed, false) AS agree,
  {_ALL_DIFFER} AS differ FROM models""")
def p11(spark, sf_dir):
    names = list(MODELS)
    return four_models(Tables(spark, sf_dir)).select(
        "doc_id", P.all_agree(names).alias("agree"), P.all_differ(names).alias("differ"))


@query("p12_confident_disagreement", f"""WITH {MODELS_SQL}
SELECT doc_id, {", ".join(MODELS)} FROM models WHERE {_ALL_DIFFER} AND {" AND ".join(f"coalesce({m}_score > 0.8, false)" for m in MODELS)}
UNION ALL SELECT doc_id, plain, NULL, NULL, reversed FROM models WHERE plain <> reversed AND plain_score > 0.3 AND reversed_score > 0.3""")
def p12(spark, sf_dir):
    df = four_models(Tables(spark, sf_dir))
    all_four = P.confident_disagreement(list(MODELS), [f"{m}_score" for m in MODELS])
    two = P.confident_disagreement(["plain", "reversed"], ["plain_score", "reversed_score"], 0.3)
    kept = df.where(two & F.col("plain").isNotNull() & F.col("reversed").isNotNull())
    return df.where(all_four).select("doc_id", *MODELS).unionByName(
        kept.select("doc_id", "plain", "reversed"), allowMissingColumns=True)
