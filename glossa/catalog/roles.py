"""The given tables in the roles of annotated corpora, as DataFrames and as SQL.

Labels, books and keys are computed from the columns of each row, so every query
works on all rows of its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.catalog.registry import Tables
from glossa.domains import EMOTIONS, EMOTIONS_ES, THEMES, THEMES_ES

# Characters that text clean-up must deal with, put into the plain test texts.
_DIRT = [(", ", " — [12]    "), (". ", ".\x0b  “ ’\x1c\t"), (" de ", "   ‘de’ [3] ")]
_HEAD, _TAIL = "\t  – ", " \u0085\r\n "


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def dirty(c: Column) -> Column:
    for old, new in _DIRT:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.concat(F.lit(_HEAD), c, F.lit(_TAIL))


def dirty_sql(c: str) -> str:
    for old, new in _DIRT:
        c = f"replace({c}, {literal(old)}, {literal(new)})"
    return f"({literal(_HEAD)} || {c} || {literal(_TAIL)})"


# English and Spanish book slugs that the 20 document sources stand for.
BOOKS_EN = ["genesis", "exodus", "ruth", "1_samuel", "psalms", "song_of_solomon", "jonah", "malachi", "matthew",
            "mark", "luke", "john", "acts", "romans", "1_corinthians", "titus", "james", "2_peter", "3_john", "jude"]
BOOKS_ES = ["genesis", "exodo", "rut", "1-samuel", "salmos", "cantares", "jonas", "malaquias", "mateo",
            "marcos", "lucas", "juan", "hechos", "romanos", "1-corintios", "tito", "santiago", "2-pedro", "3-juan", "judas"]


def english_books(rows: DataFrame) -> DataFrame:
    """Rows of both corpora with the English slug of their book."""
    return rows.withColumn("book", F.get(F.array(*[F.lit(b) for b in BOOKS_EN]), F.col("book_no")))


EMOTION_SQL = f"{[*EMOTIONS]}[(n_chars % 7)::INT + 1]".replace('"', "'")
_THEME_CASES = ", ".join(f"CASE WHEN n_chars % {i} = 0 THEN '{t}' END" for i, t in enumerate(THEMES, start=2))
THEME_SQL = f"nullif(concat_ws(';', {_THEME_CASES}), '')"
BOOK_NO_SQL = "CAST(substr(source, 4) AS INT)"


def _case(column: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {default} END"


def emotion_es_sql(c: str) -> str:
    return _case(f"lower(trim({c}))", EMOTIONS_ES, f"trim({c})")


def themes_es_sql(c: str) -> str:
    each = _case("lower(trim(x))", THEMES_ES, "trim(x)")
    return f"array_to_string(list_transform(string_split({c}, ';'), lambda x: {each}), ';')"


# Labelled corpus in two languages: all documents. English texts keep English
# labels, all others carry Spanish ones.
CORPUS_SQL = f"""corpus0 AS (
  SELECT doc_id, text, n_chars, source, CASE WHEN lang = 'en' THEN 'en' ELSE 'es' END AS lang,
    {BOOK_NO_SQL} AS book_no, doc_id // 40 + 1 AS chapter, doc_id % 40 + 1 AS verse,
    'd' || doc_id AS verse_id, {EMOTION_SQL} AS emotion_en, {THEME_SQL} AS theme_en
  FROM documents),
corpus AS (
  SELECT doc_id, text, n_chars, source, lang, book_no, chapter, verse, verse_id,
    CASE WHEN lang = 'en' THEN {BOOKS_EN}[book_no + 1] ELSE {BOOKS_ES}[book_no + 1] END AS book,
    CASE WHEN lang = 'en' THEN emotion_en ELSE {emotion_es_sql('emotion_en')} END AS emotion,
    CASE WHEN lang = 'en' THEN theme_en ELSE {themes_es_sql('theme_en')} END AS theme
  FROM corpus0)"""


def pick(c: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), c.cast("int"))


def emotion_of(n: Column) -> Column:
    return pick(n % 7, EMOTIONS)


def themes_of(n: Column) -> Column:
    found = [F.when(n % i == 0, F.lit(t)) for i, t in enumerate(THEMES, start=2)]
    return F.nullif(F.concat_ws(";", *found), F.lit(""))


def corpus(t: Tables) -> DataFrame:
    from glossa.functions.labels import translate_emotion, translate_themes

    n, english = F.col("n_chars"), F.col("lang") == "en"
    es_theme = F.when(F.col("theme").isNotNull(), translate_themes(F.col("theme")))
    return (t.documents
            .withColumn("book_no", F.substr("source", F.lit(4)).cast("int"))
            .withColumn("book", F.when(english, pick(F.col("book_no"), BOOKS_EN)).otherwise(
                pick(F.col("book_no"), BOOKS_ES)))
            .withColumn("chapter", F.expr("doc_id div 40 + 1")).withColumn("verse", F.col("doc_id") % 40 + 1)
            .withColumn("verse_id", F.concat(F.lit("d"), "doc_id"))
            .withColumn("emotion", emotion_of(n)).withColumn("theme", themes_of(n))
            .withColumn("emotion", F.when(english, F.col("emotion")).otherwise(translate_emotion(F.col("emotion"))))
            .withColumn("theme", F.when(english, F.col("theme")).otherwise(es_theme))
            .withColumn("lang", F.when(english, "en").otherwise("es")))


# Verses: the conversations, keyed by (conv_id, turn) inside a role.
VERSES_SQL = """verses AS (
  SELECT role AS book, conv_id AS chapter, turn + 1 AS verse, text,
    role || '_' || conv_id || '_' || (turn + 1) AS verse_id FROM conversations)"""


def verses(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.col("role").alias("book"), F.col("conv_id").alias("chapter"), (F.col("turn") + 1).alias("verse"), "text",
        F.concat_ws("_", "role", "conv_id", F.col("turn") + 1).alias("verse_id"))


# Lexicons: frequent words per language.
LEXICON = {
    "en": {w: 1.0 for w in ("the", "of", "and", "that", "with", "are", "for", "is", "it", "was")},
    "fr": {w: 1.0 for w in ("le", "les", "et", "que", "des", "une", "un", "est", "pour", "dans")},
    "de": {w: 1.0 for w in ("der", "die", "und", "das", "nicht", "ein", "ist", "den", "mit", "von")},
    "es": {w: 1.0 for w in ("el", "los", "que", "y", "una", "por", "con", "para", "las", "del")},
}
# Variants of the lexicon that act as further models.
WEIGHTED = {lang: {w: 2.0 if len(w) > 2 else 0.5 for w in ws} for lang, ws in LEXICON.items()}
SHORT = {lang: {w: 1.0 for w in list(ws)[:4]} for lang, ws in LEXICON.items()}
REVERSED = {lang: LEXICON[lang] for lang in reversed(LEXICON)}
LANGS = list(LEXICON)


def lexicon_cte(name: str, lexicon: dict, source: str = "documents", key: str = "doc_id") -> str:
    """CTE ``name(key, w0, w1, ..)``: weight per label, by exploding all words."""
    rows = ", ".join(f"({literal(w)}, {i}, {x})" for i, ws in enumerate(lexicon.values()) for w, x in ws.items())
    sums = ", ".join(f"coalesce(sum(weight) FILTER (WHERE label = {i}), 0) AS w{i}" for i in range(len(lexicon)))
    return f"""{name} AS (
  SELECT d.{key}, {sums}
  FROM (SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM {source}) d
  JOIN (VALUES {rows}) AS l(word, label, weight) USING (word) GROUP BY d.{key})"""


def top_sql(lexicon: dict, prefix: str = "") -> tuple[str, str]:
    """(label, score) expressions: highest weight, the first label winning ties."""
    ws = [f"{prefix}w{i}" for i in range(len(lexicon))]
    best = f"greatest({', '.join(ws)})"
    whens = " ".join(f"WHEN {w} = {best} THEN '{label}'" for w, label in zip(ws, lexicon))
    return f"CASE {whens} END", f"{best} / ({' + '.join(ws)})"


def predicted(t: Tables, lexicon: dict = LEXICON, out: str = "preds") -> DataFrame:
    """All documents with lexicon predictions."""
    from glossa.operators.scoring import lexicon_predictions
    return lexicon_predictions(t.spread("documents"), "text", lexicon, out)


def labeled(t: Tables) -> DataFrame:
    """Documents with their language as truth and the lexicon's answer as prediction."""
    from glossa.functions.scores import top_prediction
    top = top_prediction(F.col("preds"))
    return predicted(t).select("doc_id", "text", "lang", "source", top["label"].alias("pred"),
                               top["score"].alias("score"))


_LABEL, _SCORE = top_sql(LEXICON)
LABELED_SQL = f"""{lexicon_cte('hits', LEXICON)},
labeled AS (SELECT d.doc_id, d.text, d.lang, d.source, CASE WHEN h.doc_id IS NULL THEN NULL ELSE {_LABEL} END AS pred,
    {_SCORE} AS score
  FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id)"""
