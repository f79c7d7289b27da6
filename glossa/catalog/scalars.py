"""Scalar function queries (F01-F28) on all documents, verses, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog.registry import Tables, query
from glossa.catalog.roles import (
    BOOKS_ES, CORPUS_SQL, LEXICON, VERSES_SQL, corpus, dirty, dirty_sql, emotion_es_sql, lexicon_cte, literal,
    predicted, themes_es_sql, verses, _case,
)
from glossa.domains import (
    BOOK_DISPLAY_ES, CODE_TO_BOOK, EMOTIONS, EMOTIONS_ES, FINE_TO_COARSE, LABEL_CORRECTIONS, THEMES_ES, invert,
)
from glossa.functions import labels as L
from glossa.functions import scores as S
from glossa.functions import text as X

_WS = literal(X.WHITESPACE)
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_TITLE = ("array_to_string(list_transform(regexp_extract_all({0}, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+'), "
          "lambda x: upper(x[1]) || lower(x[2:])), '')")


def cap_sql(c: str) -> str:
    return f"(upper(({c})[1]) || lower(({c})[2:]))"


def clean_sql(c: str) -> str:
    lines = f"string_split(regexp_replace({c}, '{_BREAK}', chr(10), 'g'), chr(10))"
    each = f"regexp_replace(trim(x, {_WS}), '{_SPACE}', ' ', 'g')"
    return f"trim(array_to_string(list_transform({lines}, lambda x: {each}), chr(10)), {_WS})"


def punct_sql(c: str) -> str:
    return f"translate({c}, '“”‘’–—', '\"\"''''--')"


def _docs(name, spark_expr, sql_expr, out="result", extra=(), extra_sql=""):
    """A scalar function over every document: (doc_id, result)."""
    @query(name, f"SELECT doc_id, {sql_expr} AS {out}{extra_sql} FROM documents")
    def run(spark, sf_dir):
        return Tables(spark, sf_dir).spread("documents").select("doc_id", spark_expr().alias(out), *extra)


_docs("f01_clean_text", lambda: X.clean_text(dirty(F.col("text"))), clean_sql(dirty_sql("text")))
_docs("f02_ascii_punctuation", lambda: X.ascii_punctuation(dirty(F.col("text"))), punct_sql(dirty_sql("text")))
_docs("f03_flatten_text", lambda: X.flatten_text(dirty(F.col("text"))),
      f"array_to_string(list_filter(regexp_split_to_array({dirty_sql('text')}, '{_SPACE}'), lambda w: w <> ''), ' ')")


@query("f04_verse_key", f"""WITH {CORPUS_SQL}
SELECT doc_id, CASE WHEN verse % 9 = 0 OR doc_id % 11 = 0 THEN 'INVALID_ID'
  ELSE {_TITLE.format("replace(trim('  ' || replace(book, '_', ' ') || ' '), ' ', '_')")}
       || '_' || chapter || '_' || verse END AS result FROM corpus""")
def f04(spark, sf_dir):
    c = corpus(Tables(spark, sf_dir))
    book = F.concat(F.lit("  "), F.replace("book", F.lit("_"), F.lit(" ")), F.lit(" "))
    chapter = F.when(F.col("doc_id") % 11 == 0, "abc").otherwise(F.concat("chapter", F.lit(".7")))
    verse = F.when(F.col("verse") % 9 == 0, -F.col("verse")).otherwise(F.col("verse"))
    return c.select("doc_id", X.verse_key(book, chapter, verse).alias("result"))


_docs("f05_normalize", lambda: X.normalize(F.col("text")),
      f"replace(replace(replace(strip_accents(lower(trim(text, {_WS}))), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')")
_docs("f06_to_number", lambda: X.to_number(F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(
          F.concat(F.lit(" "), "n_chars", F.lit(".25 ")))),
      "CASE WHEN doc_id % 3 = 0 THEN TRY_CAST(source AS DOUBLE) ELSE TRY_CAST(n_chars || '.25' AS DOUBLE) END")


@query("f07_translate_themes", f"WITH {CORPUS_SQL} SELECT doc_id, "
       f"coalesce({themes_es_sql('upper(theme_en)')}, '') AS result FROM corpus0")
def f07(spark, sf_dir):
    from glossa.catalog.roles import themes_of
    raw = F.upper(themes_of(F.col("n_chars")))
    return Tables(spark, sf_dir).documents.select("doc_id", L.translate_themes(raw).alias("result"))


@query("f08_translate_emotion", f"WITH {CORPUS_SQL} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN source "
       f"ELSE {emotion_es_sql('emotion_en')} END AS result FROM corpus0")
def f08(spark, sf_dir):
    from glossa.catalog.roles import emotion_of
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), "source")).otherwise(
        F.concat(F.lit(" "), F.upper(emotion_of(F.col("n_chars"))), F.lit("  ")))
    return Tables(spark, sf_dir).documents.select("doc_id", L.translate_emotion(raw).alias("result"))


_docs("f09_clean_verse", lambda: X.clean_verse(dirty(F.col("text"))),
      f"trim(regexp_replace(regexp_replace({dirty_sql('text')}, '{_SPACE}', ' ', 'g'), '\\[\\d+\\]', '', 'g'), {_WS})")
_docs("f10_canonical_label", lambda: X.canonical_label(F.concat(F.lit("  "), F.upper("source"), F.lit("\t"))), "source")

_STRAY = [*LABEL_CORRECTIONS, "joy", "zeal"]


@query("f11_correct_label", f"SELECT doc_id, {_case('raw', LABEL_CORRECTIONS, 'raw')} AS result FROM "
       f"(SELECT doc_id, {_STRAY}[(n_chars % {len(_STRAY)})::INT + 1] AS raw FROM documents)")
def f11(spark, sf_dir):
    from glossa.catalog.roles import pick
    raw = pick(F.col("n_chars") % len(_STRAY), _STRAY)
    return Tables(spark, sf_dir).documents.select("doc_id", L.correct_label(raw).alias("result"))


_FINE = [*FINE_TO_COARSE, "zeal"]


@query("f12_coarse_emotion", f"SELECT doc_id, {_case('raw', FINE_TO_COARSE, literal('neutral'))} AS result FROM "
       f"(SELECT doc_id, {_FINE}[(n_chars % {len(_FINE)})::INT + 1] AS raw FROM documents)")
def f12(spark, sf_dir):
    from glossa.catalog.roles import pick
    raw = pick(F.col("n_chars") % len(_FINE), _FINE)
    return Tables(spark, sf_dir).documents.select("doc_id", L.coarse_emotion(raw).alias("result"))


@query("f13_back_translate", f"""WITH {CORPUS_SQL}
SELECT doc_id, {_case('lower(emotion)', invert(EMOTIONS_ES), 'NULL')} AS result FROM corpus""")
def f13(spark, sf_dir):
    return corpus(Tables(spark, sf_dir)).select("doc_id", L.back_translate(F.col("emotion"), EMOTIONS_ES).alias("result"))


@query("f14_label_ids", f"""WITH {CORPUS_SQL}
SELECT doc_id, CASE WHEN list_contains({EMOTIONS}, emotion) THEN list_position({EMOTIONS}, emotion) - 1 END AS label_id,
  {EMOTIONS}[(doc_id % 9)::INT + 1] AS name FROM corpus""")
def f14(spark, sf_dir):
    return corpus(Tables(spark, sf_dir)).select(
        "doc_id", L.label_id(F.col("emotion")).alias("label_id"), L.label_name(F.col("doc_id") % 9).alias("name"))


@query("f15_theme_set", f"""WITH {CORPUS_SQL}
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(string_split(theme, ';'),
  lambda x: {_case('lower(trim(x))', invert(THEMES_ES), 'lower(trim(x))')}))), ';') AS result
FROM corpus WHERE theme IS NOT NULL UNION ALL SELECT doc_id, '' FROM corpus WHERE theme IS NULL""")
def f15(spark, sf_dir):
    return corpus(Tables(spark, sf_dir)).select(
        "doc_id", F.array_join(F.array_sort(L.theme_set(F.col("theme"), THEMES_ES)), ";").alias("result"))


@query("f16_display_book", f"""WITH {CORPUS_SQL}, slugs AS (
  SELECT doc_id, lang, replace(lower(upper(book)), '_', '-') AS slug FROM corpus)
SELECT doc_id, CASE WHEN lang = 'es' THEN {_case('slug', {k: BOOK_DISPLAY_ES[k] for k in BOOKS_ES}, "slug")}
  ELSE {_TITLE.format("replace(slug, '-', ' ')")} END AS result FROM slugs""")
def f16(spark, sf_dir):
    return corpus(Tables(spark, sf_dir)).select(
        "doc_id", L.display_book(F.upper("book"), F.col("lang")).alias("result"))


@query("f17_percent_text", """SELECT event_id, CASE WHEN event_id % 2 = 0
  THEN translate(format('{:,.2f}', value * 100), ',.', '.,') ELSE format('{:.2f}', value * 100) END AS result FROM events""")
def f17(spark, sf_dir):
    lang = F.when(F.col("event_id") % 2 == 0, "es").otherwise("en")
    return Tables(spark, sf_dir).events.select("event_id", L.percent_text(F.col("value"), lang).alias("result"))


@query("f18_citation", f"""WITH {VERSES_SQL} SELECT verse_id,
  {cap_sql('book')} || ' ' || chapter || ':' || verse || ' - ' || trim(text, {_WS}) AS result FROM verses""")
def f18(spark, sf_dir):
    padded = F.concat(F.lit("  "), "text", F.lit(" \n"))
    return verses(Tables(spark, sf_dir)).select(
        "verse_id", L.citation(F.col("book"), F.col("chapter"), F.col("verse"), padded).alias("result"))


_docs("f19_text_length", lambda: X.text_length(F.col("text")).cast("bigint"), "length(text)")


@query("f20_id_parts", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type || '/' || user_id || '/' || event_id END
  AS result FROM events""")
def f20(spark, sf_dir):
    dotted = F.concat_ws(".", "event_type", "user_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id")))
    return Tables(spark, sf_dir).events.select("event_id", F.array_join(X.id_parts(dotted), "/").alias("result"))


_CODES = [*list(CODE_TO_BOOK), "Fake"]


@query("f21_book_of_code", f"""SELECT doc_id, {_case('code', CODE_TO_BOOK, 'NULL')} AS result, code FROM
  (SELECT doc_id, {_CODES}[(n_chars % {len(_CODES)})::INT + 1] AS code FROM documents)""")
def f21(spark, sf_dir):
    from glossa.catalog.roles import pick
    code = pick(F.col("n_chars") % len(_CODES), _CODES)
    return Tables(spark, sf_dir).documents.select("doc_id", L.book_of_code(code).alias("result"), code.alias("code"))


_docs("f22_verse_number", lambda: X.verse_number(F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(
          F.concat(F.lit(" "), "n_chars", F.lit(" ")))),
      "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars::INT END")


@query("f23_softmax", f"""WITH {lexicon_cte('hits', LEXICON)}, z AS (
  SELECT doc_id, [coalesce(w0, 0), coalesce(w1, 0), coalesce(w2, 0), coalesce(w3, 0)] AS w, coalesce(greatest(w0, w1, w2, w3), 0) AS m
  FROM documents LEFT JOIN hits USING (doc_id)), e AS (
  SELECT doc_id, exp((w[1] - m) / 10) AS a, exp((w[2] - m) / 10) AS b, exp((w[3] - m) / 10) AS c, exp((w[4] - m) / 10) AS d FROM z)
SELECT doc_id, round(a / (a+b+c+d), 6) AS p0, round(b / (a+b+c+d), 6) AS p1, round(c / (a+b+c+d), 6) AS p2,
  round(d / (a+b+c+d), 6) AS p3 FROM e""")
def f23(spark, sf_dir):
    from glossa.operators.scoring import words
    w = words(F.col("text"))
    counts = F.array(*[F.size(F.filter("_words", among(ws))) / F.lit(10.0) for ws in LEXICON.values()])
    docs = Tables(spark, sf_dir).spread("documents").withColumn("_words", w).withColumn("_logits", counts)
    docs = docs.withColumn("_p", S.softmax(F.col("_logits")))
    return docs.select("doc_id", *[F.round(F.get("_p", F.lit(i)), 6).alias(f"p{i}") for i in range(4)])


def among(known):
    return lambda w: w.isin(*known)


_EMO_ES = _case("lower(emotion)", EMOTIONS_ES, cap_sql("emotion"))
_THEME_EN = _case("lower(trim(t))", invert(THEMES_ES), "lower(trim(t))")


@query("f24_display_labels", f"""WITH {CORPUS_SQL}, firsts AS (
  SELECT doc_id, lang, emotion, string_split(theme, ';')[1] AS t FROM corpus), en AS (
  SELECT *, {_THEME_EN} AS te FROM firsts)
SELECT doc_id, CASE WHEN lang = 'es' THEN {_EMO_ES} ELSE {cap_sql('emotion')} END AS emotion_shown,
  CASE WHEN lang = 'es' THEN {cap_sql(_case('te', THEMES_ES, 'te'))} ELSE {cap_sql('te')} END AS theme_shown FROM en""")
def f24(spark, sf_dir):
    c = corpus(Tables(spark, sf_dir)).withColumn("t", F.get(F.split("theme", ";"), F.lit(0)))
    return c.select("doc_id", L.display_emotion(F.col("emotion"), F.col("lang")).alias("emotion_shown"),
                    L.display_theme(F.col("t"), F.col("lang")).alias("theme_shown"))


@query("f25_percent", "SELECT event_id, round(value / 7 * 100, 2) AS result FROM events")
def f25(spark, sf_dir):
    return Tables(spark, sf_dir).events.select("event_id", L.percent(F.col("value") / 7).alias("result"))


@query("f26_iso_seconds", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS result FROM events")
def f26(spark, sf_dir):
    # the tables hold wall-clock times without a zone
    return Tables(spark, sf_dir).events.select("event_id", X.iso_seconds(F.col("ts")).alias("result"))


@query("f27_file_names", f"""WITH {CORPUS_SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE book_no END AS number,
  CASE WHEN doc_id % 4 = 3 THEN NULL ELSE book END AS slug FROM corpus""")
def f27(spark, sf_dir):
    ends = F.array(F.lit("_cleaned.csv"), F.lit("_emotion.csv"), F.lit("_emotion_theme.csv"), F.lit(".txt"))
    name = F.concat("book_no", F.lit("_"), "book", F.get(ends, (F.col("doc_id") % 4).cast("int")))
    return corpus(Tables(spark, sf_dir)).select(
        "doc_id", X.file_prefix(name).alias("number"), X.file_slug(name).alias("slug"))


_docs("f28_stringify_missing", lambda: X.stringify_missing(F.when(F.col("doc_id") % 6 != 0, F.col("text"))),
      "CASE WHEN doc_id % 6 = 0 THEN 'nan' ELSE text END")
