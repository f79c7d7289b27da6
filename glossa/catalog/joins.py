"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog.registry import Tables, query
from glossa.catalog.roles import BOOK_NO_SQL, CORPUS_SQL, corpus, emotion_es_sql, emotion_of, literal, themes_es_sql, themes_of
from glossa.domains import EMOTIONS, EMOTIONS_ES, THEMES, THEMES_ES, sections
from glossa.functions.labels import lookup
from glossa.functions.text import WHITESPACE
from glossa.operators import annotate, recommend
from glossa.operators import transfer as J
from glossa.session import scratch_path

_WS = literal(WHITESPACE)
_SOURCE_SQL = f"""{CORPUS_SQL}, src AS (
  SELECT book_no, n_chars % 9 AS chapter, doc_id % 11 AS verse, doc_id, theme_en, emotion_en FROM corpus0),
last AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY book_no, chapter, verse ORDER BY doc_id DESC) = 1),
target AS (SELECT conv_id, turn, conv_id % 20 AS book_no, length(text) % 9 AS chapter, turn AS verse FROM conversations)"""


def source(t: Tables):
    return t.documents.select(
        F.substr("source", F.lit(4)).cast("int").alias("book_no"), (F.col("n_chars") % 9).alias("chapter"),
        (F.col("doc_id") % 11).alias("verse"), "doc_id", themes_of(F.col("n_chars")).alias("theme"),
        emotion_of(F.col("n_chars")).alias("emotion"))


def target(t: Tables):
    return t.conversations.select(
        "conv_id", "turn", (F.col("conv_id") % 20).cast("int").alias("book_no"),
        (F.length("text") % 9).alias("chapter"), F.col("turn").alias("verse"))


@query("j01_transfer_labels", f"""WITH {_SOURCE_SQL}
SELECT conv_id, turn, coalesce({themes_es_sql('theme_en')}, '') AS theme, coalesce({emotion_es_sql('emotion_en')}, '') AS emotion,
  last.doc_id IS NOT NULL AS matched
FROM target LEFT JOIN last USING (book_no, chapter, verse)""")
def j01(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return J.transfer_labels(target(t), source(t), ["doc_id"]).select("conv_id", "turn", "theme", "emotion", "matched")


@query("j01_transfer_audit", f"""WITH {_SOURCE_SQL}
SELECT book_no::INT AS book_no, count(*) AS rows, count(*) FILTER (WHERE last.doc_id IS NULL) AS unmatched
FROM target LEFT JOIN last USING (book_no, chapter, verse) GROUP BY book_no""")
def j01_audit(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return J.transfer_audit(J.transfer_labels(target(t), source(t), ["doc_id"]), "book_no")


@query("j02_transfer_by_position", f"""WITH {CORPUS_SQL}, t AS (
  SELECT doc_id, doc_id // 10 AS unit, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY doc_id // 10) AS n
  FROM documents WHERE doc_id % 10 <> 3),
s AS (SELECT doc_id // 10 AS unit, emotion_en AS emotion, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY n_chars, doc_id) AS rn,
  count(*) OVER (PARTITION BY doc_id // 10) AS n
  FROM corpus0 WHERE doc_id % 10 <> 4 AND NOT (doc_id // 10 % 3 = 0 AND doc_id % 10 = 5))
SELECT t.doc_id, t.unit, s.emotion FROM t JOIN s USING (unit, rn, n)""")
def j02(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.withColumn("unit", F.expr("doc_id div 10")).withColumn(
        "nth", F.col("doc_id") % 10)
    left = docs.where("nth <> 3").select("doc_id", "unit")
    right = docs.where("nth <> 4 AND NOT (unit % 3 = 0 AND nth = 5)").select("doc_id", "unit", "n_chars")
    left = left.withColumn("n_chars", F.col("doc_id")).select("doc_id", "unit", "n_chars")
    moved = J.transfer_by_position(left, right, "unit", ["n_chars", "doc_id"], {"emotion": emotion_of(F.col("n_chars"))}, ["doc_id"])
    return moved.select("doc_id", "unit", "emotion")


@query("j03_merge_annotations", """SELECT d.doc_id::VARCHAR AS id, 'd' || d.doc_id AS verse_id, d.text AS verse, quality::VARCHAR AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 4 <> 0""")
def j03(spark, sf_dir):
    t = Tables(spark, sf_dir)
    key = F.when(F.col("doc_id") % 4 == 0, "d?").otherwise(F.concat(F.lit("d"), "doc_id"))
    samples = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), "doc_id").alias("verse_id"),
                                 F.col("text").alias("verse"))
    answers = t.labels.select(F.col("doc_id").alias("id"), key.alias("verse_id"), F.col("quality").cast("string").alias("label"))
    return annotate.merge_annotations(samples, answers)


@query("j04_exclude_labeled", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def j04(spark, sf_dir):
    t = Tables(spark, sf_dir)
    known = t.labels.select(F.when(F.col("toxic") == 0, F.col("doc_id")).alias("doc_id"))
    return annotate.exclude_labeled(t.documents, known, "doc_id").select("doc_id", "source")


@query("j05_dictionary_lookup", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'now' ELSE o_orderpriority END AS priority,
  CASE o_custkey % 5 WHEN 0 THEN 'south' WHEN 1 THEN 'west' END AS side FROM orders""")
def j05(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select(
        "o_orderkey", lookup(F.col("o_orderstatus"), {"O": "open", "F": "filled"}, "other").alias("status"),
        lookup(F.col("o_orderpriority"), {"1-URGENT": "now"}, F.col("o_orderpriority")).alias("priority"),
        lookup(F.col("o_custkey") % 5, {0: "south", 1: "west"}).alias("side"))


@query("j06_align", """SELECT d.doc_id, d.n_chars % 2 AS quality_a, l.quality AS quality_b FROM documents d JOIN labels l USING (doc_id)""")
def j06(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return J.align(t.documents.withColumn("quality", F.col("n_chars") % 2), t.labels, ["doc_id"], ["quality"])


def _section_sql(lang: str, book: str) -> str:
    by = {}
    for slug, part in sections(lang).items():
        by.setdefault(part, []).append(slug)
    lists = " ".join(f"WHEN {book} IN ({', '.join(repr(s) for s in slugs)}) THEN '{part}'" for part, slugs in by.items())
    return f"CASE {lists} ELSE 'ot' END"


_PLAIN_BOOK = "replace(strip_accents(lower(book)), '-', '_')"
SECTION_SQL = f"CASE WHEN lang = 'en' THEN {_section_sql('en', _PLAIN_BOOK)} ELSE {_section_sql('es', _PLAIN_BOOK)} END"


@query("j07_sections", f"WITH {CORPUS_SQL} SELECT doc_id, {SECTION_SQL} AS section FROM corpus")
def j07(spark, sf_dir):
    return corpus(Tables(spark, sf_dir)).select(
        "doc_id", recommend.section(F.col("book"), F.col("lang")).alias("section"))


@query("j07_sections_compat", f"""WITH {CORPUS_SQL} SELECT doc_id, CASE WHEN lang = 'es' AND contains(book, '-') THEN 'ot' ELSE {SECTION_SQL} END AS section
FROM corpus""")
def j07_compat(spark, sf_dir):
    return corpus(Tables(spark, sf_dir)).select(
        "doc_id", recommend.section(F.col("book"), F.col("lang"), compat_sections=True).alias("section"))


def requests(t: Tables):
    """Every conversation turn asks for an emotion and a theme."""
    n = F.length("text")
    return t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.when(F.col("conv_id") % 2 == 0, "en").otherwise("es").alias("lang"),
        F.get(F.array(*[F.lit(e) for e in EMOTIONS]), (n % 7).cast("int")).alias("emotion"),
        F.initcap(F.get(F.array(*[F.lit(x) for x in THEMES]), (F.col("turn") % 5).cast("int"))).alias("theme"), "text")


def _es(column: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v.lower()}'" for k, v in mapping.items())
    return f"strip_accents(CASE WHEN lang = 'es' THEN CASE {column} {whens} END ELSE {column} END)"


PICKS_SQL = f"""{CORPUS_SQL}, rows AS (
  SELECT doc_id, verse_id, lang, strip_accents(lower(emotion)) AS emotion_norm,
    unnest(list_distinct(list_transform(string_split(theme, ';'), lambda x: strip_accents(lower(x))))) AS theme_norm,
    {SECTION_SQL} AS section FROM corpus),
ranked AS (SELECT *, row_number() OVER w - 1 AS rank, count(*) OVER (PARTITION BY lang, emotion_norm, theme_norm, section) AS size
  FROM rows WINDOW w AS (PARTITION BY lang, emotion_norm, theme_norm, section ORDER BY md5('0|' || verse_id), verse_id)),
sizes AS (SELECT DISTINCT lang, emotion_norm, theme_norm, section, size, size * greatest(1, ceil(256 / size))::BIGINT AS slots FROM ranked),
req0 AS (SELECT conv_id || '-' || turn AS request_id, CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'es' END AS lang,
  {EMOTIONS}[(length(text) % 7)::INT + 1] AS emotion, {THEMES}[(turn % 5)::INT + 1] AS theme, text FROM conversations),
req AS (SELECT request_id, lang, {_es('emotion', EMOTIONS_ES)} AS emotion_norm, {_es('theme', THEMES_ES)} AS theme_norm, text FROM req0),
picks AS (SELECT request_id, lang, emotion_norm, theme_norm, section, pick,
    (('0x' || substr(md5('0|' || request_id || '|' || section), 1, 12))::BIGINT % slots + pick) % slots % size AS rank
  FROM (SELECT *, unnest(range(least(2, size))) AS pick FROM req JOIN sizes USING (lang, emotion_norm, theme_norm))),
answers AS (SELECT request_id, lang, section, pick, verse_id FROM picks JOIN ranked USING (lang, emotion_norm, theme_norm, section, rank))"""


@query("j08_batch_recommendation", f"WITH {PICKS_SQL} SELECT request_id, lang, section, pick, verse_id FROM answers")
def j08(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = corpus(t).select("verse_id", "lang", "book", "emotion", "theme")
    index, sizes = recommend.prepare_corpus(rows, ["verse_id"])
    return recommend.answer_requests(requests(t), index, sizes, ["verse_id"])


@query("j09_unit_pairs", f"""WITH a AS (SELECT DISTINCT {BOOK_NO_SQL} AS number, source AS unit FROM documents),
b AS (SELECT conv_id % 15 AS number, min(role) AS partner, count(DISTINCT role) AS partners FROM conversations GROUP BY 1)
SELECT a.number, unit, partner, coalesce(partners, 0) AS partners FROM a LEFT JOIN b ON a.number = b.number""")
def j09(spark, sf_dir):
    t = Tables(spark, sf_dir)
    left = t.documents.select(F.substr("source", F.lit(4)).cast("int").alias("number"), F.col("source").alias("name"))
    right = t.conversations.select((F.col("conv_id") % 15).cast("int").alias("number"), F.col("role").alias("name"))
    return J.unit_pairs(left, right, "number", "name")


@query("j08_request_citations", f"""WITH {PICKS_SQL}, lines AS (
  SELECT request_id, section, pick, upper(book[1]) || lower(book[2:]) || ' ' || chapter || ':' || verse || ' - ' || trim(c.text, {_WS}) AS line
  FROM answers JOIN corpus c USING (verse_id))
SELECT request_id, string_agg(line, chr(10) || chr(10) ORDER BY section, pick) AS verses FROM lines GROUP BY request_id""")
def j08_citations(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = corpus(t).select("verse_id", "lang", "book", "emotion", "theme", "chapter", "verse", "text")
    index = recommend.store_index(rows, ["verse_id"], scratch_path(spark, "index"))
    answers = recommend.answer_from_store(requests(t), index, ["book", "chapter", "verse", "text"], ["verse_id"])
    return recommend.citations(answers).select("request_id", F.array_join("verses", "\n\n").alias("verses"))


@query("j09_transfer_corpus", f"""WITH {_SOURCE_SQL}, files AS (
  SELECT book_no, min('f' || conv_id % 40) AS file FROM target GROUP BY book_no)
SELECT conv_id, turn, coalesce({emotion_es_sql('emotion_en')}, '') AS emotion, last.doc_id IS NOT NULL AS matched
FROM target LEFT JOIN last USING (book_no, chapter, verse)
WHERE EXISTS (SELECT 1 FROM files WHERE files.book_no = target.book_no AND file = 'f' || target.conv_id % 40)
  AND book_no IN (SELECT book_no FROM src)""")
def j09_corpus(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = target(t).withColumn("file", F.concat(F.lit("f"), F.col("conv_id") % 40))
    moved, _ = J.transfer_corpus(rows, source(t).withColumn("file", F.lit("all")), ["doc_id"])
    return moved.select("conv_id", "turn", "emotion", "matched")
