"""Numbering, ranking, sampling and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog.joins import SECTION_SQL
from glossa.catalog.registry import Tables, query
from glossa.catalog.roles import BOOKS_EN, CORPUS_SQL, VERSES_SQL, corpus, english_books, verses
from glossa.domains import BOOK_ORDER, EMOTIONS
from glossa.operators import annotate, filters, recommend, sampling, sets
from glossa.operators import transfer as J
from glossa.plans.ranking import first_per_group, sequential_id
from glossa.session import scratch_path
from glossa.sources.tables import canonical_books, write_stage


def rank_sql(seed, key: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY md5('{seed}|' || {key}), {key})"


@query("w01_ids_per_unit", f"WITH {VERSES_SQL} SELECT verse_id, row_number() OVER (PARTITION BY book ORDER BY chapter, verse) AS id FROM verses")
def w01(spark, sf_dir):
    v = verses(Tables(spark, sf_dir)).select("book", "chapter", "verse", "verse_id")
    return sequential_id(v, ["chapter", "verse"], ["book"]).select("verse_id", "id")


@query("w01_global_ids", f"WITH {CORPUS_SQL} SELECT row_number() OVER (ORDER BY book_no, chapter, verse) AS id, doc_id, text FROM corpus")
def w01_global(spark, sf_dir):
    c = corpus(Tables(spark, sf_dir)).select("doc_id", "book_no", "chapter", "verse", "text", F.lit(7).alias("id"))
    return sets.merge_corpus(c, ["book_no", "chapter", "verse"], key=["doc_id"]).select("id", "doc_id", "text")


@query("w02_last_wins", "SELECT source, lang, max(doc_id) AS doc_id FROM documents GROUP BY ALL")
def w02(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("source", "lang", "doc_id")
    return J.last_wins(docs, ["source", "lang"], ["doc_id"])


@query("w03_first_wins", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def w03(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("source", "lang", "doc_id")
    return J.first_wins(docs, ["source", "lang"], ["doc_id"])


@query("w04_first_per_class", f"""WITH {CORPUS_SQL} SELECT emotion, doc_id FROM corpus
QUALIFY row_number() OVER (PARTITION BY emotion ORDER BY doc_id) <= 10""")
def w04(spark, sf_dir):
    return first_per_group(corpus(Tables(spark, sf_dir)).select("emotion", "doc_id"), ["emotion"], ["doc_id"], 10)


_JOY_FAITH = "emotion = 'joy' AND list_contains(string_split(theme, ';'), 'faith') AND lang = 'en'"


@query("w07_per_section", f"""WITH {CORPUS_SQL} SELECT verse_id, {SECTION_SQL} AS section FROM corpus WHERE {_JOY_FAITH}
QUALIFY {rank_sql(0, 'verse_id', SECTION_SQL)} <= 2""")
def w07(spark, sf_dir):
    c = corpus(Tables(spark, sf_dir)).where("lang = 'en'")
    return recommend.recommend_by_section(c, "Joy", "faith").select("verse_id", "section")


@query("w08_recommend", f"""WITH {CORPUS_SQL} SELECT verse_id, text FROM corpus WHERE lang = 'es' AND emotion = 'Alegría'
AND list_contains(string_split(theme, ';'), 'amor') ORDER BY md5('0|' || verse_id), verse_id LIMIT 5""")
def w08(spark, sf_dir):
    c = corpus(Tables(spark, sf_dir)).where("lang = 'es'")
    return recommend.recommend(c, "joy", "love", "es").select("verse_id", "text")


@query("w08_recommend_stored", f"""WITH {CORPUS_SQL} SELECT verse_id, section FROM (SELECT *, {SECTION_SQL} AS section FROM corpus)
WHERE lang = 'es' AND emotion = 'Ira' AND list_contains(string_split(theme, ';'), 'fe') ORDER BY md5('0|' || verse_id), verse_id LIMIT 5""")
def w08_stored(spark, sf_dir):
    path = scratch_path(spark, "search")
    found = recommend.search_columns(corpus(Tables(spark, sf_dir)))
    write_stage(found.select("verse_id", "lang", "emotion_norm", "themes_norm", "section"), path, ["lang", "emotion_norm"])
    stored = spark.read.parquet(path).where("lang = 'es'")
    return recommend.recommend(stored, "anger", "Faith", "es").select("verse_id", "section")


@query("l01_sorted", f"WITH {VERSES_SQL} SELECT chapter, verse, book FROM verses ORDER BY chapter, verse")
def l01(spark, sf_dir):
    return verses(Tables(spark, sf_dir)).select("chapter", "verse", "book").orderBy("chapter", "verse")


@query("l02_file_order", """SELECT row_number() OVER (ORDER BY number NULLS LAST, name) AS id, name FROM (
SELECT DISTINCT CASE WHEN source = 'src9' THEN 'notes.csv' ELSE substr(source, 4) || '_' || lang || '.csv' END AS name,
  CASE WHEN source = 'src9' THEN NULL ELSE substr(source, 4)::INT END AS number FROM documents)""")
def l02(spark, sf_dir):
    from glossa.functions.text import file_prefix
    name = F.when(F.col("source") == "src9", "notes.csv").otherwise(
        F.concat(F.substr("source", F.lit(4)), F.lit("_"), "lang", F.lit(".csv")))
    files = Tables(spark, sf_dir).documents.select(name.alias("name")).distinct()
    return sequential_id(files, [file_prefix(F.col("name")).asc_nulls_last(), F.col("name")]).select("id", "name")


@query("l03_exact_sample", f"SELECT doc_id, text FROM documents QUALIFY {rank_sql(16, 'doc_id')} <= 300")
def l03(spark, sf_dir):
    return sampling.sample_exact(Tables(spark, sf_dir).documents, 300, ["doc_id"], 16).select("doc_id", "text")


@query("l04_shuffle", "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id")
def l04(spark, sf_dir):
    return sampling.shuffle_rows(Tables(spark, sf_dir).documents, ["doc_id"], 42).select("doc_id")


@query("l05_head", "SELECT doc_id, lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def l05(spark, sf_dir):
    return sampling.head(Tables(spark, sf_dir).documents, 10, [F.desc("n_chars"), "doc_id"]).select("doc_id", "lang")


@query("l06_request_audit", """SELECT source, 50 AS requested, count(*) AS available, least(50, count(*)) AS delivered, count(*) < 50 AS short
FROM documents GROUP BY source""")
def l06(spark, sf_dir):
    return sampling.request_audit(Tables(spark, sf_dir).documents, 50, "source")


@query("l07_canonical_order", f"""WITH {CORPUS_SQL} SELECT list_position({BOOK_ORDER}, book)::INT AS book_no, book, count(*) AS n
FROM (SELECT {BOOKS_EN}[book_no + 1] AS book FROM corpus) GROUP BY ALL ORDER BY 1""")
def l07(spark, sf_dir):
    counts = english_books(corpus(Tables(spark, sf_dir))).groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(canonical_books(spark)), "book").select("book_no", "book", "n").orderBy("book_no")


@query("u01_union_all", """SELECT doc_id, text, lang, NULL::BIGINT AS item_id FROM documents
UNION ALL SELECT NULL, text, NULL, item_id FROM benchmark""")
def u01(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sets.union_all([t.documents.select("doc_id", "text", "lang"), t.benchmark.where("false"), t.benchmark])


@query("u02_domain_difference", f"WITH {CORPUS_SQL} SELECT DISTINCT emotion FROM corpus WHERE emotion NOT IN {tuple(EMOTIONS[:3])}")
def u02(spark, sf_dir):
    return filters.outside_domain(corpus(Tables(spark, sf_dir)).select("emotion"), "emotion", EMOTIONS[:3])


_A, _B = "string_split(coalesce(theme_en, ''), ';')", "CASE WHEN doc_id % 2 = 0 THEN ['love', 'hope'] ELSE ['faith', 'grace'] END"


@query("u03_row_sets", f"""WITH {CORPUS_SQL} SELECT doc_id,
  array_to_string(list_sort(list_intersect(list_filter({_A}, lambda x: x <> ''), {_B})), ';') AS both,
  array_to_string(list_sort(list_distinct(list_concat(list_filter({_A}, lambda x: x <> ''), {_B}))), ';') AS either FROM corpus0""")
def u03(spark, sf_dir):
    from glossa.catalog.roles import themes_of
    from glossa.functions.labels import split_labels
    mine = split_labels(themes_of(F.col("n_chars")))
    other = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("love"), F.lit("hope"))).otherwise(
        F.array(F.lit("faith"), F.lit("grace")))
    return Tables(spark, sf_dir).documents.select(
        "doc_id", F.array_join(F.array_sort(F.array_intersect(mine, other)), ";").alias("both"),
        F.array_join(F.array_sort(F.array_union(mine, other)), ";").alias("either"))


@query("u04_missing_units", f"""WITH {CORPUS_SQL} SELECT list_position({BOOK_ORDER}, b)::INT AS book_no, b AS book
FROM (SELECT unnest({BOOK_ORDER}) AS b) WHERE b NOT IN (SELECT {BOOKS_EN}[book_no + 1] FROM corpus)""")
def u04(spark, sf_dir):
    return sets.missing_units(canonical_books(spark), english_books(corpus(Tables(spark, sf_dir))), "book")


@query("u05_combine_rounds", """WITH r AS (
  SELECT md5(text) AS verse_id, 1 AS round, doc_id AS pos FROM documents WHERE lang <> 'en'
  UNION ALL SELECT md5(text), 2, doc_id FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT md5(text), 3, item_id FROM benchmark),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY verse_id ORDER BY round, pos) = 1)
SELECT row_number() OVER (ORDER BY round, pos) - 1 AS id, verse_id, round, pos FROM f""")
def u05(spark, sf_dir):
    t = Tables(spark, sf_dir)
    docs = t.documents.select(F.md5("text").alias("verse_id"), F.col("doc_id").alias("pos"), "lang")
    rounds = [docs.where("lang <> 'en'").drop("lang"), docs.where("pos % 3 = 0").drop("lang"),
              t.benchmark.select(F.md5("text").alias("verse_id"), F.col("item_id").alias("pos"))]
    return sets.combine_rounds(rounds, "verse_id", ["pos"]).select("id", "verse_id", "round", "pos")


@query("l03_select_for_annotation", """WITH u AS (
  SELECT 'v' || (doc_id // 2) AS verse_id, arg_min(text, doc_id) AS verse FROM documents GROUP BY 1),
left_ AS (SELECT * FROM u WHERE verse_id NOT IN (SELECT 'v' || doc_id FROM labels))
SELECT id - 1 AS id, verse_id, verse FROM (SELECT *, row_number() OVER (ORDER BY md5('16|' || verse_id), verse_id) AS id FROM left_) WHERE id <= 200""")
def l03_annotation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.documents.select(F.concat(F.lit("v"), F.expr("doc_id div 2")).alias("verse_id"), "text", "doc_id")
    known = t.labels.select(F.concat(F.lit("v"), "doc_id").alias("verse_id"))
    return annotate.select_for_annotation(rows, 200, known, 16, ["doc_id"])


@query("m11_stratified_folds", f"SELECT doc_id, lang, (({rank_sql(42, 'doc_id', 'lang')} - 1) % 5)::INT AS fold FROM documents")
def m11(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("doc_id", "lang")
    return sampling.stratified_folds(docs, "lang", ["doc_id"], 5, 42)


@query("m12_train_test_split", f"""SELECT doc_id, CASE WHEN {rank_sql(42, 'doc_id')} <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'test' END AS split
FROM documents""")
def m12(spark, sf_dir):
    return sampling.train_test_split(Tables(spark, sf_dir).documents.select("doc_id"), ["doc_id"], 0.9, 42)


@query("m13_oversample", f"""WITH ranked AS (SELECT doc_id, quality, {rank_sql(7, 'doc_id', 'quality')} AS rank,
    count(*) OVER (PARTITION BY quality) AS n FROM labels),
sizes AS (SELECT quality, count(*) AS n, max(count(*)) OVER () AS most FROM labels GROUP BY quality),
draws AS (SELECT quality, n, unnest(range(most)) AS draw FROM sizes),
drawn AS (SELECT quality, ('0x' || substr(md5('7|' || quality || '|' || draw), 1, 12))::BIGINT % n + 1 AS rank FROM draws)
SELECT doc_id, quality, (row_number() OVER (PARTITION BY doc_id) - 1)::BIGINT AS copy FROM drawn JOIN ranked USING (quality, rank)""")
def m13(spark, sf_dir):
    rows = Tables(spark, sf_dir).labels.select("doc_id", "quality")
    return sampling.oversample(rows, "quality", ["doc_id"], 7)
