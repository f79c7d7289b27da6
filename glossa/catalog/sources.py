"""Source and sink queries (S01-S15): written from all rows, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from glossa import schemas
from glossa.catalog.registry import Tables, query
from glossa.catalog.roles import BOOKS_EN, BOOKS_ES, CORPUS_SQL, LABELED_SQL, corpus, english_books, labeled, literal
from glossa.domains import BOOK_ORDER, CODE_TO_BOOK
from glossa.functions.text import WHITESPACE
from glossa.operators.evaluate import error_examples
from glossa.operators.filters import valid_row
from glossa.session import scratch_path
from glossa.sources import milestones, pages, tables

_WS = literal(WHITESPACE)


def raw_frame(t: Tables):
    """Documents as raw verse rows."""
    return t.documents.select(
        F.col("source").alias("book"), F.col("doc_id").alias("chapter"), F.col("n_chars").alias("verse"),
        F.lit(None).cast("string").alias("subtitle"), "text", F.concat(F.lit("http://x/"), "lang").alias("source_url"))


_RAW_SQL = """SELECT source AS book, doc_id::VARCHAR AS chapter, n_chars::VARCHAR AS verse, NULL::VARCHAR AS subtitle,
  text, 'http://x/' || lang AS source_url FROM documents"""


@query("s01_read_csv", _RAW_SQL)
def s01(spark, sf_dir):
    path = scratch_path(spark, "raw")
    tables.write_csv(raw_frame(Tables(spark, sf_dir)), path)
    return tables.read_csv(spark, path, schemas.RAW)


@query("s02_recursive_read", _RAW_SQL)
def s02(spark, sf_dir):
    path = scratch_path(spark, "raw")
    df = raw_frame(Tables(spark, sf_dir)).withColumn("part", F.substr("source_url", F.lit(10)))
    tables.write_csv(df, path, partition_by=["part"])
    return tables.read_csv(spark, path, schemas.RAW, recursive=True)


@query("s03_load_corpus", f"""WITH {CORPUS_SQL} SELECT doc_id::INT AS id, book, chapter::INT AS chapter, verse::INT AS verse,
  verse_id, text, theme, emotion, lang AS corpus FROM corpus""")
def s03(spark, sf_dir):
    t = Tables(spark, sf_dir)
    base, read = scratch_path(spark, "labeled"), []
    for lang in ("en", "es"):
        frame = corpus(t).where(F.col("lang") == lang).select(
            F.col("doc_id").alias("id"), "book", "chapter", "verse", F.lit(None).cast("string").alias("subtitle"), "text",
            "verse_id", F.lit(None).cast("string").alias("source_url"), "theme", "emotion")
        folder = tables.corpus_folder(base, lang)
        tables.write_csv(frame, folder)
        read.append(tables.load_corpus(spark, folder, files="part-*.csv").select(
            "id", "book", "chapter", "verse", "verse_id", "text", "theme", "emotion", F.lit(lang).alias("corpus")))
    return read[0].unionByName(read[1])


@query("s04_read_headerless", "SELECT doc_id::VARCHAR AS id, 'd' || doc_id AS verse_id, quality::VARCHAR AS label FROM labels")
def s04(spark, sf_dir):
    path = scratch_path(spark, "answers")
    rows = Tables(spark, sf_dir).labels.select("doc_id", F.concat(F.lit("d"), "doc_id"), "quality")
    rows.write.option("header", False).csv(path)
    return tables.read_csv(spark, path, schemas.ANNOTATION, header=False)


_CODES = [*CODE_TO_BOOK, "Fake"]


def osis_documents(t: Tables):
    """Each document as one XML text: every line a verse, some with bad ids, in CDATA or in a comment."""
    def marked(line):
        escaped = F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                            F.lit(">"), F.lit("&gt;"))
        return F.replace(escaped, F.lit(", "), F.lit(' <note n="1">,</note> '))

    code = F.get(F.array(*[F.lit(c) for c in _CODES]), (F.col("doc_id") % len(_CODES)).cast("int"))

    def verse(line, i):
        osis = F.when(i % 7 == 6, code).otherwise(F.concat_ws(".", code, F.col("doc_id"), i + 1))
        opened, closed = F.concat(F.lit('<verse osisID="'), osis, F.lit('" sID="s"/>')), F.lit('<verse eID="s"/>\n')
        section = F.concat(F.lit("<![CDATA["), F.replace(line, F.lit("]]>"), F.lit("")), F.lit("]]>"))
        return F.when(i % 5 == 3, F.concat(F.lit("<!-- "), opened, F.lit("hidden"), closed, F.lit("-->"))).otherwise(
            F.concat(opened, F.when(i % 4 == 1, section).otherwise(marked(line)), closed))

    body = F.array_join(F.transform(F.split("text", "\n", -1), verse), "")
    return t.spread("documents").select("doc_id", F.concat(F.lit("<osis><div>"), body, F.lit("</div></osis>")).alias("xml"))


_VERSES_OF_LINES = f"""WITH lines AS (
  SELECT doc_id, {_CODES}[(doc_id % {len(_CODES)})::INT + 1] AS code, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, {list(CODE_TO_BOOK.values())}[list_position({list(CODE_TO_BOOK)}, code)] AS book, doc_id::VARCHAR AS chapter,
  i::VARCHAR AS verse, trim(regexp_replace(CASE WHEN (i - 1) % 4 = 1 THEN replace(line, ']]>', '')
    ELSE replace(line, ', ', ' , ') END, '\\s+', ' ', 'g')) AS text
FROM lines WHERE code <> 'Fake' AND (i - 1) % 7 <> 6 AND (i - 1) % 5 <> 3"""


@query("s05_milestones", _VERSES_OF_LINES)
def s05(spark, sf_dir):
    return milestones.parse_milestones(osis_documents(Tables(spark, sf_dir))).select(
        "doc_id", "book", "chapter", "verse", "text")


@query("s05_documents_from_files", f"SELECT book, chapter, verse, text FROM ({_VERSES_OF_LINES})")
def s05_files(spark, sf_dir):
    path = scratch_path(spark, "xml")
    osis_documents(Tables(spark, sf_dir)).select("xml").write.text(path)
    return milestones.parse_milestones(milestones.read_documents(spark, path, "part-*")).select("book", "chapter", "verse", "text")


@query("s05_unknown_books", f"""SELECT DISTINCT 'Fake' AS code FROM documents
WHERE {_CODES}[(doc_id % {len(_CODES)})::INT + 1] = 'Fake'""")
def s05_unknown(spark, sf_dir):
    return milestones.unknown_books(osis_documents(Tables(spark, sf_dir)))


def chapter_pages(t: Tables):
    """Stored pages as chapter pages: every paragraph a numbered text, some numbers bad, some breaks missing.

    Some texts hold a nested span, some attributes have no quotes, some marks are
    commented out, and a footer behind the content element looks like a verse.
    """
    def paragraph(part, i):
        heading = F.when(i % 3 == 0, F.concat(F.lit('<h2 class="estudio">H'), i, F.lit("</h2>"))).otherwise("")
        number = F.when(i % 5 == 4, F.lit("A")).otherwise(i.cast("string"))
        text = F.translate(F.regexp_replace(part, "<[^>]*>", ""), "<>", "")
        line = F.when(i % 4 != 2, F.lit("<br/>")).otherwise("")
        nested = F.when(i % 3 == 1, F.concat(F.lit("<span>"), text, F.lit("</span> end"))).otherwise(text)
        hidden = F.when(i % 6 == 5, F.lit('<!-- <span class="versiculo">9</span><span class="texto">x</span><br> -->')).otherwise("")
        opened = F.when(i % 2 == 0, F.lit('</span><span class="texto">')).otherwise(F.lit("</span><SPAN id=a class=texto>"))
        return F.concat(heading, F.lit('<div><span class="versiculo">'), number, opened, nested, F.lit("</span></div>"), hidden, line)

    body = F.array_join(F.transform(F.split("html", "<p>", -1), paragraph), "")
    return t.spread("pages").select("page_id", F.concat(F.lit('<p><div class="col_i_1_1_inf">'), body, F.lit(
        '</div><div><span class="versiculo">99</span><span class="texto">footer</span><br></div>')).alias("html"))


_UNESCAPE = "{0}"
for _name, _char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&")):
    _UNESCAPE = f"replace({_UNESCAPE}, '{_name}', '{_char}')"

_CHAPTERS_SQL = f"""parts AS (
  SELECT page_id, unnest(string_split(html, '<p>')) AS part, generate_subscripts(string_split(html, '<p>'), 1) - 1 AS i FROM pages),
tokens AS (SELECT page_id, i, trim({_UNESCAPE.format("translate(regexp_replace(part, '<[^>]*>', '', 'g'), '<>', '')")}
    || CASE WHEN i % 3 = 1 THEN ' end' ELSE '' END, {_WS}) AS text,
  i % 5 <> 4 AS valid, i % 4 <> 2 AS brk FROM parts),
grouped AS (SELECT *, sum(valid::INT) OVER (PARTITION BY page_id ORDER BY i) AS g FROM tokens),
opened AS (SELECT *, coalesce(max(brk::INT) OVER (PARTITION BY page_id, g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed,
  max(g) OVER (PARTITION BY page_id) AS last_g FROM grouped),
verses AS (SELECT page_id, g, min(i) AS verse, max(brk::INT) AS brk, max(last_g) AS last_g,
    string_agg(text, chr(10) ORDER BY i) FILTER (WHERE closed = 0 AND text <> '') AS text FROM opened GROUP BY 1, 2)"""


@query("s06_parse_pages", f"""WITH {_CHAPTERS_SQL}
SELECT page_id, (g - 1)::INT AS pos, verse::INT AS verse, 'H' || (verse - verse % 3) AS subtitle, text FROM verses
WHERE text IS NOT NULL AND (brk = 1 OR g = last_g)""")
def s06(spark, sf_dir):
    return pages.parse_pages(chapter_pages(Tables(spark, sf_dir)))


@query("s06_page_audit", f"""WITH {_CHAPTERS_SQL}
SELECT page_id, true AS has_content, count(*)::INT AS numbers, count(*) FILTER (WHERE NOT valid)::INT AS bad_numbers
FROM tokens GROUP BY page_id""")
def s06_audit(spark, sf_dir):
    return pages.page_audit(chapter_pages(Tables(spark, sf_dir)))


@query("w05_running_subtitle", f"""WITH {_CHAPTERS_SQL}
SELECT 'H' || (verse - verse % 3) AS subtitle, count(*) AS verses FROM verses
WHERE text IS NOT NULL AND (brk = 1 OR g = last_g) GROUP BY 1""")
def w05(spark, sf_dir):
    return pages.parse_pages(chapter_pages(Tables(spark, sf_dir))).groupBy("subtitle").agg(
        F.count(F.lit(1)).alias("verses"))


@query("w06_open_verses", f"""WITH {_CHAPTERS_SQL}
SELECT page_id, count(*) AS verses, min(verse)::INT AS first_verse, max(verse)::INT AS last_verse,
  sum(length(text))::BIGINT AS chars FROM verses
WHERE text IS NOT NULL AND (brk = 1 OR g = last_g) GROUP BY 1""")
def w06(spark, sf_dir):
    return pages.parse_pages(chapter_pages(Tables(spark, sf_dir))).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("verses"), F.min("verse").alias("first_verse"), F.max("verse").alias("last_verse"),
        F.sum(F.length("text")).alias("chars"))


_LINKS = pages.OptionLayout(listing=r"(?is)<nav>(.*?)</nav>", item=r'(?is)<a href="[^"]*">[^<]*',
                            value=r'(?is)href="/([^"]*)"')


@query("s07_parse_options", f"""WITH items AS (
  SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*')) AS item,
    generate_subscripts(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*'), 1) - 1 AS i
  FROM pages)
SELECT page_id, i::INT AS index, regexp_extract(item, 'href="/([^"]*)"', 1) AS id,
  trim(regexp_replace(item, '<[^>]*>', '', 'g')) AS name FROM items""")
def s07(spark, sf_dir):
    return pages.parse_options(Tables(spark, sf_dir).pages.select("page_id", "html"), _LINKS)


@query("s07_book_list", """WITH nav AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*') AS items FROM pages),
items AS (SELECT page_id, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM nav)
SELECT page_id, i::INT AS index, regexp_extract(item, 'href="/([^"]*)"', 1) AS id, trim(regexp_replace(item, '<[^>]*>', '', 'g')) AS name
FROM items WHERE regexp_extract(item, 'href="/([^"]*)"', 1) <> '0'""")
def s07_books(spark, sf_dir):
    """The pages' links as the book list of a search form: another list before it, and a first option of value 0."""
    links = F.regexp_extract("html", "<nav>(.*?)</nav>", 1)
    for old, new in (('<a href="/', '<OPTION class="b" value="'), ("</a>", " </OPTION>")):
        links = F.replace(links, F.lit(old), F.lit(new))
    form = F.concat(F.lit('<form><select name="cap"><option value="7">no</option></select>\n<select id="x" name="libro">'
                          '<option value="0">Elige un libro</option>'), links, F.lit("</select></form>"))
    return pages.parse_options(Tables(spark, sf_dir).pages.select("page_id", form.alias("html")))


@query("s08_quoted_csv", f"""WITH {CORPUS_SQL}
SELECT '"' || doc_id || '","' || book || '","' || coalesce(theme, '') || '","say ' || repeat('"', 2) || lang || repeat('"', 3)
  AS line FROM corpus""")
def s08(spark, sf_dir):
    path = scratch_path(spark, "quoted")
    rows = corpus(Tables(spark, sf_dir)).select(
        "doc_id", "book", "theme", F.concat(F.lit('say "'), "lang", F.lit('"')).alias("note"))
    tables.write_csv(rows, path)
    return spark.read.text(path).where(
        F.col("value") != '"doc_id","book","theme","note"').withColumnRenamed("value", "line")


@query("s09_write_stage", f"WITH {CORPUS_SQL} SELECT lang AS corpus, book_no, count(*) AS n, sum(length(text))::BIGINT AS chars FROM corpus GROUP BY ALL")
def s09(spark, sf_dir):
    path = scratch_path(spark, "stage")
    rows = corpus(Tables(spark, sf_dir)).withColumnRenamed("lang", "corpus")
    tables.write_stage(rows.select("corpus", "book_no", "verse_id", "text"), path)
    return spark.read.parquet(path).groupBy("corpus", "book_no").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s10_new_units", f"WITH {CORPUS_SQL} SELECT doc_id FROM corpus WHERE NOT (lang = 'en' AND book_no < 10)")
def s10(spark, sf_dir):
    rows = corpus(Tables(spark, sf_dir))
    done = rows.where("lang = 'en' AND book_no < 10").select("lang", "book_no")
    return tables.new_units(rows, done, ["lang", "book_no"]).select("doc_id")


def _mixed_files(spark, t: Tables) -> str:
    """Files with all columns, with columns in another order, and without the text column."""
    path = scratch_path(spark, "mixed")
    raw = raw_frame(t)
    third = F.col("chapter") % 3
    tables.write_csv(raw.where(third == 0), path + "/a")
    tables.write_csv(raw.where(third == 1).select("text", "verse", "chapter", "book"), path + "/b", quote_all=False)
    tables.write_csv(raw.where(third == 2).drop("text"), path + "/c")
    return path


@query("s11_checked_read", """SELECT source AS book, doc_id::VARCHAR AS chapter, n_chars::VARCHAR AS verse,
  NULL::VARCHAR AS subtitle, text, CASE WHEN doc_id % 3 = 0 THEN 'http://x/' || lang END AS source_url
FROM documents WHERE doc_id % 3 < 2""")
def s11(spark, sf_dir):
    return tables.read_checked(spark, _mixed_files(spark, Tables(spark, sf_dir))).rows.drop("file")


@query("s14_session_audit", """SELECT count(*) FILTER (WHERE doc_id % 3 < 2)::BIGINT AS rows,
  count(*) FILTER (WHERE doc_id % 3 < 2 AND doc_id > 0)::BIGINT AS kept,
  count(*) FILTER (WHERE doc_id = 0)::BIGINT AS removed FROM documents""")
def s14(spark, sf_dir):
    checked = tables.read_checked(spark, _mixed_files(spark, Tables(spark, sf_dir)))
    kept = valid_row(F.col("book"), F.col("chapter"), F.col("verse"))
    return tables.session_summary(tables.audit_files(checked, kept)).select("rows", "kept", "removed")


_WIDTH = 9
_VERSES_SQL = ", ".join(f"CASE WHEN event_id % 2 = 0 AND event_id % {_WIDTH} >= {i - 1} THEN 'v{i}-' || event_id ELSE '' END AS versiculo_{i}"
                        for i in range(1, _WIDTH + 1))


@query("s12_feedback", f"SELECT user_id, event_type AS feedback, {_VERSES_SQL}, event_id FROM events")
def s12(spark, sf_dir):
    events, path = Tables(spark, sf_dir).events, scratch_path(spark, "feedback")
    base = events.select("event_id", "user_id", F.col("event_type").alias("feedback"), F.transform(
        F.sequence(F.lit(1), (F.col("event_id") % _WIDTH).cast("int") + 1),
        lambda i: F.concat(F.lit("v"), i, F.lit("-"), F.col("event_id"))).alias("verses"))
    tables.append_feedback(base.where("event_id % 2 = 1").drop("verses"), path)
    tables.append_feedback(tables.feedback_rows(base.where("event_id % 2 = 0")), path)
    return tables.read_feedback(spark, path)


_FOUND = ", ".join(literal(b) for b in BOOKS_EN)


@query("s13_write_books", f"""WITH {CORPUS_SQL} SELECT list_position({BOOK_ORDER}, book)::INT AS book_no, book, count(*) AS n
FROM (SELECT {BOOKS_EN}[book_no + 1] AS book FROM corpus) GROUP BY ALL UNION ALL
SELECT list_position({BOOK_ORDER}, b)::INT, b, 0 FROM (SELECT unnest({BOOK_ORDER}) AS b) WHERE b NOT IN (
  SELECT {BOOKS_EN}[book_no + 1] FROM corpus)""")
def s13(spark, sf_dir):
    path = scratch_path(spark, "books")
    missing = tables.write_books(english_books(corpus(Tables(spark, sf_dir))).drop("book_no"), path)
    counts = spark.read.parquet(path).groupBy("book_no", "book").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(missing.withColumn("n", F.lit(0).cast("bigint")))


@query("s15_error_export", f"""WITH {LABELED_SQL}, wrong AS (
  SELECT doc_id, pred AS label, 'false_positive' AS error_type FROM labeled WHERE lang <> pred
  UNION ALL SELECT doc_id, lang, 'false_negative' FROM labeled WHERE lang <> pred)
SELECT label, error_type, doc_id FROM wrong QUALIFY row_number() OVER (PARTITION BY label, error_type ORDER BY doc_id) <= 10""")
def s15(spark, sf_dir):
    path = scratch_path(spark, "errors")
    found = error_examples(labeled(Tables(spark, sf_dir)), "lang", "pred", ["doc_id"])
    tables.write_error_examples(found.select("doc_id", "label", "error_type"), path)
    schema = StructType([StructField("doc_id", LongType()), StructField("label", StringType()),
                         StructField("error_type", StringType())])
    return spark.read.schema(schema).option("header", True).csv(path).select("label", "error_type", "doc_id")
