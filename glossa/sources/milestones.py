"""Verses out of milestone XML.

A verse starts at ``<verse osisID=.../>`` and ends at ``<verse eID=.../>``, so no
element encloses its text. Each document is cut inside its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.labels import book_of_code
from glossa.functions.text import flatten_text, id_parts
from glossa.operators.aggregates import unknown_values
from glossa.plans.guard import once
from glossa.sources.pages import unescape

_SECTIONS = r"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|[^<]++|<"
_START = r"(?s)<(?:\w+:)?verse\b[^>]*?\bosisID\s*=\s*[\"']"
_ID = r"^[^\"']*"
_END = r"(?s)<(?:\w+:)?verse\b[^>]*?\beID\s*="


def read_documents(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """Whole XML documents, one per row, as (file, xml)."""
    return (spark.read.option("wholetext", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).text(path)
            .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("xml")))


def without_sections(xml: Column) -> Column:
    """Comments dropped and CDATA sections as escaped text, whichever of the two starts first."""
    tokens = F.regexp_extract_all(xml, F.lit(_SECTIONS), F.lit(0))

    def plain(t):
        inner = F.regexp_replace(F.substr(t, F.lit(10)), r"\]\]>$", "")
        escaped = F.replace(F.replace(F.replace(inner, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                            F.lit(">"), F.lit("&gt;"))
        return F.when(t.startswith("<!--"), "").when(t.startswith("<![CDATA["), escaped).otherwise(t)

    return F.when(F.contains(xml, F.lit("<!")), F.array_join(F.transform(tokens, plain), "")).otherwise(xml)


def milestone_segments(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Every start mark as (document columns, pos, osis_id, raw, closed).

    ``raw`` is the markup up to the verse's end mark; a start mark that meets
    another start mark first is not closed.
    """
    keep = [c for c in documents.columns if c != xml]
    pieces = documents.withColumn("_pieces", once(F.split(without_sections(F.col(xml)), _START, -1))).select(
        *keep, F.posexplode("_pieces").alias("pos", "_piece")).where("pos > 0")
    # what is left of a start tag, then its text; the end mark cuts the text
    text = F.substr("_piece", F.locate(">", F.col("_piece")) + 1)
    cut = pieces.withColumn("osis_id", F.regexp_extract("_piece", _ID, 0)).withColumn(
        "_parts", once(F.split(text, _END, 2)))
    return cut.select(*keep, "pos", "osis_id", F.get("_parts", F.lit(0)).alias("raw"),
                      (F.size("_parts") == 2).alias("closed"))


def milestone_text(raw: Column) -> Column:
    """Text of a segment in document order, tags read as blanks, whitespace collapsed."""
    spaced = F.regexp_replace(raw, r"<[^>]*>", " ")
    return flatten_text(unescape(spaced))


def parse_milestones(documents: DataFrame, xml: str = "xml", source_url: str = "") -> DataFrame:
    """Verse rows of all documents; invalid ids and unknown books are left out."""
    keep = [c for c in documents.columns if c != xml]
    parts = milestone_segments(documents, xml).where("closed").withColumn("_id", id_parts(F.col("osis_id")))
    return (parts.withColumn("book", book_of_code(F.get("_id", F.lit(0))))
            .where(F.col("book").isNotNull())
            .select(*keep, "pos", "book", F.get("_id", F.lit(1)).alias("chapter"),
                    F.get("_id", F.lit(2)).alias("verse"), F.lit("").alias("subtitle"),
                    milestone_text(F.col("raw")).alias("text"), F.lit(source_url).alias("source_url")))


def unknown_books(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Distinct unknown book codes of well-formed ids, in order."""
    codes = milestone_segments(documents, xml).select(
        F.get(id_parts(F.col("osis_id")), F.lit(0)).alias("code"))
    return unknown_values(codes, "code", book_of_code(F.col("code")).isNotNull())
