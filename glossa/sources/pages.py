"""Rows out of stored HTML pages.

A page is taken apart inside its own row: it is cut at the number marks, and
headings are counted per piece, so no token is shuffled or sorted.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.labels import literal_map
from glossa.functions.scores import let
from glossa.functions.text import strip
from glossa.plans.guard import once

_NAMED = {name: chr(code) for name, code in name2codepoint.items()}
_REFERENCE = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _character(name: Column) -> Column:
    """Character of a reference name such as ``amp``, ``#233`` or ``#xE9``; null when unknown."""
    digits = F.when(name.rlike("^#[xX]"), F.substr(name, F.lit(3))).when(
        name.startswith("#"), F.conv(F.substr(name, F.lit(2)), 10, 16))
    code = F.when((F.length(digits) > 0) & (F.conv(digits, 16, 10).cast("bigint") <= 0x10FFFF), digits)
    return F.coalesce(F.try_element_at(literal_map(_NAMED), name),
                      F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))


def unescape(c: Column) -> Column:
    """Character references resolved once; unknown ones stay."""
    def resolve(x):
        return let(F.regexp_extract(x, r"^&([^;\s&]+);", 1), lambda name: F.when(
            name != "", F.concat(_character(name), F.substr(x, F.length(name) + 3))))

    def piece(x):
        return F.when(x.startswith("&"), F.coalesce(resolve(x), x)).otherwise(x)

    return let(c, lambda text: F.when(
        F.contains(text, F.lit("&")),
        F.array_join(F.transform(F.split(text, f"(?={_REFERENCE})", -1), piece), "")).otherwise(text))


def plain_text(html: Column) -> Column:
    """Markup removed, then character references resolved."""
    return unescape(F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", ""))


def _tag(name: str, css: str) -> str:
    """Opening tag of an element with a class, whether its value is quoted or not."""
    value = rf"(?:\"(?:[^\"]*\s)?{css}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{css}(?:\s[^']*)?'|{css}(?=[\s/>]))"
    return rf"<{name}\b[^>]*\bclass\s*=\s*{value}[^>]*>"


@dataclass(frozen=True)
class PageLayout:
    """Patterns of a page's marks; each whole element is one match, content in group 1.

    ``content`` is the opening tag of the element ``content_name`` that holds the marks.
    """

    content: str = rf"(?is){_tag('div', 'col_i_1_1_inf')}"
    content_name: str = "div"
    heading: str = rf"(?is){_tag('h2', 'estudio')}(.*?)</h2>"
    number: str = rf"(?is){_tag('span', 'versiculo')}(.*?)</span>"
    text: str = rf"(?is){_tag('span', 'texto')}(.*?)</span>"
    line_break: str = r"(?is)<br\b[^>]*>"

    def mark(self) -> str:
        """Opening tags of number and text marks."""
        return "(?is)" + "|".join(p.removeprefix("(?is)").split("(.*?)")[0] for p in (self.number, self.text))


def _is(piece: Column, tag: str) -> Column:
    """Whether a piece of a page begins with a tag such as ``<div`` or ``</div``."""
    return F.lower(F.substr(piece, F.lit(1), F.lit(len(tag)))) == tag


def _element(rest: Column, name: str) -> Column:
    """What follows an opening tag, up to its own closing tag (or to the end, when none closes it)."""
    step = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("count"))

    def walk(acc, piece):
        depth = acc["depth"] + F.when(_is(piece, f"<{name}"), 1).when(_is(piece, f"</{name}"), -1).otherwise(0)
        return F.when(acc["depth"] == 0, acc).otherwise(
            F.struct(depth.alias("depth"), (acc["count"] + F.when(depth > 0, 1).otherwise(0)).alias("count")))

    return let(F.split(rest, rf"(?i)(?=</?{name}[\s/>])", -1), lambda pieces: F.array_join(F.slice(
        pieces, F.lit(1), F.aggregate(pieces, step, walk, lambda acc: acc["count"])), ""))


def _flat_marks(body: Column, layout: PageLayout) -> Column:
    """Elements nested in number and text marks lose their span tags, so that a mark ends at its own tag."""
    mark = layout.mark()
    state = F.struct(F.lit(0).alias("depth"), F.lit([]).cast("array<boolean>").alias("drop"))

    def walk(acc, piece):
        opens, closes, depth = _is(piece, "<span"), _is(piece, "</span"), acc["depth"]
        now = (F.when(opens & (depth > 0), depth + 1).when(opens & piece.rlike("^" + mark.replace("(?is)", "(?is)(?:", 1) + ")"), 1)
               .when(closes & (depth > 0), depth - 1).otherwise(depth))
        inner = (opens & (depth > 0)) | (closes & (depth > 1))
        return F.struct(now.cast("int").alias("depth"), F.concat(acc["drop"], F.array(inner)).alias("drop"))

    def flat(pieces):
        drop = F.aggregate(pieces, state, walk, lambda acc: acc["drop"])
        return F.array_join(F.zip_with(pieces, drop, lambda piece, inner: F.when(
            inner, F.regexp_replace(piece, "^<[^>]*>", "")).otherwise(piece)), "")

    return let(F.split(body, r"(?i)(?=</?span[\s/>])", -1), flat)


def content(html: Column, layout: PageLayout) -> Column:
    """Inside of a page's content element, without comments and with flat marks; null without one."""
    clean = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    return let(F.split(clean, layout.content, 2), lambda parts: F.when(
        F.size(parts) == 2, _flat_marks(_element(F.get(parts, F.lit(1)), layout.content_name), layout)))


def _ungroup(pattern: str) -> str:
    """Pattern body without flags, its content group made non-capturing."""
    return pattern.removeprefix("(?is)").replace("(.*?)", "(?:.*?)")


def parse_pages(pages: DataFrame, layout: PageLayout = PageLayout(), html: str = "html") -> DataFrame:
    """Verses of each page as (page columns, pos, verse, subtitle, text).

    Rules: a number mark opens a verse; text marks belong to the open verse; a
    break closes it; a second number before a break discards the first verse; a
    mark whose number is not an integer is as if absent; the last verse may
    stay open; verses without text are dropped; the subtitle is the last heading
    before the number mark. Only the content element up to its own end tag
    counts, comments do not, and spans nested in a mark belong to it.
    """
    number, heading = layout.number, layout.heading
    body = content(F.col(html), layout)
    # number marks without an integer vanish, so their text joins the verse that is open
    bad_number = "(?is)" + _bad_numbers(number)
    clean = F.regexp_replace(body, bad_number, "")

    # every block repeats its heading once per number mark it holds
    subtitles = F.flatten(F.zip_with(
        "_blocks", "_headings",
        lambda block, title: F.array_repeat(title, F.regexp_count(block, F.lit(number)).cast("int"))))

    keep = [c for c in pages.columns if c != html]
    cut = (pages.select(*keep, once(clean).alias("_clean"))
           .withColumn("_numbers", F.regexp_extract_all("_clean", F.lit(number), F.lit(1)))
           .withColumn("_blocks", F.split("_clean", _split_at(heading), -1))
           .withColumn("_headings", F.concat(F.array(F.lit("")),
                                             F.regexp_extract_all("_clean", F.lit(heading), F.lit(1))))
           .withColumn("_pieces", F.slice(F.split("_clean", _split_at(number), -1), F.lit(2), F.size("_numbers")))
           .withColumn("_subtitles", subtitles)
           .withColumn("_rows", once(F.arrays_zip("_numbers", "_subtitles", "_pieces"))))
    verses = cut.select(*keep, (F.size("_rows") - 1).alias("_last"), F.posexplode("_rows").alias("pos", "_v"))

    marks = F.regexp_extract_all("_piece", F.lit(f"(?is){_ungroup(layout.text)}|{_ungroup(layout.line_break)}"),
                                 F.lit(0))
    closing = F.array_position(F.transform("_marks", lambda m: m.rlike(layout.line_break)), True).cast("int")
    kept_marks = F.when(F.col("_closing") > 0, F.slice("_marks", F.lit(1), F.col("_closing"))).otherwise(
        F.col("_marks"))
    texts = F.transform(F.filter(kept_marks, lambda m: m.rlike(layout.text)),
                        lambda m: strip(plain_text(m)))
    text = F.array_join(F.filter(texts, lambda t: t != ""), "\n")
    return (verses.withColumn("_piece", F.col("_v._pieces")).withColumn("_marks", once(marks))
            .withColumn("_closing", closing)
            .where((F.col("_closing") > 0) | (F.col("pos") == F.col("_last")))
            .select(*keep, "pos", strip(plain_text(F.col("_v._numbers"))).try_cast("int").alias("verse"),
                    strip(plain_text(F.col("_v._subtitles"))).alias("subtitle"), once(text).alias("text"))
            .where("text != ''"))


def page_audit(pages: DataFrame, layout: PageLayout = PageLayout(), html: str = "html") -> DataFrame:
    """Per page whether it has content, its number marks, and those without an integer."""
    keep = [c for c in pages.columns if c != html]
    body = F.coalesce("_body", F.lit(""))
    return pages.select(*keep, once(content(F.col(html), layout)).alias("_body")).select(
        *keep, F.col("_body").isNotNull().alias("has_content"),
        F.regexp_count(body, F.lit(layout.number)).alias("numbers"),
        F.regexp_count(body, F.lit("(?is)" + _bad_numbers(layout.number))).alias("bad_numbers"))


def _split_at(pattern: str) -> str:
    return "(?is)" + _ungroup(pattern)


def _bad_numbers(number: str) -> str:
    """Number marks whose content is not an optionally signed integer."""
    head, tail = number.removeprefix("(?is)").split("(.*?)")
    blank = r"(?:[\s\x{85}\p{Z}]++|&nbsp;|<(?!/span)[^>]*+>)*+"  # possessive: a long run needs no stack
    return rf"{head}(?!{blank}[+-]?\d+{blank}{tail})(?:.*?){tail}"


@dataclass(frozen=True)
class OptionLayout:
    """Patterns of an option list: the list's inside, one item, an item's value."""

    listing: str = r"(?is)<select\b[^>]*\bname\s*=\s*[\"']libro[\"'][^>]*>(.*?)</select>"
    item: str = r"(?is)<option\b[^>]*?\bvalue\s*=\s*[\"'][^\"']*[\"'][^>]*>[^<]*"
    value: str = r"(?is)\bvalue\s*=\s*[\"']([^\"']*)[\"']"


def parse_options(pages: DataFrame, layout: OptionLayout = OptionLayout(), html: str = "html") -> DataFrame:
    """Options of the listed elements as (page columns, index, id, name).

    The index counts all options from 0; options with value ``0`` are left out.
    """
    keep = [c for c in pages.columns if c != html]
    listing = F.regexp_extract(html, layout.listing, 1)
    found = pages.select(*keep, F.posexplode(F.regexp_extract_all(listing, F.lit(layout.item), F.lit(0))).alias(
        "index", "_item"))
    return (found.withColumn("id", F.regexp_extract("_item", layout.value, 1))
            .withColumn("name", strip(plain_text(F.col("_item")))).drop("_item").where("id != '0'"))


def require_options(options: DataFrame) -> DataFrame:
    """Raise when no option was found at all."""
    if options.isEmpty():
        raise ValueError("no options found")
    return options
