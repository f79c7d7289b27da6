"""Label dictionaries and multi-label strings as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa import domains
from glossa.functions.text import canonical_label, capitalize, normalize, strip, title


def sql_literal(value) -> str:
    """Spark SQL literal of a string or number."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def literal_map(mapping: dict) -> Column:
    """Dictionary as a map literal, parsed in one go."""
    return F.expr(f"map({', '.join(sql_literal(x) for pair in mapping.items() for x in pair)})")


def lookup(c: Column, mapping: dict, default: Column | str | None = None) -> Column:
    """Dictionary lookup with a default; ``mapping`` is a small fixed dictionary."""
    found = F.try_element_at(literal_map(mapping), c)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def split_labels(c: Column) -> Column:
    """Packed ``a;b`` string -> array of stripped, non-empty labels; null -> empty array."""
    parts = F.transform(F.split(c, ";", -1), strip)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def join_labels(c: Column) -> Column:
    """Array -> packed string for the file sinks."""
    return F.array_join(c, ";")


def translate_themes(c: Column, mapping: dict | None = None) -> Column:
    """translate each part of a packed label string, unknown parts kept stripped."""
    mapping = domains.THEMES_ES if mapping is None else mapping
    parts = F.transform(F.split(c, ";", -1), lambda x: lookup(canonical_label(x), mapping, strip(x)))
    return F.coalesce(F.array_join(parts, ";"), F.lit(""))


def translate_emotion(c: Column, mapping: dict | None = None) -> Column:
    """translate one label, unknown kept stripped, null -> ''."""
    mapping = domains.EMOTIONS_ES if mapping is None else mapping
    return F.coalesce(lookup(canonical_label(c), mapping, strip(c)), F.lit(""))


def correct_label(c: Column) -> Column:
    """map stray annotation labels to the domain, others unchanged."""
    return lookup(c, domains.LABEL_CORRECTIONS, c)


def coarse_emotion(c: Column) -> Column:
    """fine emotion -> coarse emotion, unknown -> neutral."""
    return lookup(c, domains.FINE_TO_COARSE, "neutral")


def back_translate(c: Column, mapping: dict) -> Column:
    """localised label -> key of the dictionary; null when unknown."""
    return lookup(F.lower(c), domains.invert(mapping))


def label_id(c: Column, domain: list[str] | None = None) -> Column:
    """position of the label in its domain."""
    domain = domains.EMOTIONS if domain is None else domain
    return lookup(c, {label: i for i, label in enumerate(domain)})


def label_name(c: Column, domain: list[str] | None = None) -> Column:
    """F14 inverse: label at a position; null outside the domain."""
    domain = domains.EMOTIONS if domain is None else domain
    return F.get(F.array(*[F.lit(x) for x in domain]), c.cast("int"))


def theme_set(c: Column, mapping: dict | None = None) -> Column:
    """packed labels -> distinct lower-case labels, optionally back-translated."""
    def one(x):
        plain = canonical_label(x)
        return lookup(plain, domains.invert(mapping), plain) if mapping else plain

    parts = F.transform(F.split(c, ";", -1), one)
    return F.coalesce(F.array_distinct(parts), F.array().cast("array<string>"))


def normalized_set(c: Column) -> Column:
    """Packed labels -> distinct comparison forms, empties dropped."""
    return F.array_distinct(F.transform(split_labels(c), normalize))


def display_book(book: Column, lang: Column) -> Column:
    """F16: readable book name for a language."""
    slug = F.replace(F.lower(book), F.lit("_"), F.lit("-"))
    english = title(F.replace(slug, F.lit("-"), F.lit(" ")))
    return F.when(lang == "es", lookup(slug, domains.BOOK_DISPLAY_ES, title(slug))).otherwise(english)


def display_emotion(label: Column, lang: Column) -> Column:
    """localised emotion, falling back to the capitalised label."""
    return F.when(lang == "es", lookup(F.lower(label), domains.EMOTIONS_ES, capitalize(label))
                  ).otherwise(capitalize(label))


def display_theme(label: Column, lang: Column) -> Column:
    """localised theme; accepts either language, falls back to the capitalised label."""
    given = canonical_label(label)
    english = lookup(given, domains.invert(domains.THEMES_ES), given)
    spanish = capitalize(lookup(english, domains.THEMES_ES, english))
    return F.when(lang == "es", spanish).otherwise(capitalize(english))


def percent(score: Column) -> Column:
    """score as percent, two decimals."""
    return F.round(score * 100, 2)


def percent_text(score: Column, lang: Column) -> Column:
    """percent text; Spanish groups with '.' and uses ',' as decimal mark."""
    grouped = F.format_number(score * 100, 2)
    return F.when(lang == "es", F.translate(grouped, ",.", ".,")).otherwise(
        F.replace(grouped, F.lit(","), F.lit("")))


def citation(book: Column, chapter: Column, verse: Column, text: Column) -> Column:
    """``Book ch:v - text``; missing parts are blank."""
    blank = F.lit("")
    return F.concat(
        F.coalesce(capitalize(book), blank), F.lit(" "), F.coalesce(chapter.cast("string"), blank),
        F.lit(":"), F.coalesce(verse.cast("string"), blank), F.lit(" - "),
        F.coalesce(strip(text), blank))


def book_of_code(code: Column) -> Column:
    """book name of a code; null marks an unknown code."""
    return lookup(code, domains.CODE_TO_BOOK)
