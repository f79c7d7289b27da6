"""Projections, filters and predicates."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.labels import normalized_set
from glossa.functions.text import normalize, strip, verse_key, whole_number


def valid_row(book: Column, chapter: Column, verse: Column) -> Column:
    """Non-blank book, chapter and verse positive after truncation; never null."""
    ok = (strip(book) != "") & (whole_number(chapter) > 0) & (whole_number(verse) > 0)
    return F.coalesce(ok, F.lit(False))


def annotation_frame(df: DataFrame) -> DataFrame:
    """Empty theme and emotion, ``verse_id`` right after ``text``, ``id`` first."""
    made = (df.withColumn("theme", F.lit("")).withColumn("emotion", F.lit(""))
            .withColumn("verse_id", verse_key(F.col("book"), F.col("chapter"), F.col("verse"))))
    rest = [c for c in made.columns if c not in ("id", "verse_id")]
    at = rest.index("text") + 1
    first = ["id"] if "id" in made.columns else []
    return made.select(*first, *rest[:at], "verse_id", *rest[at:])


def project(df: DataFrame, keep: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Keep or drop columns."""
    kept = df.select(*keep) if keep else df
    return kept.drop(*drop) if drop else kept


def labelable(df: DataFrame) -> DataFrame:
    """Rows with verse_id and text present, text renamed to verse."""
    return (df.select("verse_id", "text").dropna(subset=["verse_id", "text"])
            .withColumnRenamed("text", "verse"))


def in_domain(df: DataFrame, label: str, domain: list[str]) -> DataFrame:
    """Rows whose label belongs to the domain."""
    return df.where(F.col(label).isin(*domain))


def outside_domain(df: DataFrame, label: str, domain: list[str]) -> DataFrame:
    """Distinct labels of the data that are not in the domain."""
    return df.select(label).distinct().where(~F.coalesce(F.col(label).isin(*domain), F.lit(False)))


def assert_domain(df: DataFrame, label: str, domain: list[str], show: int = 20) -> DataFrame:
    """Raise, naming offenders, unless every label is in the domain."""
    offenders = [row[0] for row in outside_domain(df, label, domain).orderBy(label).take(show)]
    if offenders:
        raise ValueError(f"labels outside the domain: {offenders}")
    return df


def matches(emotion: Column, themes: Column, wanted_emotion: str, wanted_theme: str,
            compat_contains: bool = False) -> Column:
    """Emotion equality and theme membership on comparison forms.

    ``themes`` is the packed string. ``compat_contains`` searches the packed
    string for the theme text instead, a missing theme reading as ``nan``.
    """
    same = normalize(emotion) == normalize(F.lit(wanted_emotion))
    theme = normalize(F.lit(wanted_theme))
    if compat_contains:
        return same & F.contains(F.coalesce(normalize(themes), F.lit("nan")), theme)
    return same & F.array_contains(normalized_set(themes), theme)


def admissible(text: Column, shortest: int = 3) -> Column:
    """Requests are refused when non-empty but too short after stripping."""
    text = F.coalesce(text, F.lit(""))
    return ~((text != "") & (F.length(strip(text)) < shortest))


def mismatches(df: DataFrame, left: str, right: str, order_by: list[str], n: int | None = 10) -> DataFrame:
    """Rows whose two labelings differ, the first ``n`` by key.

    As in the agreement rate, a missing label never agrees.
    """
    differ = df.where(~F.coalesce(F.col(left) == F.col(right), F.lit(False)))
    return differ if n is None else differ.orderBy(*order_by).limit(n)


def any_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P10: rows with at least one null."""
    return df.where(reduce(or_, [F.col(c).isNull() for c in cols or df.columns]))


def all_agree(labels: list[str]) -> Column:
    """Every model gives the same label."""
    first = F.col(labels[0])
    return F.coalesce(reduce(and_, [first == F.col(c) for c in labels[1:]]), F.lit(False))


def all_differ(labels: list[str]) -> Column:
    """No two models give the same label; a missing label differs from everything."""
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i + 1:]]
    return reduce(and_, [F.coalesce(F.col(a) != F.col(b), F.lit(True)) for a, b in pairs])


def confident_disagreement(labels: list[str], scores: list[str], above: float = 0.8) -> Column:
    """All labels differ and every score is above the limit."""
    sure = reduce(and_, [F.col(s) > above for s in scores])
    return all_differ(labels) & F.coalesce(sure, F.lit(False))
