"""Carrying labels between aligned corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.labels import translate_emotion, translate_themes
from glossa.functions.text import whole_number
from glossa.plans.ranking import first_per_group, numbered_keys, sequential_id
from glossa.plans.skew import filter_join, lookup_join

KEY = ("book_no", "chapter", "verse")


def last_wins(df: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """The last row of each key in input order."""
    return first_per_group(df, keys, [F.col(c).desc() for c in position])


def first_wins(df: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """The first row of each key in input order."""
    return first_per_group(df, keys, [F.col(c).asc() for c in position])


def transfer_labels(target: DataFrame, source: DataFrame, position: Sequence[str],
                    key: Sequence[str] = KEY, theme_map: dict | None = None,
                    emotion_map: dict | None = None) -> DataFrame:
    """Give each target row the translated labels of the source row with its key.

    Unmatched rows, and rows whose key is unreadable, get ``''`` and
    ``matched = false``. Of several source rows with one key the last by
    ``position`` wins. Only keys and labels of the source are shuffled.
    """
    plain = [c for c in target.columns if c not in ("theme", "emotion")]
    numbers = [c for c in key if c in ("chapter", "verse")]
    src = source.select(*key, *[c for c in position if c not in key], "theme", "emotion")
    src = _whole(src, numbers)
    labels = last_wins(src.dropna(subset=list(key)), key, position).select(
        *[F.col(c).alias(f"_{c}") for c in key],
        translate_themes(F.col("theme"), theme_map).alias("theme"),
        translate_emotion(F.col("emotion"), emotion_map).alias("emotion"), F.lit(True).alias("matched"))
    keyed = _whole(target.select(*plain, *[F.col(c).alias(f"_{c}") for c in key]), [f"_{c}" for c in numbers])
    joined = lookup_join(keyed, labels, [f"_{c}" for c in key], "left")
    return joined.select(*plain, F.coalesce("theme", F.lit("")).alias("theme"),
                         F.coalesce("emotion", F.lit("")).alias("emotion"),
                         F.coalesce("matched", F.lit(False)).alias("matched"))


def _whole(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key columns as whole numbers; columns that are integers already only change width."""
    integers = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")}
    return df.withColumns({c: F.col(c).cast("bigint") if c in integers else whole_number(F.col(c)) for c in columns})


def transfer_by_position(target: DataFrame, source: DataFrame, unit: str, order_by: Sequence[str],
                         labels: dict[str, Column], key: Sequence[str] | None = None,
                         source_key: Sequence[str] | None = None) -> DataFrame:
    """Row-by-row transfer inside units with equal row counts; other units are skipped.

    ``labels`` names the output columns computed from source columns. Where columns identify the
    rows of both sides (``key``, and ``source_key`` if it has other names there), only keys are numbered and
    paired by position. The pair then fetches the labels by source key and the target's columns by target
    key, so texts are neither sorted nor checkpointed and move in one join. Equal places come in key order.
    """
    sizes = (target.groupBy(unit).agg(F.count(F.lit(1)).alias("_t"))
             .join(source.groupBy(unit).agg(F.count(F.lit(1)).alias("_s")), unit)
             .where("_t = _s").select(unit))
    plain = [c for c in target.columns if c not in labels]
    if key is not None:
        pairs = _paired_keys(target, source, sizes, unit, order_by, key, source_key or key)
        carried = source.select(_row_key(source_key or key, "_from"), *[expr.alias(name) for name, expr in labels.items()])
        moved = pairs.join(carried, "_from").drop("_from")
        return target.select(*plain, _row_key(key, "_to")).join(moved, "_to").drop("_to")
    left = sequential_id(filter_join(target.select(*plain), sizes, [unit]),
                         order_by, [unit], "_pos")
    right = sequential_id(source, order_by, [unit], "_pos").select(
        unit, "_pos", *[expr.alias(name) for name, expr in labels.items()])
    return left.join(right, [unit, "_pos"]).drop("_pos")


def _row_key(key: Sequence[str], name: str) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)]).alias(name)


def _paired_keys(target: DataFrame, source: DataFrame, sizes: DataFrame, unit: str, order_by: Sequence[str],
                 key: Sequence[str], source_key: Sequence[str]) -> DataFrame:
    """``_to`` and ``_from``: keys of the rows at the same place of a unit."""
    sides = []
    for rows, own, name in ((target, key, "_to"), (source, source_key, "_from")):
        numbered = numbered_keys(filter_join(rows, sizes, [unit]), order_by, own, [unit], "_pos")
        sides.append(numbered.select(unit, "_pos", _row_key(own, name)))
    return sides[0].join(sides[1], [unit, "_pos"]).select("_to", "_from")


def align(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str],
          suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Two labelings of one corpus side by side; ``right`` has one row per key."""
    a = left.select(*key, *[F.col(c).alias(c + suffixes[0]) for c in columns])
    b = right.select(*key, *[F.col(c).alias(c + suffixes[1]) for c in columns])
    return lookup_join(a, b, list(key), "inner")


def unit_pairs(left: DataFrame, right: DataFrame, number: str, name: str) -> DataFrame:
    """Partner of every left unit by number; the smallest name wins among several.

    ``partners`` is 0 for units without a partner.
    """
    a = left.select(number, F.col(name).alias("unit")).distinct()
    b = (right.select(number, name).distinct().groupBy(number)
         .agg(F.min(name).alias("partner"), F.count(F.lit(1)).alias("partners")))
    return a.join(b, number, "left").select(
        number, "unit", "partner", F.coalesce("partners", F.lit(0)).alias("partners"))


def transfer_corpus(target: DataFrame, source: DataFrame, position: Sequence[str], number: str = "book_no",
                    name: str = "file") -> tuple[DataFrame, DataFrame]:
    """J09 + J01: pair the units of two corpora by number and transfer labels inside the pairs.

    A source unit with several target units labels the one with the smallest
    name. Returns the labelled rows of the chosen units and the pairing report.
    """
    pairs = unit_pairs(source, target, number, name)
    chosen = pairs.select(number, F.col("partner").alias(name))
    return transfer_labels(filter_join(target, chosen, [number, name]), source, position), pairs


def transfer_audit(transferred: DataFrame, *by: str) -> DataFrame:
    """Rows and unmatched rows per unit."""
    return transferred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("matched")).alias("unmatched"))
