"""Unions and differences over tables and label sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.transfer import first_wins
from glossa.plans.ranking import sequential_id


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack by column name; columns absent from a frame become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def missing_units(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Expected units without any row."""
    return expected.join(found.select(key).distinct(), key, "left_anti")


def merge_corpus(df: DataFrame, order_by: Sequence[str], start: int = 1, key: Sequence[str] | None = None) -> DataFrame:
    """Drop per-file ids and number all rows through in corpus order, id first.

    With a ``key`` that identifies rows, their texts are not sorted or checkpointed for it.
    """
    plain = df.drop("id")
    return sequential_id(plain, order_by, out="id", start=start, key=key).select("id", *plain.columns)


def combine_rounds(rounds: Sequence[DataFrame], key: str, order_by: Sequence[str]) -> DataFrame:
    """Stack annotation rounds, keep each key's first occurrence, renumber from 0."""
    numbered = [df.withColumn("round", F.lit(i)) for i, df in enumerate(rounds, start=1)]
    kept = first_wins(union_all(numbered), [key], ["round", *order_by])
    return sequential_id(kept.drop("id"), ["round", *order_by], out="id", start=0)
