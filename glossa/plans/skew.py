"""Joins of a large table with a lookup table or key list, and rows that repeat very often."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.session import ensure_checkpoint_dir

HOT_ROWS = 100_000    # rows of one key that one task should handle
_SAMPLED = 1_000      # expected sample of a key that is just hot


def has_hot_key(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> bool:
    """Whether some key has more than about ``hot_rows`` rows, counted on a sample of the key columns.

    Only decides whether rows are told apart more carefully; results are the same either way.
    """
    fraction = min(1.0, _SAMPLED / hot_rows)
    keys = df.select(*on) if fraction == 1.0 else df.select(*on).sample(fraction, seed=17)
    return not keys.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > fraction * hot_rows).isEmpty()


def tell_apart(df: DataFrame, keys: Sequence[str], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add a number that differs between rows with equal keys, so that they can be spread.

    A hash of the whole row does, unless some row has very many exact copies.
    Then the input is checkpointed, and rows are told apart by their position in
    the checkpoint, which stays the same when tasks are repeated.
    """
    row = F.xxhash64(*df.columns).alias(out)
    copies = has_hot_key(df, keys, hot_rows) and has_hot_key(df.select(row), [out], hot_rows)
    if not copies:
        return df.select("*", row)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint().withColumn(out, F.monotonically_increasing_id())


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a large table to a table with about one row per key.

    Spark broadcasts the lookup table when its bytes allow. Otherwise adaptive
    execution measures the shuffled partitions and splits those of hot keys,
    however many there are; the aggregation or sort that needs rows of a key together
    should therefore come in a later stage. ``how``: left, inner, left_semi or left_anti.
    """
    return left.join(right, list(on), how)


def filter_join(left: DataFrame, keys: DataFrame, on: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Keep (``left_semi``) or drop (``left_anti``) the rows of a large table by a key list."""
    return lookup_join(left, keys.select(*on).dropna().distinct(), on, how)
