"""Exact, seeded sampling, shuffling, splitting and folding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.plans.ranking import hash_number, hash_rank, seeded_hash
from glossa.plans.skew import tell_apart

_BLOCK = 10_000  # draws made by one task row when oversampling


def sample_exact(df: DataFrame, n: int, key: Sequence[str], seed=0) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, reproducible.

    Neither the driver nor one task ever holds the sample: hash pieces beyond
    the sample are dropped before the shuffle and ranks come from piece counts.
    """
    return hash_rank(df, key, seed, top=n, out="_rank").drop("_rank")


def shuffle_rows(df: DataFrame, key: Sequence[str], seed=0) -> DataFrame:
    """All rows in a seeded random order."""
    return tell_apart(df, key, "_tie").orderBy(seeded_hash(seed, *key), *key, "_tie").drop("_tie")


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First ``n`` rows of a given order."""
    return df.orderBy(*order_by).limit(n)


def request_audit(df: DataFrame, requested: int, *by: str) -> DataFrame:
    """Requested against available rows, with a shortage flag."""
    available = df.groupBy(*by).agg(F.count(F.lit(1)).alias("available"))
    return available.select(
        *by, F.lit(requested).alias("requested"), "available",
        F.least(F.lit(requested), F.col("available")).alias("delivered"),
        (F.col("available") < requested).alias("short"))


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], k: int = 5, seed=0,
                     out: str = "fold") -> DataFrame:
    """Shuffled folds 0..k-1, each balanced to within one row per label."""
    ranked = hash_rank(df, key, seed, by=[label], out="_rank")
    return ranked.withColumn(out, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def train_test_split(df: DataFrame, key: Sequence[str], train: float = 0.9, seed=0,
                     out: str = "split") -> DataFrame:
    """The first ``floor(train * rows)`` rows of a seeded shuffle are ``train``."""
    ranked = hash_rank(df, key, seed, out="_rank", total="_rows")
    part = F.when(F.col("_rank") <= F.floor(F.col("_rows") * train), "train").otherwise("test")
    return ranked.withColumn(out, part).drop("_rank", "_rows")


def oversample(df: DataFrame, label: str, key: Sequence[str], seed=0) -> DataFrame:
    """Draw every class with replacement up to the size of the largest class.

    Draws are made in blocks spread over the cluster and counted per drawn row
    before they meet the rows, so neither a rare nor a large class becomes one
    task's work. Adds ``copy`` (0-based number of the repetition).
    """
    ranked = hash_rank(df, key, seed, by=[label], out="_rank")
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n").alias("_most")).withColumn("_one", F.lit(1))
    plan = sizes.withColumn("_one", F.lit(1)).join(F.broadcast(most), "_one").drop("_one")
    blocks = plan.withColumn("_block", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("_most") - 1) / _BLOCK)))).repartition(label, "_block")
    draws = (blocks.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(_BLOCK - 1))))
             .withColumn("_draw", F.col("_block") * _BLOCK + F.col("_i"))
             .where(F.col("_draw") < F.col("_most")))
    pick = F.pmod(hash_number(seeded_hash(seed, label, "_draw"), 12), F.col("_n")) + 1
    drawn = draws.groupBy(label, pick.alias("_rank")).agg(F.count(F.lit(1)).alias("_copies"))
    return (ranked.join(drawn, [label, "_rank"])
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
            .drop("_rank", "_copies"))
