"""The annotation loop: pick rows to label, read the answers back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa import domains
from glossa.functions.labels import correct_label
from glossa.functions.text import canonical_label
from glossa.operators.filters import in_domain
from glossa.operators.transfer import first_wins
from glossa.plans.ranking import hash_rank
from glossa.plans.skew import filter_join, lookup_join


def exclude_labeled(df: DataFrame, labeled: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been labelled yet."""
    return filter_join(df, labeled, [key], "left_anti")


def select_for_annotation(df: DataFrame, n: int, labeled: DataFrame | None = None, seed=16,
                          position: Sequence[str] = ("text",)) -> DataFrame:
    """Exactly ``min(n, rows)`` unique unlabelled rows as (id from 0, verse_id, verse), in random order."""
    kept = df.select("verse_id", "text", *[c for c in position if c not in ("verse_id", "text")])
    kept = kept.dropna(subset=["verse_id", "text"]).withColumnRenamed("text", "verse")
    order = ["verse" if c == "text" else c for c in position]
    unique = first_wins(kept, ["verse_id"], order).select("verse_id", "verse")
    if labeled is not None:
        unique = exclude_labeled(unique, labeled, "verse_id")
    ranked = hash_rank(unique, ["verse_id"], seed, out="_rank", top=n, unique=True)
    return ranked.select((F.col("_rank") - 1).alias("id"), "verse_id", "verse")


def merge_annotations(samples: DataFrame, answers: DataFrame) -> DataFrame:
    """Labels joined to samples on (id, verse_id) as text; unanswered samples drop out.

    Every answer line counts, so a sample answered twice appears twice.
    """
    left = samples.select(F.col("id").cast("string"), F.col("verse_id").cast("string"), "verse")
    right = answers.select(F.col("id").cast("string"), F.col("verse_id").cast("string"), "label")
    return lookup_join(right, left, ["id", "verse_id"], "inner").select("id", "verse_id", "verse", "label")


def tidy_labels(df: DataFrame, label: str = "label", domain: Sequence[str] = tuple(domains.EMOTIONS)) -> DataFrame:
    """Canonical form, corrections, then only domain labels."""
    return in_domain(df.withColumn(label, correct_label(canonical_label(F.col(label)))), label, list(domain))
