"""Evaluating expensive expressions once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(expr: Column) -> Column:
    """``expr``, computed a single time per row.

    Catalyst copies the expression behind a column into every filter on that
    column that it pushes down, and explodes add such filters by themselves. The
    always-true, non-deterministic guard prevents the copies; filters on other
    columns should therefore come before the column is made.
    """
    return F.when(F.spark_partition_id() >= 0, expr)
