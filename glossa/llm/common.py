"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.session import scratch_path

FILE_ROWS = 1 << 20  # rows of a table of known size that one task writes

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, _UPPER, _LOWER)


def stored(df: DataFrame, name: str, codec: str | None = None, rows: int | None = None) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read again: a cut that survives lost executors.

    ``codec`` names another compression than the session's, for tables of whole texts.
    ``rows`` is the most rows that a table of short rows can have. It is then written by as many tasks as the
    session has cores, or one for each ``FILE_ROWS``, not by one for each shuffle partition.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
