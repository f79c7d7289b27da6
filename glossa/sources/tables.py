"""File sources and sinks of the corpus stages.

CSV is the exchange format. Texts may contain line breaks, so a CSV file is read
by one task; large corpora should come as many files or move to Parquet, which
is the format between the stages.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glossa import domains, schemas
from glossa.functions.text import file_prefix, file_slug
from glossa.plans.skew import filter_join

# RFC-4180 quoting.
_CSV = {"quote": '"', "escape": '"', "encoding": "UTF-8"}
CORPUS_FILES = "*_emotion_theme.csv"
_CORRUPT = "_corrupt_record"


def file_name() -> Column:
    return F.col("_metadata.file_name")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType, header: bool = True,
             recursive: bool = False, pattern: str | None = None, origin: bool = False,
             multi_line: bool = True) -> DataFrame:
    """CSV with or without header; missing and empty fields are null.

    ``recursive`` descends into folders, ``pattern`` filters file names, and
    ``origin`` adds ``file``, ``book_no`` and ``slug`` taken from the file name.
    Without line breaks in texts, ``multi_line=False`` lets Spark split large files.
    """
    reader = spark.read.schema(schema).options(**_CSV).option("header", header).option("multiLine", multi_line)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if pattern or recursive:
        reader = reader.option("pathGlobFilter", pattern or "*.csv")
    df = reader.csv(path if isinstance(path, str) else list(path))
    if not origin:
        return df
    return df.select("*", file_name().alias("file")).withColumn(
        "book_no", file_prefix(F.col("file"))).withColumn("slug", file_slug(F.col("file")))


def load_corpus(spark: SparkSession, path: str, schema: StructType = schemas.LABELED,
                files: str = CORPUS_FILES) -> DataFrame:
    """Every labelled file of a corpus folder, with ``source_file`` (the file stem).

    A folder without such files gives an empty table with the same columns.
    """
    if not _exists(spark, f"{path}/{files}"):
        return spark.createDataFrame([], StructType([*schema.fields, StructField("source_file", StringType())]))
    df = read_csv(spark, path, schema, pattern=files, origin=True)
    return df.withColumn("source_file", F.regexp_replace("file", r"\.csv$", "")).drop("file", "book_no", "slug")


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A stage table, or None before its first write."""
    return spark.read.parquet(path) if _exists(spark, f"{path}/[^_.]*") else None


def corpus_folder(base: str, lang: str, english: str = "english", other: str = "spanish") -> str:
    """Folder of the labelled corpus for a language; anything but English uses the other corpus."""
    return f"{base}/{english if lang == 'en' else other}/emotion_theme"


@dataclass
class CheckedRead:
    """Rows of the usable files, one row per file with its verdict, and odd records.

    ``malformed`` lists records with more or fewer fields than their header; they
    are also among ``rows``, cut off or filled up with nulls.
    """

    rows: DataFrame
    files: DataFrame
    malformed: DataFrame


def file_headers(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Every file with its first line as (file, header); empty files have none.

    Only the first block of a file is read. The names come from the file index,
    because a scan leaves out empty files.
    """
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    lines = (texts.where("_metadata.file_block_start = 0")
             .select(F.col("_metadata.file_path").alias("file"), "value",
                     F.monotonically_increasing_id().alias("at")))
    header = F.regexp_replace(F.min_by("value", "at"), "^\ufeff|\r$", "")
    names = [re.sub("^file:/+", "file:/", name) for name in texts.inputFiles()]
    listed = spark.createDataFrame([(name,) for name in names], "file string")
    return listed.join(lines.groupBy("file").agg(header.alias("header")), "file", "left")


def read_checked(spark: SparkSession, path: str, required: Sequence[str] = tuple(schemas.REQUIRED_RAW),
                 columns: Sequence[str] = tuple(schemas.RAW.names), pattern: str = "*.csv") -> CheckedRead:
    """Read files that have the required columns, set the others aside and report them.

    Columns are matched row by row with the header of the row's file, in whatever
    order; absent optional columns become null. Files are read once per number of
    columns, however many different headers there are.
    """
    names = F.transform(F.split(F.coalesce("header", F.lit("")), ",", -1), lambda c: F.btrim(c, F.lit(' "')))
    need = F.array(*[F.lit(c) for c in required])
    files = file_headers(spark, path, pattern).withColumn("names", names).withColumn(
        "missing", F.array_sort(F.array_except(need, "names"))).withColumn("ok", F.size("missing") == 0)
    files = files.drop("header")
    # file names only, which the driver holds anyway in Spark's own file index
    widths: dict[int, list[str]] = {}
    for found in files.where("ok").select(F.size("names").alias("width"), "file").toLocalIterator():
        widths.setdefault(found["width"], []).append(found["file"])
    rows = spark.createDataFrame([], StructType([StructField(c, StringType()) for c in [*columns, "file", _CORRUPT]]))
    for width, paths in sorted(widths.items()):
        places = [f"_c{i}" for i in range(width)]
        schema = StructType([StructField(n, StringType()) for n in [*places, _CORRUPT]])
        part = read_csv(spark, sorted(paths), schema).withColumn("file", F.col("_metadata.file_path"))
        named = part.join(files.select("file", "names"), "file")
        values = [F.get(F.array(*places), (F.array_position("names", F.lit(c)) - 1).cast("int")).alias(c) for c in columns]
        rows = rows.unionByName(named.select(*values, "file", _CORRUPT))
    malformed = rows.where(F.col(_CORRUPT).isNotNull()).select("file", F.col(_CORRUPT).alias("record"), *required)
    return CheckedRead(rows.drop(_CORRUPT), files, malformed)


def audit_files(checked: CheckedRead, kept: Column) -> DataFrame:
    """Per file its verdict, rows read, kept and removed; files without a kept row fail."""
    counted = checked.rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(kept).alias("kept"))
    zero = F.lit(0)
    return checked.files.join(counted, "file", "left").select(
        "file", F.array_join("missing", ",").alias("missing"), F.coalesce("rows", zero).alias("rows"),
        F.coalesce("kept", zero).alias("kept"),
        (F.coalesce("rows", zero) - F.coalesce("kept", zero)).alias("removed"),
        (F.col("ok") & (F.coalesce("kept", zero) > 0)).alias("processed"))


def session_summary(audit: DataFrame) -> DataFrame:
    """Totals over an audit table."""
    return audit.agg(
        F.count_if("processed").alias("processed"), F.count_if(~F.col("processed")).alias("failed"),
        F.sum("rows").alias("rows"), F.sum("kept").alias("kept"), F.sum("removed").alias("removed"))


def write_csv(df: DataFrame, path: str, quote_all: bool = True, partition_by: Sequence[str] = (),
              mode: str = "errorifexists") -> None:
    """CSV with every field quoted and ``\\n`` line ends; null and '' are written alike."""
    text = df.select(*[F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c)
                       for c, t in df.dtypes])
    writer = (text.write.mode(mode).option("header", True).option("quoteAll", quote_all)
              .option("quote", '"').option("escape", '"').option("lineSep", "\n").option("emptyValue", ""))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ("corpus", "book_no"),
                mode: str = "append", rows_per_file: int = 5_000_000) -> None:
    """A stage table as partitioned Parquet.

    The rebalance hint groups rows by partition value and lets Spark split the
    large ones, so a hot book becomes several files instead of one long task.
    """
    (df.hint("rebalance", *partition_by).write.mode(mode).option("maxRecordsPerFile", rows_per_file)
     .partitionBy(*partition_by).parquet(path))


def write_books(verses: DataFrame, path: str) -> DataFrame:
    """Books as separate partitions numbered in canonical order; returns books without verses."""
    order = canonical_books(verses.sparkSession)
    # the canonical list has 66 rows
    write_stage(verses.join(F.broadcast(order), "book"), path, ("book_no", "book"), "errorifexists")
    return order.join(verses.select("book").distinct(), "book", "left_anti").orderBy("book_no")


def canonical_books(spark: SparkSession) -> DataFrame:
    """Canonical order as (book_no, book)."""
    return spark.createDataFrame(list(enumerate(domains.BOOK_ORDER, start=1)), "book_no int, book string")


def new_units(df: DataFrame, done: DataFrame | None, unit: Sequence[str]) -> DataFrame:
    """Rows of units that have no output yet."""
    return df if done is None else filter_join(df, done, unit, "left_anti")


def write_error_examples(examples: DataFrame, path: str) -> None:
    """Error examples, one folder per (label, error type)."""
    examples.write.mode("errorifexists").option("header", True).partitionBy("label", "error_type").csv(path)


def append_feedback(df: DataFrame, path: str) -> None:
    """Append feedback rows; their columns may differ from those already stored."""
    df.write.mode("append").parquet(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """All feedback with the union of all columns, blanks where a row lacks one."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.fillna("", [c for c, t in df.dtypes if t == "string"])


def feedback_rows(df: DataFrame, verses: str = "verses") -> DataFrame:
    """Spread an array of recommended verses over ``versiculo_1..n`` columns, n being the longest array."""
    most = df.agg(F.max(F.size(verses))).first()[0] or 0
    spread = [F.get(F.col(verses), F.lit(i)).alias(f"versiculo_{i + 1}") for i in range(most)]
    return df.select(*[c for c in df.columns if c != verses], *spread)
