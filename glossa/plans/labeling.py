"""The labelling job: clean -> emotion -> theme, unit by unit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa import domains
from glossa.functions.text import ascii_punctuation, clean_text, stringify_missing, whole_number
from glossa.operators.filters import annotation_frame, valid_row
from glossa.operators.scoring import BATCH, emotion_label, score_candidates, score_texts, theme_labels
from glossa.plans.audit import run_stage
from glossa.plans.ranking import sequential_id
from glossa.sources.tables import new_units, stored, write_stage


def clean_rows(raw: DataFrame) -> DataFrame:
    """Cleaned, valid rows in the annotation layout, without ids."""
    text = ascii_punctuation(clean_text(F.col("text")))
    valid = raw.where(valid_row(F.col("book"), F.col("chapter"), F.col("verse")))
    typed = (valid.withColumn("text", text).withColumn("chapter", whole_number(F.col("chapter")).cast("int"))
             .withColumn("verse", whole_number(F.col("verse")).cast("int")))
    return annotation_frame(typed)


def clean_corpus(raw: DataFrame, unit: Sequence[str] = ("book",)) -> DataFrame:
    """The cleaning stage with ids from 1 in every unit."""
    rows = clean_rows(raw)
    return sequential_id(rows, ["chapter", "verse"], unit).select("id", *rows.columns)


def label_emotions(df: DataFrame, factory: Callable, batch: int = BATCH, compat_nan: bool = False) -> DataFrame:
    """Emotion stage: ``emotion`` and ``emotion_error``."""
    text = stringify_missing(F.col("text")) if compat_nan else F.col("text")
    scored = score_texts(df, text, factory, "_e", batch)
    return (scored.withColumn("emotion", emotion_label("_e"))
            .withColumnRenamed("_e_error", "emotion_error").drop("_e"))


def label_themes(df: DataFrame, factory: Callable, labels: Sequence[str] = tuple(domains.THEMES),
                 threshold: float = 0.7, batch: int = BATCH, compat_nan: bool = False) -> DataFrame:
    """Theme stage: packed ``theme`` and ``theme_error``."""
    text = stringify_missing(F.col("text")) if compat_nan else F.col("text")
    scored = score_candidates(df, text, factory, labels, "_t", batch)
    return (scored.withColumn("theme", theme_labels("_t", threshold))
            .withColumnRenamed("_t_error", "theme_error").drop("_t"))


def run_labeling(df: DataFrame, emotion: Callable | None = None, theme: Callable | None = None,
                 unit: Sequence[str] = ("corpus", "book_no"), done: DataFrame | None = None,
                 only: dict | None = None, threshold: float = 0.7, batch: int = BATCH) -> DataFrame:
    """Both stages over the units that are still to do.

    Leaving out a scorer skips its stage; ``only`` (column -> value) restricts the
    run to one unit for a trial. Rows are scored where they are read; ``spread``
    the table first when it comes in few, large files.
    """
    todo = new_units(df, done, unit)
    for column, value in (only or {}).items():
        todo = todo.where(F.col(column) == value)
    if emotion:
        todo = label_emotions(todo, emotion, batch)
    if theme:
        todo = label_themes(todo, theme, threshold=threshold, batch=batch)
    return todo


def label_tables(cleaned: DataFrame, folder: str, emotion: Callable | None, theme: Callable | None,
                 unit: Sequence[str] = ("corpus", "book_no"), threshold: float = 0.7,
                 batch: int = BATCH) -> list[dict]:
    """Both stages as tables below ``folder``, resuming where a run stopped.

    Each stage scores only units its table does not hold yet, from the stage
    before it. Returns one audit record per stage that ran.
    """
    spark, audit = cleaned.sparkSession, []
    emotions, themes = f"{folder}/emotion", f"{folder}/emotion_theme"
    if emotion:
        todo = new_units(cleaned, stored(spark, emotions), unit)
        audit.append(run_stage("emotion", label_emotions(todo, emotion, batch),
                               lambda df: write_stage(df, emotions, unit)))
    labelled = stored(spark, emotions)
    if theme and labelled is not None:
        todo = new_units(labelled, stored(spark, themes), unit)
        audit.append(run_stage("theme", label_themes(todo, theme, threshold=threshold, batch=batch),
                               lambda df: write_stage(df, themes, unit)))
    return audit
