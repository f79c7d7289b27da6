"""A cleaning pipeline over documents: language, exact copies, near copies, benchmark passages, then token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bpe, decontam, dedup, jaccard, langid
from glossa.llm.common import stored, table

MIN_SCORE = 0.3   # language probability below which a document is rejected, beside those without a letter
NEAR = jaccard.Rule(size=5, percent=80)
PIECES = public_tokenizers.path("piece_bpe_32k.model")

ORACLE_SQL = None  # a trained model and tokenizer ids: tested against a brute-force version


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Without a letter or a clear language they go."""
    model = langid.train_model(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))))
    judged = langid.predict_language(docs, model, out=("__lang", "__score"))
    return judged.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= MIN_SCORE)).drop("__lang", "__score")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return dedup.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the least id: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard.drop_near_duplicates(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to."""
    encoded = bpe.encode_texts(docs.select("doc_id", "text"), PIECES, decoded="decoded")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
