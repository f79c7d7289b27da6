"""The pipeline against a plain Python version of its stages, on a small folder of tables."""

import re
from pathlib import Path

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from .test_groups import brute, fold, shingles, words

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not available")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{FOLDER}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    body = next(t for _, t, *_ in rows if len(t.split()) > 200)
    more = [None, "", "12 34 !!", body.upper(), body + " end", body.replace(" ", "  "), " ".join(body.split()[:150]) + " " + items[0][1],
            items[1][1], "x " + items[2][1] + " y"]
    rows += [(10_000 + i, t, None, "extra", 0) for i, t in enumerate(more)] + [(10_003, body.upper(), "en", "extra", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), rows, items


def test_stages_and_run(spark, folder):
    base, rows, items = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    recognised = corpus_pipeline.language_id(spark, docs, base)
    assert recognised.columns == docs.columns
    with_letters = [(r[0], r[1]) for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert sorted((r["doc_id"], r["text"]) for r in recognised.collect()) == sorted(with_letters)

    last = {}
    for i, t in sorted(with_letters):
        last[fold(t)] = (i, t)
    single = list(last.values())
    near = {i for i, _, c in brute(single, corpus_pipeline.NEAR) if i == c}
    long = [shingles(t, 5) for _, t in items if len(words(t)) >= 5]
    clean = {i: t for i, t in single if i in near and not any(
        5 * len(s & (shingles(t, 5) if len(words(t)) >= 5 else set())) >= 4 * len(s) for s in long)}
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECES)
    want = {i: (len(library.encode(t)), library.encode(t), library.decode(library.encode(t))) for i, t in clean.items()}

    got = corpus_pipeline.run(spark, base)
    assert {r["doc_id"]: (r["n_tokens"], r["ids"], r["decoded"]) for r in got.collect()} == want
    assert 0 < len(want) < len(with_letters)


def test_stages_keep_the_columns_of_documents(spark, folder):
    base, _, _ = folder
    docs = spark.read.parquet(f"{base}/documents.parquet").limit(30)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, base).columns == docs.columns, name
