"""Packed sequences: every id once, all limits, the dot-product choice, little padding."""

import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from glossa.llm import binpack
from glossa.llm.binpack import Limits, Packer, Piece
from glossa.llm.queries import QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, prompt string, ids string, start int"
WORDS = "a the word forms of some Text né 日本 <|endoftext|> 12 -- \n".split(" ")


def text(rng, most):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, most)))


def padding(sequences, tokens):
    """Share of padded places: sequences are padded to ``tokens`` unless their size is a power of two."""
    sizes = [sum(len(p) for p in s) for s in sequences]
    pad = [0 if n & (n - 1) == 0 else tokens - n for n in sizes]
    return sum(pad) / (sum(sizes) + sum(pad))


def check(rows, limits):
    """Pieces in sequences as lists of ids, after all limits have been checked."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    out = []
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["segment"] for r in own] == list(range(len(own))) and len(own) <= limits.segments
        assert [r["offset"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
        assert sum(r["length"] for r in own) <= limits.tokens and sum(r["loss_tokens"] for r in own) <= limits.loss
        out.append([np.frombuffer(r["ids"], dtype="<u4") for r in own])
        assert all(r["length"] == len(i) for r, i in zip(own, out[-1]))
    return out


@pytest.mark.parametrize("limits", [Limits(64, 5, 40), Limits(64, 64, 64), Limits(1, 1, 1), Limits(100, 2, 100)])
@pytest.mark.parametrize("fill", [None, 1, 16])
def test_every_id_in_one_piece(spark, limits, fill):
    rng, library = random.Random(1), Tokenizer.from_file(BYTES)
    rows = [(rng.choice([None, 1, 2, i]), text(rng, rng.choice([0, 3, 40, 300])), text(rng, 20) if i % 3 else None) for i in range(120)]
    rows += [(7, None, None)] * 40
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA).repartition(3)
    got = binpack.pack_examples(docs, BYTES, limits, end_id=1, prompt="prompt", fill=fill).collect()
    check(got, limits)
    library_ids = lambda s: library.encode(s or "", add_special_tokens=False).ids
    want = sorted((str(k), library_ids(p), library_ids(t)) for k, t, p in rows)
    examples = {}
    for r in sorted(got, key=lambda r: r["start"]):  # pieces of examples with one key and size are put together in any order
        examples.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append(r)
    for (key, size), pieces in examples.items():
        own = [(p, t) for k, p, t in want if k == key and len(p) + len(t) + 1 == size]
        assert sum(r["length"] for r in pieces) == size * len(own)
        assert sum(r["loss_tokens"] for r in pieces) == sum(len(t) + 1 for _, t in own)
        if len(own) == 1:
            assert np.concatenate([np.frombuffer(r["ids"], dtype="<u4") for r in pieces]).tolist() == own[0][0] + own[0][1] + [1]
            assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1].tolist()]
    if fill is None:
        assert all(r["length"] == r["doc_tokens"] for r in got if r["doc_tokens"] <= min(limits.tokens, limits.loss))


def plain_sequence(pool, limits):
    """One sequence by the dot-product rule, term by term."""
    left, row, pool = [limits.tokens, limits.segments, limits.loss], [], list(pool)
    caps = [limits.tokens, limits.segments, limits.loss]
    size = lambda p: (len(p.ids), 1, p.loss)
    weights = [sum(size(p)[d] for p in pool) / caps[d] for d in range(3)]
    while True:
        fits = [p for p in pool if all(s <= r for s, r in zip(size(p), left))]
        if not fits:
            return row
        dot = lambda p: sum(w * (s / c) * (r / c) for w, s, r, c in zip(weights, size(p), left, caps))
        best = max(fits, key=dot)
        row.append(best)
        pool = [p for p in pool if p is not best]
        left = [r - s for r, s in zip(left, size(best))]


def test_the_dot_product_chooses():
    rng = random.Random(2)
    for _ in range(50):
        limits = Limits(rng.randint(20, 200), rng.randint(1, 8), rng.randint(10, 100))
        packer, pool = Packer(limits, None, pool=1000), []
        for i in range(60):
            n = rng.randint(1, min(limits.tokens, 60))
            ids = np.arange(n, dtype="<u4")
            piece = Piece(i, 0, ids, rng.randint(max(0, n - limits.loss), n), n)
            pool.append(piece)
            assert not list(packer.add(piece))
        got = packer._sequence()
        scores = [(len(p.ids), p.loss) for p in got]
        assert scores == [(len(p.ids), p.loss) for p in plain_sequence(pool, limits)]


def test_little_padding(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, text(rng, rng.choice([5, 100, 100, 400, 5000])), None, "", 0) for i in range(1500)], SCHEMA)
    whole = binpack.pack_examples(docs.repartition(4), BYTES, Limits(), fill=None).collect()
    cut = binpack.pack_examples(docs.repartition(4), BYTES, Limits()).collect()
    assert padding(check(whole, Limits()), 2048) < 0.05 and padding(check(cut, Limits()), 2048) < 0.005


def test_a_repeated_run_gives_the_same(spark):
    docs = spark.createDataFrame([(i, text(random.Random(i), 200), None, "", 0) for i in range(300)], SCHEMA).repartition(4).cache()
    packed = binpack.pack_examples(docs, BYTES, Limits(256, 4, 256))
    assert sorted(map(tuple, packed.collect()), key=str) == sorted(map(tuple, packed.collect()), key=str)
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]


def test_query_equals_the_library(spark):
    import duckdb
    folder, library = "/root/testdata/sf0.001", Tokenizer.from_file(BYTES)
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())
    got = QUERIES["op12_bin_packing"].run(spark, folder).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(docs)
    for doc_id, own in pieces.items():
        ids = [*library.encode(docs[doc_id] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
    assert padding([[range(r["length"]) for r in s] for s in sequences.values()], 2048) < 0.01
    assert max(sum(r["length"] for r in s) for s in sequences.values()) <= 2048


def test_limits_and_empty_table(spark):
    with pytest.raises(ValueError):
        Limits(tokens=0)
    assert binpack.pack_examples(spark.createDataFrame([], SCHEMA), BYTES).count() == 0
