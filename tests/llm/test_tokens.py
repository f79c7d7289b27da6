"""Token ids, counts and packed files against the libraries and a plain dynamic program."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glossa.llm import bpe, counts, packing
from glossa.llm.words import Memo
from glossa.session import scratch_path

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "▁", "a", "b", "th", "e", "ing", "\n", "\t", "é", "日", "\U0001F600", "1", "23", "A", "<s>", "</s>",
         "<0x0A>", "<unk>", "\u00a0", "\u2009", "\u3000", "\x85", "Á", "。", "    ", "\0", "aaaa", "-", "--", "'s", "ß", "\r\n",
         "<|endoftext|>", "the "]


def texts(seed, n=600):
    rng = random.Random(seed)
    return (["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
            + ["", " ", "   ", "a" * 3000, " " * 2500, "ab" * 2000 + " " * 300 + "xyz" * 900, "日本" * 1500, "word " * 30000])


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as f:
        return f.read()


SCHEMA = "doc_id bigint, text string, ids string, n_tokens string, tokens int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in enumerate(rows)], SCHEMA)


def test_pieces_equal_the_library(spark, library):
    rows = [*texts(1), None]
    got = {r["doc_id"]: r for r in bpe.piece_digests(frame(spark, rows), PIECES).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(rows):
        ids = library.encode(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == sha(",".join(map(str, ids)))
        assert got[i]["decoded_sha256"] == sha(library.decode(ids))


def test_encode_and_decode_columns(spark, library):
    rows = [*texts(2, 100), None]
    encoded = bpe.encode_texts(frame(spark, rows), PIECES)
    assert encoded.columns == ["doc_id", "text", "n_tokens", "tokens", "ids"]
    for r in bpe.decode_ids(encoded, PIECES).collect():
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(r["ids"])


def test_decoding_any_ids(model, library):
    rng, tables = random.Random(3), bpe.PieceModel(model)
    special = [0, 1, 2, 3 + 0xE2, 3 + 0x96, 3 + 0x81, 3 + 0xCD]
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), rng.choice(special)]) for _ in range(rng.randint(0, 12))]
        assert tables.decode(ids) == library.decode(ids)


def test_heap_and_rounds_agree(model):
    tables = bpe.PieceModel(model)
    for t in texts(4, 200):
        word = "▁" + t.replace(" ", "▁")
        symbols = [tables.symbols.get(c, -ord(c) - 1) for c in word]
        rounds, _ = tables._rounds(np.array(symbols[:900], dtype=np.int32), np.zeros(len(symbols[:900]), dtype=np.int64))
        assert tables._heap(symbols[:900]).tolist() == rounds.tolist()


def test_small_memo_gives_the_same(model, library):
    tables, memo = bpe.PieceModel(model), Memo(np.int32, most=50)
    rows = texts(5, 300)
    got = [x.tolist() for c in range(0, len(rows), 40) for f, k in tables.encode_blocks(pa.array(rows[c:c + 40]), memo)
           for x in np.split(f, np.cumsum(k)[:-1])]
    assert got == [library.encode(t) for t in rows]


def least_cost(trie, text):
    if not text:
        return 0
    s, best = "▁" + text.replace(" ", "▁"), [(0, 0)]
    for e in range(1, len(s) + 1):
        options = [(best[e - n][0] + trie.cost[s[e - n:e]], best[e - n][1] + 1)
                   for n in range(1, min(trie.longest, e) + 1) if s[e - n:e] in trie.cost]
        if s[e - 1] not in trie.cost:
            options.append((best[e - 1][0] + trie.unknown, best[e - 1][1] + len(s[e - 1].encode())))
        best.append(min(options))
    return best[-1][1]


def test_counts_equal_a_plain_program(spark, model):
    rows, trie = [*texts(6, 300), None], counts.UnigramTrie(model)
    counted = counts.count_tokens(frame(spark, rows), PIECES)
    assert counted.columns == ["doc_id", "text", "ids", "tokens", "n_tokens", "n_words"]
    for r in counted.collect():
        assert r["n_tokens"] == least_cost(trie, r["text"])


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31, 32])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000 + width, dtype=np.uint64)
    data = packing.pack(ids, width)
    assert len(data) == -(-len(ids) * width // 8) and (packing.unpack(data, len(ids), width) == ids).all()


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    ids, path = rng.integers(0, 50257, 300000), f"file://{tmp_path}/x.ids"
    writer = packing.PackedWriter(path, 16)
    for i in range(0, len(ids), 1000):
        writer.add(np.array([i]), np.array([1000]), ids[i:i + 1000])
    writer.close()
    reader = packing.PackedReader(path)
    for a, b in [(0, 1), (5, 5), (65535, 65537), (1000, 299999), (0, 300000), (299999, 300000)]:
        assert (reader.ids(a, b) == ids[a:b]).all()
    assert reader.counts.tolist() == [1000] * 300


def test_packed_files_equal_the_library(spark, monkeypatch):
    rows = [(i % 500 if i % 7 else 3, t) for i, t in enumerate(texts(7))] + [(None, "null id"), (None, None), (9, None)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, start int").repartition(5)
    files = packing.write_packed(docs, BYTES, scratch_path(spark, "packed"))
    got = [tuple(r) for r in packing.read_packed(files).orderBy("start").collect()]
    library = Tokenizer.from_file(BYTES)
    want = {}
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert [g[0] for g in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start, seen = 0, {}
    for doc_id, at, n, crc in got:
        assert at == start
        start += n
        seen.setdefault(doc_id, []).append((n, crc))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}


def test_a_range_may_fill_several_files(spark, monkeypatch):
    monkeypatch.setattr(packing, "FILE_IDS", 10)
    encoder = packing.worker_encoder(open(BYTES, "rb").read())
    assert encoder.width == 16
    files = packing.write_packed(spark.createDataFrame([(i, "some words here") for i in range(20)], "doc_id bigint, text string"),
                                 BYTES, scratch_path(spark, "packed"))
    assert packing.read_packed(files).count() == 20


def test_the_manifest_is_one_file_and_its_files_many_tasks(spark, monkeypatch):
    """op5: no table file for each range, and files are read by as many tasks as they hold ids for, whatever their manifest's size."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    docs = spark.createDataFrame([(i, "some words here") for i in range(100)], "doc_id bigint, text string")
    spark.conf.set(name, "false")
    try:
        files = packing.write_packed(docs, BYTES, scratch_path(spark, "packed"))
    finally:
        spark.conf.unset(name)
    assert files.count() > 4 and len(files.inputFiles()) == 1
    whole = packing.read_packed(files)
    monkeypatch.setattr(packing, "READ_IDS", 10)
    dealt = packing.read_packed(files)
    tasks = [df.select(F.spark_partition_id().alias("task")).distinct().count() for df in (whole, dealt)]
    assert tasks == [1, files.count()]
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, dealt.collect()))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.piece_digests(empty, PIECES).count() == 0
    assert bpe.decode_ids(bpe.encode_texts(empty, PIECES), PIECES).count() == 0
    assert counts.count_tokens(empty, PIECES).count() == 0
    assert packing.read_packed(packing.write_packed(empty, BYTES, scratch_path(spark, "packed"))).count() == 0


def test_one_pass_encodes_and_decodes(spark, library):
    rows = [*texts(8, 100), None]
    both = bpe.encode_texts(frame(spark, [*rows, *rows]), PIECES, decoded="tokens")
    assert both.columns == ["doc_id", "text", "n_tokens", "ids", "tokens"]
    got = both.collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "") and r["tokens"] == library.decode(r["ids"])


def test_decoding_block_by_block(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "DECODE_IDS", 7)
    lists = [library.encode(t) for t in texts(9, 60)[:60]] + [[], None, []]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lists)], "doc_id int, ids array<int>, decoded string")
    for r in bpe.decode_ids(docs, PIECES).collect():
        assert r["decoded"] == library.decode(lists[r["doc_id"]] or [])


def test_the_memo_stays_within_its_bytes(model):
    tables, memo = bpe.PieceModel(model), Memo(np.int32, most=1 << 20)
    most = 0
    for i in range(40):
        column = pa.array([" ".join(f"w{i}x{j}" for j in range(3000))])
        for _ in tables.encode_blocks(column, memo):
            most = max(most, memo.nbytes)
    assert most < 2 << 20


def test_a_worker_keeps_one_operators_state():
    from glossa.llm import words
    first = words.worker_state("a", b"x", lambda s: [s])
    assert words.worker_state("a", b"x", lambda s: [s]) is first
    words.worker_state("b", b"x", lambda s: [s])
    assert words.worker_state("a", b"x", lambda s: [s]) is not first and len(words._STATE) == 1


def test_tasks_leave_a_worker_small(spark, monkeypatch):
    """After a task of near copies or of benchmark items nothing of another operator's is kept, and free memory is returned."""
    from glossa.llm import decontam, jaccard, words
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id bigint, text string")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two three four five six"]})
    taken, returned = [], []
    send = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: taken.append(f) or send(self, f, schema))
    jaccard.set_rows(docs, jaccard.Rule())
    decontam.item_sets(docs.withColumnRenamed("doc_id", "item_id"))
    bpe.piece_digests(docs, PIECES)
    monkeypatch.setattr(words, "give_back", lambda: returned.append(dict(words._STATE)))
    sets, items, pieces = taken
    words.worker_state("other", b"x", lambda s: [s])
    assert [b.num_rows for b in sets(iter([batch]))] == [1] and returned == [{}]
    words.worker_state("other", b"x", lambda s: [s])
    assert [b.num_rows for b in items(iter([batch.rename_columns(["item_id", "text"])]))] == [1] and returned == [{}, {}]
    assert [b.num_rows for b in pieces(iter([batch]))] == [1] and len(returned[2]) == 1
    kept = dict(words._STATE)
    assert [b.num_rows for b in pieces(iter([batch]))] == [1] and words._STATE == kept


def test_a_group_gives_back_also_when_it_fails(monkeypatch):
    from glossa.llm import words
    returned = []
    monkeypatch.setattr(words, "give_back", lambda: returned.append(1))
    words.worker_state("other", b"x", lambda s: [s])
    assert words.lean_group(lambda key, table: (key, table))(1, 2) == (1, 2) and not words._STATE
    with pytest.raises(ZeroDivisionError):
        words.lean_group(lambda key, table: 1 // 0)(1, 2)
    assert returned == [1, 1]
