"""Token ids in files of fixed-width packed blocks, written in document order and read at random."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glossa.llm.common import stored
from glossa.llm.words import Memo, hash_spans, ragged, spaced_chunks, text_blocks, worker_state

MAGIC = b"TOKPACK1"
BLOCK_IDS = 1 << 16      # ids per block, a multiple of 64
FILE_IDS = 1 << 24       # ids after which a task starts another file
READ_IDS = 1 << 22       # ids that a task reads back, or one file
LIBRARY_TEXTS = 1 << 10  # distinct chunks that the library encodes at once
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


# Packing. 64 ids of w bits fill exactly w words of 64 bits.

def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2**width as consecutive fields of ``width`` bits, least significant bit first."""
    rows = -(-len(ids) // 64)
    padded = np.zeros(rows * 64, dtype=np.uint64)
    padded[: len(ids)] = ids
    padded = np.ascontiguousarray(padded.reshape(rows, 64).T)
    words = np.zeros((width, rows), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        words[word] |= padded[j] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= padded[j] >> np.uint64(64 - shift)
    return words.T.tobytes()[: -(-len(ids) * width // 8)]


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    rows = -(-count // 64)
    raw = np.zeros(rows * width * 8, dtype=np.uint8)
    raw[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    words = np.ascontiguousarray(raw.view(np.uint64).reshape(rows, width).T)
    out, mask = np.empty((64, rows), dtype=np.uint64), np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[word + 1] << np.uint64(64 - shift))
        out[j] = value & mask
    return out.T.reshape(-1)[:count].astype(np.uint32)


class PackedWriter:
    """One file: magic, packed blocks, then document ids and counts, block offsets, and a JSON footer with its length."""

    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width
        self.store, where = fs.FileSystem.from_uri(path)
        self.where, self.part = where, f"{where}.{uuid.uuid4().hex}.tmp"
        self.store.create_dir(os.path.dirname(where), recursive=True)
        self.out = self.store.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.at, self.offsets, self.rest = len(MAGIC), [], np.zeros(0, dtype=np.uint32)
        self.docs, self.counts, self.total = [], [], 0

    def add(self, docs: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs)
        self.counts.append(counts)
        self.total += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(self.rest) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            self._block(self.rest[i : i + BLOCK_IDS])
        self.rest = self.rest[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        """Finish and put the file in place at once, so that a repeated task replaces it whole."""
        if len(self.rest):
            self._block(self.rest)
        docs = np.concatenate([np.zeros(0, dtype=np.int64), *self.docs])
        counts = np.concatenate([np.zeros(0, dtype=np.int64), *self.counts])
        footer = json.dumps({"width": self.width, "block": BLOCK_IDS, "ids": self.total, "docs": len(docs),
                             "index": self.at, "blocks": len(self.offsets)}).encode()
        self.out.write(docs.tobytes() + counts.tobytes() + np.array([*self.offsets, self.at], dtype=np.int64).tobytes())
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.store.move(self.part, self.where)
        return self.path, len(docs), self.total


class PackedReader:
    """Random access to a packed file: any range of ids reads only the blocks that hold it."""

    def __init__(self, path: str) -> None:
        store, where = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(where)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a packed file: {path}")
        length = int.from_bytes(tail[:8], "little")
        self.head = json.loads(self.file.read_at(length, size - 16 - length))
        n, at = self.head["docs"], self.head["index"]
        self.doc_ids = np.frombuffer(self.file.read_at(8 * n, at), dtype=np.int64)
        self.counts = np.frombuffer(self.file.read_at(8 * n, at + 8 * n), dtype=np.int64)
        self.offsets = np.frombuffer(self.file.read_at(8 * self.head["blocks"] + 8, at + 16 * n), dtype=np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        block = self.head["block"]
        first, last = start // block, (stop - 1) // block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            count = min(block, self.head["ids"] - b * block)
            a = int(self.offsets[b] - self.offsets[first])
            parts.append(unpack(data[a : int(self.offsets[b + 1] - self.offsets[first])], count, self.head["width"]))
        return np.concatenate(parts)[start - first * block : stop - first * block]

    def close(self) -> None:
        self.file.close()


# Encoding with a byte-level BPE of the tokenizers library.

class Encoder:
    """Encodes texts with the library, distinct chunks of text once.

    The library's pre-tokeniser never puts a white-space sign behind another sign
    into one piece. So a text may be cut before white space that follows a sign
    which surely is none, and the chunks' ids in a row are the text's ids. Cuts
    are made at ASCII white space behind printing ASCII or a two-byte letter.
    """

    def __init__(self, tokenizer: bytes) -> None:
        self.library = Tokenizer.from_str(tokenizer.decode())
        known = json.loads(tokenizer)
        pre = known.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or known.get("normalizer"):
            raise ValueError("only byte-level tokenizers without normalisation can be cut into chunks")
        # Added tokens are looked for across chunks: texts that hold one are given to the library whole.
        self.added = [t["content"] for t in known.get("added_tokens", [])]
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = max(1, (self.size - 1).bit_length())
        self.memo = Memo(np.int32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers, some texts at a time: the library's answer is many times larger than the ids."""
        flat, counts = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(texts), LIBRARY_TEXTS):
            got = [e.ids for e in self.library.encode_batch_fast(texts[i : i + LIBRARY_TEXTS], add_special_tokens=False)]
            counts.append(np.array([len(g) for g in got], dtype=np.int64))
            flat.append(np.fromiter((i for g in got for i in g), dtype=np.int32, count=int(counts[-1].sum())))
        return np.concatenate(flat), np.concatenate(counts)

    def encode_blocks(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, flat ids and counts of one run of rows after another."""
        for row, data, offsets in text_blocks(column):
            white = _WHITE[data]
            breaks = np.zeros(len(data), dtype=bool)
            if len(data) > 2:
                solid = (data > 0x20) & (data < 0x7F)
                solid[1:] |= ((data[1:] & 0xC0) == 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
                breaks[1:] = white[1:] & solid[:-1]
            starts, ends, chunks = spaced_chunks(data, offsets, breaks)

            def make(rows):
                return self._library([data[a:b].tobytes().decode() for a, b in zip(starts[rows].tolist(), ends[rows].tolist())])

            slots = self.memo.find(hash_spans(data, starts, ends), make)
            lengths = self.memo.length[slots]
            flat = ragged(self.memo.flat, self.memo.start[slots], lengths)
            sums = np.concatenate([[0], np.cumsum(lengths)])
            counts = np.diff(sums[np.concatenate([[0], np.cumsum(chunks)])])
            flat, counts = self._with_added(data, offsets, flat, counts)
            yield row, flat, counts

    def _with_added(self, data, offsets, flat, counts):
        whole = data.tobytes()
        if not any(a.encode() in whole for a in self.added):
            return flat, counts
        parts = np.split(flat, np.cumsum(counts)[:-1])
        for i in range(len(counts)):
            text = whole[offsets[i] : offsets[i + 1]]
            if any(a.encode() in text for a in self.added):
                parts[i] = self._library([text.decode()])[0]
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)


def worker_encoder(tokenizer: bytes) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_state("bytes", tokenizer, Encoder)


def write_packed(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, text: str = "text") -> DataFrame:
    """Encode documents and write packed files in ascending doc_id order; returns the files' manifest.

    The rows are dealt by ranges of (doc_id, position in the scan), so equal ids
    are spread as well; null ids come first, null texts are empty and an empty
    table writes nothing. Each task streams its range into one or more files of
    up to about ``FILE_IDS`` ids under ``folder``, a URI that all executors share.
    File names follow from the range, so a repeated task writes the same files.
    Manifest: part, piece, path, docs, ids and start, the ids in all files before. Its rows, one for each file,
    come together for their order, and only then are they written: one table file, not one for each task.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    ranged = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                          F.monotonically_increasing_id().alias("row"))
              .repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
              .select(F.spark_partition_id().alias("part"), "doc_id", "text"))

    def run(batches):
        encoder, writer, piece, part = worker_encoder(tokenizer.value), None, 0, 0

        def done(w, number):
            path, n, ids = w.close()
            return pa.RecordBatch.from_pydict({"part": [part], "piece": [number], "path": [path], "docs": [n], "ids": [ids]},
                                              schema=_MANIFEST)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            doc_ids = batch.column("doc_id")
            known = doc_ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            for row, flat, counts in encoder.encode_blocks(batch.column("text")):
                writer = writer or PackedWriter(f"{folder}/part-{part:06d}-{piece:04d}.ids", encoder.width)
                ends = np.cumsum(counts)
                writer.add(known[row : row + len(counts)], counts + 1, np.insert(flat, ends, end_id))
                if writer.total >= FILE_IDS:
                    yield done(writer, piece)
                    writer, piece = None, piece + 1
        if writer:
            yield done(writer, piece)

    files = ranged.mapInArrow(run, "part int, piece int, path string, docs bigint, ids bigint")  # one row per file
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return stored(files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), "manifest")


_MANIFEST = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])


def read_packed(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of a manifest.

    Files are dealt evenly to as many tasks as they hold ``READ_IDS`` ids, one task to a file at most. The number is
    given, as Spark would join partitions by the size of the manifest's rows, which says nothing of the files.
    """
    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                reader = PackedReader(path)
                bounds = np.concatenate([[0], np.cumsum(reader.counts)])
                i = 0
                while i < len(reader.counts):  # some documents at a time
                    j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + (1 << 20), side="right")) - 1)
                    ids = reader.ids(int(bounds[i]), int(bounds[j])).astype("<u4")
                    data, base = memoryview(ids.tobytes()), int(bounds[i])
                    crc = [zlib.crc32(data[4 * (a - base) : 4 * (b - base)])
                           for a, b in zip(bounds[i:j].tolist(), bounds[i + 1 : j + 1].tolist())]
                    known = reader.doc_ids[i:j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(known, mask=known == -(1 << 63)), pa.array(start + bounds[i:j]),
                         pa.array(reader.counts[i:j]), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j
                reader.close()

    n, ids = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("ids"), F.lit(0))).first()
    files = manifest.select("path", "start").repartition(max(1, min(n, -(-ids // READ_IDS))))
    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
