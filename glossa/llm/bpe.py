"""SentencePiece BPE encoding by vectorised merge rounds, and decoding, over Arrow batches."""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glossa.llm.words import Memo, hash_spans, lean, ragged, spaced_chunks, text_blocks, with_space, worker_state

SPACE = "▁"
LONG_WORD = 1 << 10  # symbols from which a word is merged from a heap instead of in rounds
DECODE_IDS = 1 << 18  # ids decoded at once


class PieceModel:
    """Tables of a SentencePiece BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(size)]
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.symbols = {p: i for i, p in enumerate(pieces) if plain[i]}
        rank_of = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for i in range(size) if plain[i]}))}
        ranks = {i: rank_of[-sp.get_score(i)] for i in range(size) if plain[i]}
        for p in [p for p in self.symbols if len(p) > 1]:  # characters that are known only inside pieces
            for c in p:
                self.symbols.setdefault(c, size + len(self.symbols))
        self.width = max(self.symbols.values()) + 1
        pairs = {}
        for p, i in list(self.symbols.items()):
            if i < size:
                for k in range(1, len(p)):
                    left, right = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                    if left is not None and right is not None:
                        pairs[left * self.width + right] = (ranks[i], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.worst = np.int32(len(rank_of))
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()] + [self.worst], dtype=np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], dtype=np.int32)
        self.size = size
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        if len(set(self.byte_id.tolist())) < 256 or not all(sp.is_byte(int(i)) for i in self.byte_id):
            raise ValueError("the model has no byte fallback")
        # What decoding writes for each id, and what a list of decimal ids shows.
        shown = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else
                 bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode()
                 for i, p in enumerate(pieces)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        self.opens = np.array([plain[i] and p.startswith(SPACE) for i, p in enumerate(pieces)])
        self.shown, self.shown_at, self.shown_len = _strings(shown)
        self.digits, self.digits_at, self.digits_len = _strings([b"%d," % i for i in range(size)])
        for probe in ("a  b", "Two words.\n日本 \U0001F600", "  lead"):
            if self.encode([probe])[0].tolist() != sp.encode(probe):
                raise ValueError("the model's normalisation or type is not supported")

    # Encoding

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        memo, out = Memo(np.int32), []
        for flat, counts in self.encode_blocks(pa.array(texts, pa.string()), memo):
            out += np.split(flat, np.cumsum(counts)[:-1])
        return out

    def encode_blocks(self, column: pa.Array, memo: Memo) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Flat ids and the number of ids of each row, for one run of rows after another."""
        for _, data, offsets in text_blocks(column):
            empty = offsets[1:] == offsets[:-1]
            data, offsets = with_space(data, offsets)
            space = data == 0x20
            breaks = space.copy()
            breaks[1:] &= ~space[:-1] & (data[:-1] != 0x81)  # 0x81 may end the sign that stands for a space
            starts, ends, words = spaced_chunks(data, offsets, breaks)
            slots = memo.find(hash_spans(data, starts, ends),
                              lambda rows: self._words(data, starts[rows], ends[rows]))
            lengths = memo.length[slots]
            lengths[np.repeat(empty, words)] = 0
            flat = ragged(memo.flat, memo.start[slots], lengths)
            sums = np.concatenate([[0], np.cumsum(lengths)])
            yield flat, np.diff(sums[np.concatenate([[0], np.cumsum(words)])])

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, flat, and their number for each word."""
        raw = ragged(data, starts, ends - starts)
        heads = (raw & 0xC0) != 0x80
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        chars = np.diff(np.concatenate([[0], np.cumsum(heads)])[bounds])
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        points[points == 0x20] = ord(SPACE)
        symbols = self.char[points]
        unknown = symbols < 0
        symbols[unknown] = -points[unknown] - 1  # a sign outside the model, until the end
        word = np.repeat(np.arange(len(starts)), chars)
        long = chars >= LONG_WORD
        if long.any():
            pick = long[word]
            parts = [(symbols[~pick], word[~pick])] if not pick.all() else []
            done = [self._rounds(*p) for p in parts]
            at = np.cumsum(chars) - chars
            for w in np.flatnonzero(long):
                ids = self._heap(symbols[at[w] : at[w] + chars[w]].tolist())
                done.append((ids, np.full(len(ids), w)))
            symbols = np.concatenate([d[0] for d in done])
            word = np.concatenate([d[1] for d in done])
            order = np.argsort(word, kind="stable")
            symbols, word = symbols[order], word[order]
        else:
            symbols, word = self._rounds(symbols, word)
        symbols, word = self._fall_back(symbols, word)
        return symbols, np.bincount(word, minlength=len(starts)).astype(np.int64)

    def _slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair in the pair tables; the last row is that of no pair."""
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge in rounds: in each word, the leftmost pair of least rank. Words without a pair leave."""
        none = len(self.keys)
        done = []
        slot = np.full(len(symbols), none)
        if len(symbols) > 1:
            slot[:-1] = self._slots(symbols[:-1], symbols[1:])
            slot[:-1][word[:-1] != word[1:]] = none
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            rank = self.rank[slot]
            least = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(symbols)))
            if (least == self.worst).any():
                stays = np.repeat(least < self.worst, lengths)
                done.append((symbols[~stays], word[~stays]))
                symbols, word, slot, rank = symbols[stays], word[stays], slot[stays], rank[stays]
                lengths, least = lengths[least < self.worst], least[least < self.worst]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, lengths))
            hits = hits[np.concatenate([[True], word[hits][1:] != word[hits][:-1]])]  # leftmost of each word
            symbols[hits] = self.merged[slot[hits]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hits + 1] = False
            symbols, word, slot = symbols[keep], word[keep], slot[keep]
            new = hits - np.arange(len(hits))
            for at in (new, new[new > 0] - 1):
                inner = at[at + 1 < len(symbols)]
                slot[at] = none
                same = inner[word[inner] == word[inner + 1]]
                slot[same] = self._slots(symbols[same], symbols[same + 1])
        if not done:
            return symbols, word
        symbols, word = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _heap(self, symbols: list[int]) -> np.ndarray:
        """The same merges for one very long word, whose rounds would each pass over all of it."""
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else -1
            if j >= 0 and symbols[i] >= 0 and symbols[j] >= 0:
                found = self.pairs.get(symbols[i] * self.width + symbols[j])
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], symbols[i], j, symbols[j]))

        for i in range(n):
            offer(i)
        gone = [False] * n
        while heap:
            _, i, made, a, j, b = heapq.heappop(heap)
            if gone[i] or right[i] != j or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j], right[i] = made, True, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return np.array([s for s, g in zip(symbols, gone) if not g], dtype=np.int64)

    def _fall_back(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Write signs that are no piece as the pieces of their bytes."""
        outside = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if not len(outside):
            return symbols, word
        names = {i: s for s, i in self.symbols.items() if i >= self.size}
        counts = np.ones(len(symbols), dtype=np.int64)
        encoded = [(chr(-s - 1) if s < 0 else names[s]).encode() for s in symbols[outside].tolist()]
        counts[outside] = [len(e) for e in encoded]
        out = np.repeat(symbols, counts)
        at = (np.cumsum(counts) - counts)[outside]
        where = np.repeat(at - (np.cumsum(counts[outside]) - counts[outside]), counts[outside]) + np.arange(
            int(counts[outside].sum()))
        out[where] = self.byte_id[np.frombuffer(b"".join(encoded), dtype=np.uint8)]
        return out, np.repeat(word, counts)

    # Decoding

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, dtype=np.int64), np.array([len(ids)]))[0].tobytes().decode()

    def decode_bytes(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts of several lists of ids, flat, and their lengths.

        The space before a text's first word goes, behind control ids too. Bytes that are no UTF-8 become
        U+FFFD, one for each byte, as the library writes them.
        """
        lengths = self.shown_len[flat]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        begins = self.shown_at[flat]
        seen = np.append(np.flatnonzero(lengths), len(flat))
        heads = seen[np.searchsorted(seen, bounds[:-1])]
        heads = heads[heads < bounds[1:]]
        lead = heads[self.opens[flat[heads]]]
        begins[lead] += 1
        lengths[lead] -= 1
        text = ragged(self.shown, begins, lengths)
        sizes = np.diff(np.concatenate([[0], np.cumsum(lengths)])[bounds])
        if self.is_byte[flat].any() and not self._sound(text, sizes, flat):
            parts = [self._decode_runs(flat[a:b].tolist()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            text = np.frombuffer(b"".join(parts), dtype=np.uint8)
            sizes = np.array([len(p) for p in parts], dtype=np.int64)
        return text, sizes

    def _sound(self, text: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> bool:
        """Whether byte pieces make up whole signs, within their texts and without invisible ids between them."""
        if (self.shown_len[flat] == 0).any():
            return False
        try:
            text.tobytes().decode()
        except UnicodeDecodeError:
            return False
        heads = (np.cumsum(sizes) - sizes)[sizes > 0]
        return not ((text[heads] & 0xC0) == 0x80).any()

    def _decode_runs(self, ids: list[int]) -> bytes:
        """One text whose byte pieces do not all make up signs: each run of bytes is read by itself."""
        out, run = [], b""
        for i in [*ids, -1]:
            shown = b"" if i < 0 else self.shown[self.shown_at[i] : self.shown_at[i] + self.shown_len[i]].tobytes()
            if i >= 0 and self.is_byte[i]:
                run += shown
                continue
            out.append(run.decode(errors="glossa_each").encode())
            run = b""
            out.append(shown[1:] if i >= 0 and self.opens[i] and not any(out) else shown)
        return b"".join(out)

    def id_lists(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, each with a comma behind it, flat, and the lengths of the lists."""
        lengths = self.digits_len[flat]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return ragged(self.digits, self.digits_at[flat], lengths), np.diff(sums[np.concatenate([[0], np.cumsum(counts)])])


codecs.register_error("glossa_each", lambda e: ("�", e.start + 1))


def _strings(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(i) for i in items], dtype=np.int64)
    return np.frombuffer(b"".join(items), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def worker_model(model: bytes) -> tuple[PieceModel, Memo]:
    """The model and the words of a Python worker, which serves many tasks."""
    return worker_state("pieces", model, lambda m: (PieceModel(m), Memo(np.int32)))


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids",
                 decoded: str | None = None) -> DataFrame:
    """Add the SentencePiece ids of each text as an array of ints; null and empty texts have none.

    Ids equal the library's, without begin and end ids. With ``decoded``, the text that
    the ids stand for is added under that name in the same pass. Distinct words are
    encoded once per worker, and a worker holds about a megabyte of text at a time
    besides its input batch and the longest text. Rows (repeated ones too), their order
    and all other columns stay; input columns named like the new ones are replaced; an
    empty table stays empty. No shuffle.
    """
    model = _shipped(docs, model_path)
    new = [out] + ([decoded] if decoded else [])
    docs = docs.drop(*[c for c in new if c != text])
    kept = [c for c in docs.columns if c not in new]
    schema = docs.select(*kept).schema.add(out, T.ArrayType(T.IntegerType(), False), False)
    schema = schema.add(decoded, "string", False) if decoded else schema

    def run(batches):
        tables, memo = worker_model(model.value)
        for batch in batches:
            row = 0
            for flat, counts in tables.encode_blocks(batch.column(batch.schema.get_field_index(text)), memo):
                part = batch.slice(row, len(counts))
                row += len(counts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32))))
                if decoded:
                    columns.append(_texts(*tables.decode_bytes(flat, counts)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(lean(run, keeps=True), schema)


def decode_ids(docs: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that a list of ids stands for, as the library decodes it; null and empty lists give an empty text.

    A worker decodes about ``DECODE_IDS`` ids at a time; a longer list stays whole. Rows (repeated ones too),
    their order and all other columns stay; an input column named ``out`` is replaced; an empty table stays empty.
    """
    model = _shipped(docs, model_path)
    docs = docs.drop(out)
    names, schema = docs.columns, docs.select("*").schema.add(out, "string", False)

    def run(batches):
        tables, _ = worker_model(model.value)
        for batch in batches:
            i, ends = 0, np.cumsum(_counts(batch.column(ids)))
            while i < batch.num_rows:
                before = int(ends[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(ends, before + DECODE_IDS, side="right")))
                part = batch.slice(i, j - i)
                data, sizes = tables.decode_bytes(*_lists(part.column(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(data, sizes)], names=[*names, out])
                i = j

    return docs.mapInArrow(lean(run, keeps=True), schema)


def piece_digests(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded again.

    A null text is an empty one. One row per input row, repeated rows and null ids included; other columns are left out.
    """
    model = _shipped(docs, model_path)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        tables, memo = worker_model(model.value)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for flat, counts in tables.encode_blocks(batch.column(text), memo):
                n.append(counts)
                ids_sha += _digests(*tables.id_lists(flat, counts), tail=1)
                text_sha += _digests(*tables.decode_bytes(flat, counts), tail=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(n) if n else [], pa.int64()),
                 pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text).mapInArrow(lean(run, keeps=True), schema)


def _digests(data: np.ndarray, sizes: np.ndarray, tail: int) -> list[str]:
    """SHA-256 of each stretch, without its last ``tail`` bytes."""
    view, ends = memoryview(np.ascontiguousarray(data)), np.cumsum(sizes).tolist()
    return [hashlib.sha256(view[e - n : max(e - tail, e - n)]).hexdigest() for e, n in zip(ends, sizes.tolist())]


def _counts(column: pa.Array) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), _counts(column)


def _texts(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    large = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    return large.cast(pa.string())


def _shipped(docs: DataFrame, path: str):
    """The model file, read on the driver and sent to each executor once (well under a megabyte)."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())
