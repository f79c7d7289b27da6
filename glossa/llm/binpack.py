"""Training sequences by vector bin packing: tokens, segments and loss-bearing tokens are limited at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from glossa.llm.packing import worker_encoder

POOL = 1024          # examples that wait in a task for a sequence that they fit
FLUSH_IDS = 1 << 18  # ids that a task gathers before it hands rows on


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold; every example takes one segment for each of its pieces."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit of a sequence is at least one")


class Piece(NamedTuple):
    """A stretch of an example's ids, the first ``plain`` of which bear no loss."""

    key: object
    start: int
    ids: np.ndarray
    plain: int
    total: int

    @property
    def loss(self) -> int:
        return max(0, len(self.ids) - self.plain)

    def cut(self, at: int) -> tuple["Piece", "Piece"]:
        return (self._replace(ids=self.ids[:at], plain=min(self.plain, at)),
                self._replace(start=self.start + at, ids=self.ids[at:], plain=max(0, self.plain - at)))


class Packer:
    """Fills one sequence after another from a pool of pieces, which new examples keep full.

    The dot-product heuristic: of the pieces that fit into what is left of the
    open sequence, the one with the largest sum over the limits of
    (share that the piece takes) * (share left) * (average share that the pool's pieces take) goes in.
    """

    def __init__(self, limits: Limits, fill: int | None, pool: int = POOL) -> None:
        self.limits, self.fill, self.most = limits, fill, pool
        room = pool + limits.segments + 2
        self.size, self.loss = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int64)
        self.held: list[Piece | None] = [None] * room
        self.free = list(range(room - 1, -1, -1))

    def __len__(self) -> int:
        return len(self.held) - len(self.free)

    def _keep(self, piece: Piece) -> None:
        slot = self.free.pop()
        self.held[slot] = piece._replace(ids=piece.ids.copy())  # lets go of the block that the ids came in
        self.size[slot], self.loss[slot] = len(piece.ids), piece.loss

    def _take(self, slot: int) -> Piece:
        piece, self.held[slot], self.size[slot] = self.held[slot], None, 0
        self.free.append(slot)
        return piece

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take in an example; yields the sequences that are finished by it."""
        most = self.limits
        while len(piece.ids) > most.tokens or piece.loss > most.loss:
            head, piece = piece.cut(min(most.tokens, piece.plain + most.loss))
            if len(head.ids) == most.tokens:
                yield [head]
            else:
                self._keep(head)
                yield from self._full()
        self._keep(piece)
        yield from self._full()

    def _full(self) -> Iterator[list[Piece]]:
        while len(self) >= self.most:
            yield self._sequence()

    def finish(self) -> Iterator[list[Piece]]:
        """Empty the pool. What does not fill a sequence ends up in sequences of powers of two, if pieces may be cut."""
        while len(self):
            row = self._sequence()
            size = sum(len(p.ids) for p in row)
            while self.fill is not None and size < self.limits.tokens and size & (size - 1):
                first, row = _parted(row, 1 << (size.bit_length() - 1))
                yield first
                size -= sum(len(p.ids) for p in first)
            yield row

    def _sequence(self) -> list[Piece]:
        most = self.limits
        tokens, segments, loss = most.tokens, most.segments, most.loss
        by_size = self.size.sum() / most.tokens / most.tokens ** 2
        by_loss = self.loss[self.size > 0].sum() / most.loss / most.loss ** 2
        row: list[Piece] = []
        while segments and tokens:
            # A segment is a segment for every piece, so its term of the sum is the same for all and left out.
            score = self.size * (by_size * tokens) + self.loss * (by_loss * loss)
            score[(self.size == 0) | (self.size > tokens) | (self.loss > loss)] = -1
            best = int(score.argmax())
            if score[best] < 0:
                break
            piece = self._take(best)
            row.append(piece)
            tokens, segments, loss = tokens - len(piece.ids), segments - 1, loss - piece.loss
        if self.fill is None or tokens < self.fill or not len(self):
            return row
        if segments:  # nothing fits whole: the head of a waiting piece fills the rest
            heads = np.where(self.size > 0, np.minimum(self.size - self.loss + loss, tokens), 0)
            best = int(heads.argmax())
            if heads[best] > 0:
                head, tail = self._take(best).cut(int(heads[best]))
                self._keep(tail)
                row.append(head)
                tokens -= len(head.ids)
        size = most.tokens - tokens
        if tokens >= self.fill and size & (size - 1):  # no segment or loss is left: end at a power of two
            row, rest = _parted(row, 1 << (size.bit_length() - 1))
            for piece in rest:
                self._keep(piece)
        return row


def _parted(row: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``size`` ids of a sequence and the rest; one piece may be cut for it."""
    first = []
    for i, piece in enumerate(row):
        if len(piece.ids) > size:
            head, tail = piece.cut(size) if size else (None, piece)
            return first + ([head] if head else []), [tail, *row[i + 1:]]
        first.append(piece)
        size -= len(piece.ids)
    return first, []


def pack_examples(examples: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 1,
                  text: str = "text", prompt: str | None = None, key: str = "doc_id", fill: int | None = 16) -> DataFrame:
    """Encode examples and place them in sequences within all limits; one row per piece of an example.

    An example's ids are those of its ``prompt`` column, if one is named, of its
    ``text``, and ``end_id``. Null texts and prompts are empty, so no example is without
    an id; the prompt's ids bear no loss, all others do. Returned: ``key``, start (ids of
    the example before the piece), length, ids (little-endian unsigned 32-bit, as bytes),
    loss_tokens, doc_tokens (ids of the whole example), sequence_id, segment and offset (place
    in the sequence, in pieces and in ids). Each row is an example of its own, whether or not its
    key or text is repeated or null; other columns are left out; an empty table gives no rows.

    Every task packs the examples of its own input partition, in their order, by the
    dot-product heuristic out of a pool of ``POOL`` waiting ones: no shuffle, and a repeated
    task gives the same sequences. An example above a limit is cut. If ``fill`` ids or more
    stay free in a sequence and nothing fits, a waiting example is cut to fill them, and what is
    left at the end of a task, or when a sequence has no segment or loss left, is cut to powers of two,
    which need no padding. With ``fill`` None only examples above a limit are cut.
    ``sequence_id`` holds the partition's number in its upper 32 bits.
    """
    with open(tokenizer_path, "rb") as f:
        tokenizer = examples.sparkSession.sparkContext.broadcast(f.read())
    columns = [key, text] + ([prompt] if prompt else [])

    def run(batches):
        encoder, packer = worker_encoder(tokenizer.value), Packer(limits, fill)
        out = None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out = out or _Rows(key, batch.column(0).type, TaskContext.get().partitionId())
            for row, flat, counts in encoder.encode_blocks(batch.column(1)):
                ends = np.cumsum(counts)
                before = _prompts(encoder, batch.column(2).slice(row, len(counts))) if prompt else None
                for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                    lead = before[i] if prompt else np.zeros(0, dtype=np.int32)
                    ids = np.concatenate([lead, flat[a:b], [end_id]]).astype("<u4")
                    for done in packer.add(Piece(keys[row + i], 0, ids, len(lead), len(ids))):
                        yield from out.add(done)
        for done in packer.finish():
            yield from out.add(done)
        if out:
            yield from out.flush()

    schema = examples.select(key).schema
    for name, kind in [("start", "long"), ("length", "long"), ("ids", "binary"), ("loss_tokens", "long"),
                       ("doc_tokens", "long"), ("sequence_id", "long"), ("segment", "integer"), ("offset", "long")]:
        schema = schema.add(name, kind)
    return examples.select(*columns).mapInArrow(run, schema)


def _prompts(encoder, column: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, flat, counts in encoder.encode_blocks(column):
        out += np.split(flat, np.cumsum(counts)[:-1])
    return out


class _Rows:
    """Pieces of finished sequences, handed on as Arrow batches of bounded size."""

    def __init__(self, key: str, kind: pa.DataType, part: int) -> None:
        self.kind = kind
        self.names = [key, "start", "length", "ids", "loss_tokens", "doc_tokens", "sequence_id", "segment", "offset"]
        self.next, self.rows, self.ids = part << 32, [], 0

    def add(self, sequence: list[Piece]) -> Iterator[pa.RecordBatch]:
        offset = 0
        for segment, p in enumerate(sequence):
            self.rows.append((p.key, p.start, len(p.ids), p.ids.tobytes(), p.loss, p.total, self.next, segment, offset))
            offset += len(p.ids)
        self.next += 1
        self.ids += offset
        if self.ids >= FLUSH_IDS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            types = [self.kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), types)], names=self.names)
        self.rows, self.ids = [], 0
