"""Flat numpy views of Arrow text columns, and values that are worked out once per distinct word.

The operators of this package that need Python work on whole Arrow batches: the
texts of a batch are one byte array, words are (start, end) spans of it, and a
word is known by a 64-bit hash of its bytes. Two of the at most two million
distinct words that a worker keeps at once get the same hash with a chance below 1e-6.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLOCK = 1 << 17          # bytes hashed at once, small enough for the caches
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _UNDO = _powers(_BASE), _powers(_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which are sorted and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(int(np.searchsorted(ends, a + _BLOCK, side="right")), i + 1)
        b = int(ends[j - 1])
        if b - a <= _BLOCK:
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data[a:b]] * _POWER[: b - a], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (sums[e] - sums[s]) * _UNDO[s]
        else:  # one word longer than a block
            total = 0
            for k in range(a, b, _BLOCK):
                part = _BYTE[data[k : min(k + _BLOCK, b)]]
                total += int((part * _POWER[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, k - a, 1 << 64)
            out[i] = total % (1 << 64)
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[start : start + length]`` over all pairs."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def text_blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``most`` bytes.

    Yields the first row, the bytes of the run and the offsets of its rows in
    them (one more than rows). Null counts as empty. A text longer than ``most``
    is a run of its own and stays whole.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1, i + 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with one space put before each of them."""
    grown = np.insert(data, offsets[:-1], 0x20)
    return grown, offsets + np.arange(len(offsets))


def spaced_chunks(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans from break to break: ``breaks`` marks bytes that start a chunk; row starts always do.

    Returns starts, ends and the number of chunks of each row.
    """
    marked = breaks.copy()
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    marked[filled] = True
    starts = np.flatnonzero(marked)
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


class Memo:
    """Ragged values of distinct words by hash, emptied when it outgrows ``most`` bytes."""

    def __init__(self, dtype, most: int = 1 << 26) -> None:
        self.dtype, self.most = dtype, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.slot = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=self.dtype)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.slot, self.start, self.length, self.flat))

    def find(self, hashes: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Slot of each word; ``make(rows)`` gives (flat values, lengths) for words seen first in those rows."""
        if self.nbytes > self.most:
            self.clear()
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            rows = first[~known]
            order = np.argsort(rows, kind="stable")  # make sees its words in text order
            flat, length = make(rows[order])
            size, values = len(self.length), len(self.flat)
            self.start = np.concatenate([self.start, values + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, flat.astype(self.dtype, copy=False)])
            slots = np.empty(len(rows), dtype=np.int32)
            slots[order] = size + np.arange(len(rows))
            self.keys = np.insert(self.keys, at[~known], distinct[~known])
            self.slot = np.insert(self.slot, at[~known], slots)
            at = np.searchsorted(self.keys, distinct)
        return self.slot[at][back]

    def values(self, slots: np.ndarray) -> np.ndarray:
        return ragged(self.flat, self.start[slots], self.length[slots])


_STATE: dict = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it


def worker_state(kind: str, shipped: bytes, make: Callable[[bytes], object]):
    """What a Python worker keeps from task to task: ``make(shipped)``, until another operator's task asks.

    Workers are used again by later stages. A worker keeps one operator's tables
    and memo at a time, so its memory does not rise from stage to stage.
    """
    key = kind, hashlib.sha256(shipped).digest()
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make(shipped)
    return _STATE[key]


def forget() -> None:
    """Drop what ``worker_state`` keeps in this process."""
    _STATE.clear()


def give_back() -> None:
    """Return memory that is free to the system; Arrow's and the C library's allocators otherwise keep most of it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(run: Callable, keeps: bool = False) -> Callable:
    """``run`` for mapInArrow, so that a worker is small again when its task ends.

    Idle workers stay beside the executor's JVM for as long as later stages run. Only an
    operator that ``keeps`` finds the tables of the task before it in ``worker_state``.
    """
    def task(batches):
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lean_group(run: Callable) -> Callable:
    """The same for applyInArrow, of a key and a table or of two tables, after each group."""
    def task(first, second):
        forget()
        try:
            return run(first, second)
        finally:
            give_back()

    return task
