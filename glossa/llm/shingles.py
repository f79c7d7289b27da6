"""Word shingles of texts as 64-bit hashes, over flat Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from glossa.llm.words import hash_spans, mix, spaced_chunks, text_blocks

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array, size: int, short: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Distinct shingles of ``size`` words of each text, sorted: first row, flat hashes and counts of a run of rows.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text of fewer words
    has its whole sequence as one shingle if ``short``, else none; a text without
    words, or null, has none.
    """
    for row, data, offsets in text_blocks(column):
        data = _LOWER[data]
        white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        breaks = np.zeros(len(data), dtype=bool)
        breaks[1:] = white[1:] != white[:-1]
        starts, ends, chunks = spaced_chunks(data, offsets, breaks)
        word = ~white[starts] if len(starts) else np.zeros(0, dtype=bool)
        bounds = np.concatenate([[0], np.cumsum(word)])[np.concatenate([[0], np.cumsum(chunks)])]
        hashes = hash_spans(data, starts[word], ends[word])
        words = np.diff(bounds)
        owner = np.repeat(np.arange(len(words)), words)
        if len(hashes) >= size:
            last = len(hashes) - size + 1
            whole = hashes[:last].copy()
            for k in range(1, size):
                whole = whole * _STEP + hashes[k : last + k]
            inside = owner[:last] == owner[size - 1 :]
            whole, owned = mix(whole)[inside], owner[:last][inside]
        else:
            whole, owned = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        if short:
            few = np.flatnonzero((words > 0) & (words < size))
            if len(few):
                made = [_sequence(hashes[bounds[i] : bounds[i + 1]]) for i in few]
                whole, owned = np.concatenate([whole, np.array(made, dtype=np.uint64)]), np.concatenate([owned, few])
        order = np.lexsort((whole, owned))
        whole, owned = whole[order], owned[order]
        new = np.ones(len(whole), dtype=bool)
        new[1:] = (whole[1:] != whole[:-1]) | (owned[1:] != owned[:-1])
        yield row, whole[new], np.bincount(owned[new], minlength=len(words))


def _sequence(hashes: np.ndarray) -> int:
    h = np.array([len(hashes)], dtype=np.uint64)
    for x in hashes:
        h = mix(h * _STEP + x)
    return int(h[0])
