"""Static binary-fuse filters (Graf and Lemire, 2022): 8-bit fingerprints at three places of overlapping segments."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from glossa.llm.words import mix


@dataclass(frozen=True)
class FuseFilter:
    """A built filter. Holds every key it was built from; holds another with a chance of about 1/256."""

    seed: int
    segment: int    # length of a segment, a power of two
    segments: int   # segments that a first place may lie in
    prints: np.ndarray

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys + np.uint64(self.seed))
        first = ((h >> np.uint64(32)) * np.uint64(self.segments * self.segment)) >> np.uint64(32)
        mask = np.uint64(self.segment - 1)
        second = (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * self.segment)) ^ (h & mask)
        mark = mix(h ^ np.uint64(0x9E3779B97F4A7C15)).astype(np.uint8)
        return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64), mark

    def holds(self, keys: np.ndarray) -> np.ndarray:
        a, b, c, mark = self.places(keys)
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == mark


def build(keys: np.ndarray) -> FuseFilter:
    """Filter of distinct uint64 keys, by peeling places that a single key is left at."""
    n = len(keys)
    segment = 1 << max(2, min(18, math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    segments = max(1, -(-round(n * factor) // segment) - 2)
    for attempt in range(1, 200):
        shape = FuseFilter(int(mix(np.array([attempt], dtype=np.uint64))[0]), segment, segments,
                           np.zeros((segments + 2) * segment, dtype=np.uint8))
        rounds = _peel(shape, keys)
        if rounds is not None:
            _fill(shape, keys, rounds)
            return shape
        if attempt % 10 == 0:
            segments += max(1, segments // 10)
    raise ValueError("the keys are not distinct")


def _peel(shape: FuseFilter, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Keys in the order of peeling, by round, with the place each one had alone; None if a core is left."""
    where = np.stack(shape.places(keys)[:3])
    size, number = len(shape.prints), np.arange(len(keys))
    count = np.bincount(where.ravel(), minlength=size)
    held = np.zeros(size, dtype=np.int64)  # exclusive or of the numbers of the keys at a place
    for row in where:
        np.bitwise_xor.at(held, row, number)
    alone, rounds, left = np.flatnonzero(count == 1), [], len(keys)
    while len(alone):
        who, at = np.unique(held[alone], return_index=True)
        rounds.append((who, alone[at]))
        left -= len(who)
        touched = where[:, who].ravel()
        np.subtract.at(count, touched, 1)
        np.bitwise_xor.at(held, touched, np.tile(who, 3))
        touched = np.unique(touched)
        alone = touched[count[touched] == 1]
    return rounds if left == 0 else None


def _fill(shape: FuseFilter, keys: np.ndarray, rounds: list[tuple[np.ndarray, np.ndarray]]) -> None:
    for who, place in reversed(rounds):
        a, b, c, mark = shape.places(keys[who])
        shape.prints[place] = 0
        shape.prints[place] = mark ^ shape.prints[a] ^ shape.prints[b] ^ shape.prints[c]
