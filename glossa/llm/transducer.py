"""Minimal acyclic transducers: sorted terms as a smallest automaton whose arcs add up to a term's place."""

from __future__ import annotations

import io
import os
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs

CELLS = 1 << 21          # states times different bytes of one transducer: 8 MB for each of its two tables
LOADED_CELLS = 1 << 23   # of all transducers that a worker holds


class Builder:
    """Takes terms (bytes) in ascending order and merges equal suffixes as soon as they are complete."""

    def __init__(self) -> None:
        self.known: dict = {}                      # (final, arcs) of a finished state -> its number
        self.arcs: list = []                       # of finished states: (final, ((byte, state), ...))
        self.words: list[int] = []                 # terms that can be read from a finished state on
        self.path = [[False, []]]                  # states of the last term, not finished yet
        self.last, self.bytes, self.terms = None, set(), 0

    def cells(self) -> int:
        return (len(self.arcs) + len(self.path)) * (len(self.bytes) + 1)

    def add(self, term: bytes) -> None:
        if self.last is not None and term <= self.last:
            raise ValueError("terms must come in ascending order")
        last = self.last or b""
        same = len(os.path.commonprefix([last, term]))
        self._finish(same)
        self.path += [[False, []] for _ in term[same:]]
        self.path[-1][0] = True
        self.bytes.update(term[same:])
        self.last = term
        self.terms += 1

    def _finish(self, depth: int) -> None:
        """Replace the states of the last term below ``depth`` by finished ones."""
        while len(self.path) - 1 > depth:
            final, arcs = self.path.pop()
            self.path[-1][1].append((self.last[len(self.path) - 1], self._state(final, tuple(arcs))))

    def _state(self, final: bool, arcs: tuple) -> int:
        number = self.known.get((final, arcs))
        if number is None:
            number = self.known[final, arcs] = len(self.arcs)
            self.arcs.append((final, arcs))
            self.words.append(final + sum(self.words[s] for _, s in arcs))
        return number

    def done(self) -> bytes:
        """The transducer: an arc's output is the number of terms that come before those read through it."""
        self._finish(0)
        self._state(self.path[0][0], tuple(self.path[0][1]))  # the root is the last state
        rows = []
        for state, (final, arcs) in enumerate(self.arcs):
            before = int(final)
            for byte, child in arcs:
                rows.append((state, byte, child, before))
                before += self.words[child]
        out = io.BytesIO()
        np.savez(out, arcs=np.array(rows, dtype=np.int32).reshape(-1, 4), final=np.array([f for f, _ in self.arcs], dtype=bool))
        return out.getvalue()


class Transducer:
    """Reads many terms at once, one byte of all of them at a step."""

    def __init__(self, data: bytes) -> None:
        with np.load(io.BytesIO(data)) as kept:
            arcs, self.final = kept["arcs"], kept["final"]
        used = np.unique(arcs[:, 1])
        self.width = len(used) + 1
        self.code = np.zeros(256, dtype=np.int64)  # code 0: a byte that no term has
        self.code[used] = np.arange(1, len(used) + 1)
        self.next = np.full(len(self.final) * self.width, -1, dtype=np.int32)
        self.skip = np.zeros(len(self.final) * self.width, dtype=np.int32)
        cell = arcs[:, 0].astype(np.int64) * self.width + self.code[arcs[:, 1]]
        self.next[cell], self.skip[cell] = arcs[:, 2], arcs[:, 3]
        self.root = len(self.final) - 1
        self.byte = np.concatenate([[0], used])

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each byte span [start, end) among the terms, or -1."""
        out = np.full(len(starts), -1, dtype=np.int64)
        at, left, pos = np.arange(len(starts)), ends - starts, starts
        state, total = np.full(len(starts), self.root, dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        while len(at):
            over = left == 0
            if over.any():
                out[at[over]] = np.where(self.final[state[over]], total[over], -1)
                go = ~over
                at, left, pos, state, total = at[go], left[go], pos[go], state[go], total[go]
            cell = state * self.width + self.code[data[pos]]
            state, total = self.next[cell].astype(np.int64), total + self.skip[cell]
            go = state >= 0
            at, left, pos, state, total = at[go], left[go] - 1, pos[go] + 1, state[go], total[go]
        return out

    def term(self, ordinal: int) -> bytes:
        """The term at a place."""
        out, state = bytearray(), self.root
        while not (self.final[state] and ordinal == 0):
            row = slice(state * self.width, (state + 1) * self.width)
            fits = np.flatnonzero((self.next[row] >= 0) & (self.skip[row] <= ordinal))
            arc = fits[np.argmax(self.skip[row][fits])]
            out.append(int(self.byte[arc]))
            ordinal -= int(self.skip[row][arc])
            state = int(self.next[row][arc])
        return bytes(out)


def write_file(path: str, data: bytes) -> None:
    """Put a file in place at once, so that a repeated task replaces it whole."""
    store, where = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(where), recursive=True)
    part = f"{where}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, where)


def prefix_number(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span as a number that sorts like them; short spans end in zeros."""
    out = np.zeros(len(starts), dtype=np.uint64)
    last = max(len(data) - 1, 0)
    for i in range(8):
        at = starts + i
        byte = np.where(at < ends, data[np.minimum(at, last)] if len(data) else 0, 0).astype(np.uint64)
        out = (out << np.uint64(8)) | byte
    return out


class Vocabulary:
    """Transducers of one or more languages, read from their files when a term may be in them.

    ``shards`` lists (lang, first term, place of the first term, path) in order. A worker holds tables
    of at most ``LOADED_CELLS`` cells and the one in use.
    """

    def __init__(self, shards: list[tuple[str, bytes, int, str]]) -> None:
        self.shards: dict[str, list] = {}
        for lang, first, start, path in shards:
            self.shards.setdefault(lang, []).append((first, start, path))
        self.keys = {}
        for lang, own in self.shards.items():
            data = np.frombuffer(b"".join(f for f, _, _ in own), dtype=np.uint8)
            ends = np.cumsum([len(f) for f, _, _ in own])
            self.keys[lang] = prefix_number(data, ends - [len(f) for f, _, _ in own], ends)
        self.loaded: OrderedDict[str, Transducer] = OrderedDict()

    def _load(self, path: str) -> Transducer:
        if path in self.loaded:
            self.loaded.move_to_end(path)
            return self.loaded[path]
        store, where = fs.FileSystem.from_uri(path)
        with store.open_input_file(where) as f:
            made = Transducer(f.read())
        while self.loaded and sum(len(t.next) for t in self.loaded.values()) + len(made.next) > LOADED_CELLS:
            self.loaded.popitem(last=False)
        self.loaded[path] = made
        return made

    def ordinals(self, lang: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each span among the language's terms, or -1."""
        out = np.full(len(starts), -1, dtype=np.int64)
        if lang not in self.shards or not len(starts):
            return out
        keys, firsts = prefix_number(data, starts, ends), self.keys[lang]
        low = np.maximum(np.searchsorted(firsts, keys, side="left") - 1, 0)
        high = np.searchsorted(firsts, keys, side="right") - 1
        for i, (_, start, path) in enumerate(self.shards[lang]):
            rows = np.flatnonzero((low <= i) & (i <= high) & (out < 0))
            if len(rows):
                got = self._load(path).ordinals(data, starts[rows], ends[rows])
                out[rows] = np.where(got < 0, -1, got + start)
        return out

    def term(self, lang: str, ordinal: int) -> bytes:
        own = self.shards[lang]
        i = int(np.searchsorted([s for _, s, _ in own], ordinal, side="right")) - 1
        return self._load(own[i][2]).term(ordinal - own[i][1])
