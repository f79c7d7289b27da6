"""Token counts under a unigram model, by dynamic programming shared along a trie of pre-tokens."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from glossa.llm.bpe import SPACE, _shipped
from glossa.llm.words import Memo, hash_spans, mix, spaced_chunks, text_blocks, with_space, worker_state

_STEP = 0x9E3779B97F4A7C15 | 1
UNKNOWN_PENALTY = 10.0  # nats by which a sign outside the vocabulary costs more than the dearest piece


class UnigramTrie:
    """Least-cost segmentations into the pieces of a vocabulary.

    The vocabulary files give an order of pieces, not probabilities; a piece of
    rank r (from 0) gets Zipf's probability, proportional to 1 / (r + 1). Costs are
    whole micro-nats, so sums are exact. Of segmentations with equal cost the one
    with fewer tokens counts. A sign outside the vocabulary is one token for each
    of its UTF-8 bytes.
    """

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        ranked = [sp.id_to_piece(i) for i in sorted(plain, key=lambda i: (-sp.get_score(i), i))]
        total = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
        self.cost = {p: round(1e6 * (math.log(r + 1) + total)) for r, p in enumerate(ranked)}
        self.longest = max(map(len, ranked))
        self.unknown = max(self.cost.values()) + round(1e6 * UNKNOWN_PENALTY)
        hashes = np.array([self._hash(p) for p in self.cost], dtype=np.uint64)
        order = np.argsort(hashes)
        self.keys, self.costs = hashes[order], np.array(list(self.cost.values()), dtype=np.int64)[order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have the same hash")
        self.known = np.zeros(0x110000, dtype=bool)
        for p in self.cost:
            if len(p) == 1:
                self.known[ord(p)] = True
        self.power = np.array([pow(_STEP, n, 1 << 64) for n in range(self.longest + 1)], dtype=np.uint64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _STEP + int(mix(np.array([ord(c) + 1], dtype=np.uint64))[0])) % (1 << 64)
        return h

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word. Words are put in a trie; a prefix that several share is scored once."""
        order = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)
        lengths = np.array([len(words[i]) for i in order], dtype=np.int64)
        points = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        out = np.zeros(len(words), dtype=np.int64)
        # Trie nodes of one depth: the path's hash, the best cost and tokens, and those of
        # the ancestors at distance 1, 2, ... that a piece may start from.
        active = np.arange(len(words))
        node = np.zeros(len(words), dtype=np.int64)
        path = np.zeros((1, 1), dtype=np.uint64)
        cost, tokens = np.zeros((1, 1), dtype=np.int64), np.zeros((1, 1), dtype=np.int64)
        depth = 0
        while True:
            ended = lengths[active] == depth
            out[order[active[ended]]] = tokens[node[ended], 0]
            active, parent = active[~ended], node[~ended]
            if not len(active):
                return out
            sign = points[begins[active] + depth]
            new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (sign[1:] != sign[:-1])])
            node = np.cumsum(new) - 1
            above, sign = parent[new], sign[new]
            path, cost, tokens = self._grow(path[above], cost[above], tokens[above], sign)
            depth += 1

    def _grow(self, path: np.ndarray, cost: np.ndarray, tokens: np.ndarray, sign: np.ndarray):
        """Scores of nodes one sign deeper, from the rows of their parents (nearest ancestor first)."""
        here = path[:, 0] * np.uint64(_STEP) + mix(sign.astype(np.uint64) + np.uint64(1))
        reach = path.shape[1]
        ends = here[:, None] - path * self.power[1 : reach + 1]  # hash of the last 1, 2, ... signs
        at = np.searchsorted(self.keys, ends)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == ends
        never = np.int64(1) << 62
        total = np.where(found, cost + self.costs[at], never)
        number = tokens + 1
        strange = ~self.known[sign]
        width = 1 + (sign > 0x7F) + (sign > 0x7FF) + (sign > 0xFFFF)
        total[strange, 0] = cost[strange, 0] + self.unknown
        number[strange, 0] = tokens[strange, 0] + width[strange]
        best = total.min(axis=1)
        fewest = np.where(total == best[:, None], number, never).min(axis=1)
        keep = min(reach, self.longest - 1)
        return (np.column_stack([here, path[:, :keep]]), np.column_stack([best, cost[:, :keep]]),
                np.column_stack([fewest, tokens[:, :keep]]))


def worker_trie(model: bytes) -> tuple[UnigramTrie, Memo]:
    return worker_state("counts", model, lambda m: (UnigramTrie(m), Memo(np.int64)))


def _count_column(trie: UnigramTrie, memo: Memo, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    tokens, words = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for _, data, offsets in text_blocks(column):
        empty = offsets[1:] == offsets[:-1]
        data, offsets = with_space(data, offsets)
        space = data == 0x20
        breaks = space.copy()
        breaks[1:] &= ~space[:-1] & (data[:-1] != 0x81)  # 0x81 may end the sign that stands for a space
        starts, ends, number = spaced_chunks(data, offsets, breaks)

        def make(rows):
            texts = [data[a:b].tobytes().decode().replace(" ", SPACE) for a, b in zip(starts[rows].tolist(), ends[rows].tolist())]
            return trie.counts(texts), np.ones(len(rows), dtype=np.int64)

        slots = memo.find(hash_spans(data, starts, ends), make)
        sums = np.concatenate([[0], np.cumsum(memo.flat[slots])])
        bounds = np.concatenate([[0], np.cumsum(number)])
        tokens.append(np.where(empty, 0, np.diff(sums[bounds])))
        words.append(np.where(empty, 0, number))
    return np.concatenate(tokens), np.concatenate(words)


def count_tokens(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add n_tokens and n_words (pre-tokens) to documents.

    The text gets a leading space and every space counts as the sign of the
    vocabulary for it. A pre-token is a run of spaces with the signs up to the
    next one; no piece reaches across their border, so the least-cost
    segmentations of the pre-tokens make up that of the whole text. Null and empty
    texts have no tokens. Rows, order and other columns stay; input columns named
    n_tokens or n_words are replaced. Each worker scores a distinct pre-token once;
    nothing is shuffled.
    """
    model = _shipped(docs, model_path)
    docs = docs.drop("n_tokens", "n_words")
    names = docs.columns
    schema = docs.select("*").schema.add("n_tokens", "long", False).add("n_words", "long", False)

    def run(batches):
        trie, memo = worker_trie(model.value)
        for batch in batches:
            tokens, words = _count_column(trie, memo, batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens), pa.array(words)],
                                             names=[*names, "n_tokens", "n_words"])

    return docs.mapInArrow(run, schema)
