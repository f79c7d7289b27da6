"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.words import Memo, hash_spans, lean, spaced_chunks, text_blocks, worker_state

UNKNOWN = "und"
HIDDEN = 20
DOCS_PER_LANG = 300   # bound of the training sample: documents of each language,
WORDS_PER_DOC = 60    # and different words (pieces of long ones) of each, spread over its whole text
PIECE = 32            # bytes of a word that the network reads at once; longer words are read in pieces
_SHARES = 1 << 20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteNetwork:
    """Two gated recurrent layers, one per direction, and a softmax over languages at every byte."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (257, 3 * hidden))          # a byte's input to update, reset, candidate
            p[f"u{d}"] = rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden))
            p[f"c{d}"] = np.zeros(3 * hidden)
        p["o"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, len(langs)))
        p["b"] = np.zeros(len(langs))
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _layer(self, d: str, codes: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States of one direction, (time, rows, hidden); padding (code 256) leaves the state as it is."""
        h3, n = self.p[f"x{d}"], self.hidden
        u, c = self.p[f"u{d}"], self.p[f"c{d}"]
        steps, rows = codes.shape
        out = np.zeros((steps, rows, n), dtype=np.float32)
        h = np.zeros((rows, n), dtype=np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, g = h3[codes[t]] + c, h @ u
            gates = _sigmoid(x[:, : 2 * n] + g[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            cand = np.tanh(x[:, 2 * n :] + r * g[:, 2 * n :])
            m = mask[t][:, None]
            new = cand + z * (h - cand)
            if trace is not None:
                trace.append((t, h, z, r, cand, g[:, 2 * n :]))
            h = np.where(m, new, h)
            out[t] = h
        return out

    def _softmax(self, states: np.ndarray) -> np.ndarray:
        y = states @ self.p["o"] + self.p["b"]
        y = np.exp(y - y.max(axis=-1, keepdims=True))
        return y / y.sum(axis=-1, keepdims=True)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """(time, rows, languages) of byte codes (time, rows), padded with 256."""
        mask = codes < 256
        both = np.concatenate([self._layer("f", codes, mask), self._layer("b", codes, mask)], axis=2)
        return self._softmax(both) * mask[:, :, None]

    def gradients(self, codes: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions against their row's language, by backpropagation through time."""
        mask, n = codes < 256, self.hidden
        traces: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._layer(d, codes, mask, traces[d]) for d in "fb"], axis=2)
        y = self._softmax(both)
        count = max(1, int(mask.sum()))
        picked = np.take_along_axis(y, np.broadcast_to(label[None, :, None], (*codes.shape, 1)), axis=2)[..., 0]
        loss = float(-(np.log(picked + 1e-9) * mask).sum() / count)
        dy = y.copy()
        dy[:, np.arange(len(label)), label] -= 1
        dy *= (mask / count)[:, :, None].astype(np.float32)
        flat = both.reshape(-1, 2 * n)
        grad = {"o": flat.T @ dy.reshape(-1, dy.shape[2]), "b": dy.sum(axis=(0, 1))}
        dboth = dy @ self.p["o"].T
        for d, part in (("f", dboth[:, :, :n]), ("b", dboth[:, :, n:])):
            u = self.p[f"u{d}"]
            gx, gu = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u)
            gc, dh = np.zeros_like(self.p[f"c{d}"]), np.zeros((codes.shape[1], n), dtype=np.float32)
            for t, h, z, r, cand, gn in reversed(traces[d]):
                m = mask[t][:, None]
                dh = dh + part[t]
                dnew = np.where(m, dh, 0)
                dcand = dnew * (1 - z) * (1 - cand * cand)
                da = np.concatenate([dnew * (h - cand) * z * (1 - z), dcand * gn * r * (1 - r), dcand], axis=1)
                dg = da.copy()
                dg[:, 2 * n :] *= r
                np.add.at(gx, codes[t], da)
                gu += h.T @ dg
                gc += da.sum(axis=0)
                dh = np.where(m, dnew * z + dg @ u.T, dh)
            grad |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return loss, grad

    def train(self, words: list[bytes], labels: np.ndarray, steps: int = 400, batch: int = 512, rate: float = 0.01,
              seed: int = 7) -> "ByteNetwork":
        """Adam over shuffled batches of words of like length."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        lengths = np.array([len(w) for w in words])
        step = 0
        while step < steps:
            order = rng.permutation(len(words))
            order = order[np.argsort(lengths[order] // 3, kind="stable")]
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            for g in rng.permutation(len(groups))[: steps - step]:
                rows = groups[g]
                _, grad = self.gradients(pad([words[i] for i in rows]), labels[rows])
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for k, v in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.p[k] = (self.p[k] - now * (first[k] / (1 - 0.9 ** step))
                                 / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        return self


def pad(words: list[bytes]) -> np.ndarray:
    out = np.full((len(words), max(map(len, words))), 256, dtype=np.int64)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w, dtype=np.uint8)
    return np.ascontiguousarray(out.T)


# Words of a text. A space stands on both sides, as it does in running text.

def _pieces(word: bytes) -> list[bytes]:
    """The word in runs of at most 32 bytes, cut between characters."""
    word = b" " + word + b" "
    out, i = [], 0
    while len(word) - i > PIECE:
        j = next((j for j in range(i + PIECE, i + PIECE - 4, -1) if word[j] & 0xC0 != 0x80), i + PIECE)
        out.append(word[i:j])
        i = j
    return [*out, word[i:]]


def _text_pieces(text: str | None) -> list[str]:
    """Different pieces with a letter of all words of a text."""
    words = set(re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()))
    pieces = {p.decode(errors="replace") for w in words for p in _pieces(w)}
    return sorted(p for p in pieces if any(c.isalpha() for c in p))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train_model(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, words_per_doc: int = WORDS_PER_DOC,
                text: str = "text", lang: str = "lang", **training) -> ByteNetwork | None:
    """Fit the network on a bounded, balanced sample of labelled rows; None without any.

    ``docs`` holds the rows that may be learned from. Of every language the
    ``docs_per_lang`` documents with the least hash of their id are taken, of
    each the ``words_per_doc`` words with the least hash out of the whole text.
    Words longer than the network reads at once count by the pieces that
    ``predict_language`` reads, so texts written without spaces are learned from
    as well. Only these words and pieces come to the driver.
    """
    usable = docs.where(F.col(lang).isNotNull() & has_letter(F.col(text)))
    # A hash share of each language's rows, about 16 times as many as are wanted, is ranked: one row per language is broadcast.
    sizes = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("docs"))
    drawn = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(_SHARES)) * F.col("docs") < F.lit(16 * docs_per_lang * _SHARES)
    chosen = (usable.select(F.col(lang).alias("lang"), F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("h"))
              .join(F.broadcast(sizes), "lang").where(drawn)
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id")))
              .where(F.col("rank") <= docs_per_lang).select(F.col("id").alias("_id"), F.col("lang").alias("_lang")))
    picked = usable.select("doc_id", text, lang).join(
        F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col(lang) == F.col("_lang"))).select(
        F.col(lang).alias("lang"), F.lower(F.col(text)).alias("text"))

    def read(batches):
        for batch in batches:
            pieces = [_text_pieces(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(pieces, pa.list_(pa.string()))], names=["lang", "pieces"])

    seen = picked.mapInArrow(lean(read), f"lang {dict(docs.dtypes)[lang]}, pieces array<string>")
    words = F.transform(F.slice(F.array_sort(F.transform(
        "pieces", lambda w: F.struct(F.xxhash64(F.trim(w)).alias("h"), w.alias("w")))), 1, words_per_doc), lambda s: s["w"])
    sample = seen.select("lang", words.alias("words")).collect()
    langs = sorted({r["lang"] for r in sample})
    rows = sorted((r["lang"], w) for r in sample for w in r["words"])
    if not rows:
        return None
    number = {name: i for i, name in enumerate(langs)}
    return ByteNetwork(langs).train([w.encode() for _, w in rows],
                                    np.array([number[name] for name, _ in rows]), **training)


def _worker(packed: bytes) -> tuple[ByteNetwork, Memo]:
    return worker_state("language", packed, lambda p: (pickle.loads(p), Memo(np.float32)))


def _word_sums(model: ByteNetwork, words: list[bytes]) -> np.ndarray:
    """Per word the sums over its positions of each language's probability, and the number of positions."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        if _LETTER[np.frombuffer(w, dtype=np.uint8)].any():
            own = _pieces(w)
            pieces += own
            owner += [i] * len(own)
    sums = np.zeros((len(words), len(model.langs) + 1), dtype=np.float32)
    owner = np.array(owner, dtype=np.int64)
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    for i in range(0, len(order), 4096):
        rows = order[i : i + 4096]
        got = model.probabilities(pad([pieces[r] for r in rows])).sum(axis=0)
        np.add.at(sums, owner[rows], np.column_stack([got, lengths[rows]]).astype(np.float32))
    return sums


def _document_probabilities(model: ByteNetwork, memo: Memo, column: pa.Array) -> np.ndarray:
    """Mean probability of each language over the positions of each text's words; zeros without letters."""
    width = len(model.langs) + 1
    out = [np.zeros((0, width - 1))]
    for _, data, offsets in text_blocks(column):
        white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
        breaks = np.zeros(len(data), dtype=bool)
        breaks[1:] = white[1:] != white[:-1]
        starts, ends, chunks = spaced_chunks(data, offsets, breaks)
        word = ~white[starts]
        bounds = np.concatenate([[0], np.cumsum(word)])[np.concatenate([[0], np.cumsum(chunks)])]
        starts, ends = starts[word], ends[word]

        def make(rows):
            got = _word_sums(model, [data[a:b].tobytes() for a, b in zip(starts[rows].tolist(), ends[rows].tolist())])
            return got.ravel(), np.full(len(rows), width, dtype=np.int64)

        slots = memo.find(hash_spans(data, starts, ends), make)
        table = memo.flat.reshape(-1, width)
        sums = np.zeros((len(offsets) - 1, width))
        filled = np.flatnonzero(np.diff(bounds))
        if len(filled):
            sums[filled] = np.add.reduceat(table[slots].astype(np.float64), bounds[filled], axis=0)
        out.append(sums[:, :-1] / np.maximum(sums[:, -1:], 1))
    return np.concatenate(out)


def predict_language(docs: DataFrame, model: ByteNetwork | None, text: str = "text",
                     out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its score to documents.

    Every byte of every word gets a probability for each language, from the whole
    word (32 bytes at a time) read in both directions. A document's probability is
    the mean over all its positions; the largest, to six digits, is the score,
    ties go to the first language by name. Null texts and texts without a letter are ``und`` with
    score 0, as are all without a model. Rows, order and other columns stay; input
    columns named like the new ones are replaced. A worker reads each distinct
    word once; nothing is shuffled.
    """
    docs = docs.drop(*out)
    if model is None:
        return docs.withColumns({out[0]: F.lit(UNKNOWN), out[1]: F.lit(0.0)})
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    names = docs.columns
    asked = docs.withColumn("__lower", F.when(has_letter(F.col(text)), F.lower(F.col(text))))
    schema = T.StructType([*docs.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])

    def run(batches):
        network, memo = _worker(packed.value)
        langs = np.array(network.langs, dtype=object)
        for batch in batches:
            got = _document_probabilities(network, memo, batch.column("__lower"))
            if not len(got):
                continue
            best = got.argmax(axis=1)
            score = got[np.arange(len(got)), best].round(6)
            known = score > 0
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(np.where(known, langs[best], UNKNOWN), pa.string()),
                 pa.array(np.minimum(score, 1.0), pa.float64())], names=[*names, *out])

    return asked.mapInArrow(lean(run, keeps=True), schema)
