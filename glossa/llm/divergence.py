"""Source divergence audit: how far the term use of a language's sources lies apart, in whole numbers."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import lower_ascii, stored
from glossa.llm.transducer import CELLS, Builder, Vocabulary, write_file
from glossa.llm.words import text_blocks, worker_state
from glossa.session import scratch_path

NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10             # documents of a language that a kept term is in
SHARD_TERMS = 1 << 16     # kept terms that one sorted partition is meant for
SCALE = 1_000_000_000
RUN_BYTES = 1 << 22       # text that a worker reads through the transducers at once
HELD_COUNTS = 1 << 20     # counts that a worker gathers before it hands them on
BLOCK_TERMS = 1 << 12     # places of a language whose counts meet in one task,
TILE_SOURCES = 256        # with those of so many sources on each side of a pair
_CHUNK_CELLS = 1 << 20
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


# The kept terms of each language

def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang and term: the terms that at least ``min_docs`` documents of the language hold; null counts as empty.

    Documents are rows. Each row's different terms are counted, summed in the map tasks first.
    """
    terms = F.array_distinct(F.split(lower_ascii(F.col("text")), NO_TERM))
    return (_plain(docs).select("lang", F.explode(terms).alias("term")).where("term != ''")
            .groupBy("lang", "term").agg(F.count(F.lit(1)).alias("docs"))
            .where(F.col("docs") >= min_docs).select("lang", "term"))


def build_vocabulary(kept: DataFrame, cells: int = CELLS) -> tuple[list[tuple[str, bytes, int, str]], dict[str, int]]:
    """Write the minimal transducers of each language's sorted terms.

    Returns (lang, first term, its place, path) of each, in order, and the number of terms of each language.

    The terms are sorted by ranges, so a large language has several transducers; each
    is cut off when its tables reach ``cells``. Only this list, a row per transducer (tens
    of thousands of terms), comes to the driver and is sent to the executors.
    """
    spark = kept.sparkSession
    kept = stored(kept, "kept")
    parts = max(1, -(-kept.count() // SHARD_TERMS))
    folder = scratch_path(spark, "transducers")
    ranged = (kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
              .select(F.spark_partition_id().alias("part"), "lang", F.encode("term", "UTF-8").alias("term")))

    def run(batches):
        builder, lang, first, part, piece = None, None, b"", 0, 0

        def done():
            path = f"{folder}/{part:06d}-{piece:06d}.npz"
            write_file(path, builder.done())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([piece], pa.int32()), pa.array([lang]),
                                               pa.array([first], pa.binary()), pa.array([builder.terms], pa.int64()),
                                               pa.array([path])], names=["part", "piece", "lang", "first", "terms", "path"])

        for batch in batches:
            for p, own, term in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if builder and (own != lang or builder.cells() >= cells):
                    yield done()
                    builder, piece = None, piece + 1
                if builder is None:
                    builder, lang, first, part = Builder(), own, term, p
                builder.add(term)
        if builder:
            yield done()

    schema = "part int, piece int, lang string, first binary, terms bigint, path string"
    rows = stored(ranged.mapInArrow(run, schema), "shards").orderBy("part", "piece").collect()
    places: dict[str, int] = {}
    shards = []
    for r in rows:
        shards.append((r["lang"], bytes(r["first"]), places.get(r["lang"], 0), r["path"]))
        places[r["lang"]] = places.get(r["lang"], 0) + r["terms"]
    return shards, places


# Counting by place

class _Counts:
    """Occurrences by (group, place), added up until they are handed on."""

    def __init__(self) -> None:
        self.keys, self.n, self.new = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []

    def add(self, group: np.ndarray, place: np.ndarray) -> None:
        key, n = np.unique((group << 40) | place, return_counts=True)
        self.new.append((key, n))
        if sum(len(k) for k, _ in self.new) > HELD_COUNTS // 2:
            self.merge()

    def merge(self) -> None:
        key = np.concatenate([self.keys, *[k for k, _ in self.new]])
        n = np.concatenate([self.n, *[n for _, n in self.new]])
        self.keys, back = np.unique(key, return_inverse=True)
        self.n, self.new = np.zeros(len(self.keys), dtype=np.int64), []
        np.add.at(self.n, back, n)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the terms of several texts; none reaches over the end of a text."""
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def term_counts(docs: DataFrame, shards: list[tuple[str, bytes, int, str]]) -> DataFrame:
    """lang, source, place and n: occurrences of each kept term, by its place among the language's sorted terms.

    Every whole text is read through the transducers, about four megabytes at a
    time. Counts are added up in the workers, then shuffled by (lang, source, place).
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(shards))

    def run(batches):
        words: Vocabulary = worker_state("terms", shipped.value, lambda s: Vocabulary(pickle.loads(s)))
        groups: dict[tuple[str, str], int] = {}
        counts = _Counts()
        for batch in batches:
            langs, sources = batch.column(0), batch.column(1)
            own = np.array([groups.setdefault(k, len(groups)) for k in zip(langs.to_pylist(), sources.to_pylist())], dtype=np.int64)
            number = langs.dictionary_encode()
            code, names = number.indices.to_numpy(), number.dictionary.to_pylist()
            for first, data, offsets in text_blocks(batch.column(2), RUN_BYTES):
                starts, ends, row = _spans(data, offsets)
                data, row = _FOLD[data], row + first
                for i, lang in enumerate(names):
                    mine = code[row] == i
                    place = words.ordinals(lang, data, starts[mine], ends[mine])
                    counts.add(own[row[mine]][place >= 0], place[place >= 0])
                if len(counts.keys) > HELD_COUNTS:
                    yield from _handed_on(counts, groups)
                    counts = _Counts()
            if len(groups) > HELD_COUNTS:
                counts.merge()
                yield from _handed_on(counts, groups)
                counts, groups = _Counts(), {}
        counts.merge()
        yield from _handed_on(counts, groups)

    found = _plain(docs).mapInArrow(run, "lang string, source string, place bigint, n bigint")
    return found.groupBy("lang", "source", "place").agg(F.sum("n").alias("n"))


def _handed_on(counts: _Counts, groups: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
    names = list(groups)
    langs, sources = pa.array([g[0] for g in names], pa.string()), pa.array([g[1] for g in names], pa.string())
    for i in range(0, len(counts.keys), 1 << 16):
        key, n = counts.keys[i : i + (1 << 16)], counts.n[i : i + (1 << 16)]
        group = pa.array(key >> 40)
        yield pa.RecordBatch.from_arrays([pc.take(langs, group), pc.take(sources, group), pa.array(key & ((1 << 40) - 1)), pa.array(n)],
                                         names=["lang", "source", "place", "n"])


# Shares and divergences. Counts are decimals before they are multiplied, so nothing overflows or is rounded.

def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * terms))."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.call_function("div", top, F.greatest(total + 2 * terms, F.lit(1)).cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), of shares, which are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = 10) -> DataFrame:
    """Divergence of every (lang, source) group from each other source of its language, and its most typical terms.

    Null lang, source and text count as empty, so null and empty groups are one; every row is a
    document, repeated or not; other columns are left out; an empty table gives no rows. A language
    keeps the terms of at least ``min_docs`` of its documents. Returned per group:
    part ``pair`` with every other source as item and the divergence summed over all kept terms (0 without
    any), all of them ranked; part ``term`` with the ``top`` terms that the group has more often than its language,
    ties in term order. Columns lang, source, part, item, value, rank.

    Terms are counted by their place, through the language's minimal transducers, which also
    put equal values in term order and turn the places of the top terms back into text. Pairs are
    worked out in blocks of places and tiles of sources, no task sees more of a language.
    """
    docs = _plain(docs)
    shards, sizes = build_vocabulary(kept_terms(docs, min_docs))
    counts = stored(term_counts(docs, shards), "counts")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = docs.sparkSession.createDataFrame(list(sizes.items()), "lang string, terms bigint")  # a row per language
    of_lang = Window.partitionBy("lang")  # one row per source
    groups = stored(docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(terms, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"),
        F.coalesce(F.sum("total").over(of_lang), F.lit(0)).alias("lang_total"),
        (F.row_number().over(of_lang.orderBy("source")) - 1).alias("number"),
        F.count(F.lit(1)).over(of_lang).alias("sources")), "groups")
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    return _pairs(shares, groups).unionByName(_terms(shares, shards, top))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Part ``pair``. A task has a block of places and the sources of one or two tiles."""
    own = F.floor(F.col("number") / TILE_SOURCES).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / TILE_SOURCES).cast("int")))
    keys = ["lang", "block", "low", "high"]

    def tiled(df: DataFrame) -> DataFrame:
        return (df.withColumn("_own", own).withColumn("_other", other)
                .withColumn("low", F.least("_own", "_other")).withColumn("high", F.greatest("_own", "_other")))

    met = tiled(shares.withColumn("block", F.floor(F.col("place") / BLOCK_TERMS))).select(
        *keys, (F.col("number") + 0).alias("row"), F.pmod("place", F.lit(BLOCK_TERMS)).alias("at"), "p")
    last = F.greatest(F.floor((F.col("terms") - 1) / BLOCK_TERMS), F.lit(0))
    sides = tiled(groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))).select(
        *keys, "number", "source", (F.col("_own") == F.col("low")).alias("first"),
        share(F.lit(0), F.col("total"), F.col("terms")).alias("p"),
        F.greatest(F.least(F.col("terms") - F.col("block") * BLOCK_TERMS, F.lit(BLOCK_TERMS)), F.lit(0)).alias("width"))

    def run(left, right):
        lang, _, low, high = (right.column(k)[0].as_py() for k in keys)
        right = right.sort_by("number")
        number, names = right.column("number").to_numpy(), right.column("source").combine_chunks()
        empty, width = right.column("p").to_numpy(), right.column("width")[0].as_py()
        a = np.flatnonzero(right.column("first").to_numpy(zero_copy_only=False))
        b = a if low == high else np.setdiff1d(np.arange(len(number)), a)
        left = left.sort_by("at")
        row = np.searchsorted(number, left.column("row").to_numpy())
        at, p = left.column("at").to_numpy(), left.column("p").to_numpy()
        sums, step = np.zeros((len(a), len(b)), dtype=np.int64), max(1, _CHUNK_CELLS // len(number))
        for c in range(0, width, step):
            own = slice(*np.searchsorted(at, [c, c + step]))
            table = np.repeat(empty[:, None], min(step, width - c), axis=1)
            table[row[own], at[own] - c] = p[own]
            others = table[b]
            for i in range(len(a)):
                start = i + 1 if low == high else 0
                mine = table[a[i]]
                gap = others[start:] - mine
                sums[i, start:] += (gap * gap // (others[start:] + mine)).sum(axis=1)
        i, j = np.triu_indices(len(a), 1) if low == high else np.divmod(np.arange(sums.size), max(len(b), 1))
        x, y, value = a[i], b[j], sums[i, j]
        return pa.table({"lang": pa.array([lang] * (2 * len(x)), pa.string()), "source": names.take(pa.array(np.concatenate([x, y]))),
                         "item": names.take(pa.array(np.concatenate([y, x]))), "value": pa.array(np.concatenate([value, value]))})

    parts = met.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(run, "lang string, source string, item string, value bigint")
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms(shares: DataFrame, shards: list, top: int) -> DataFrame:
    """Part ``term``: the map tasks keep the top places of each group, which are then read as terms."""
    n_lang = F.sum("n").over(Window.partitionBy("lang", "place"))  # at most one row per source
    q = share(n_lang, F.col("lang_total"), F.col("terms"))
    more = shares.withColumn("q", q).where(F.col("p") > F.col("q")).withColumn("value", apart(F.col("p"), F.col("q")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "place"))
    best = more.withColumn("rank", rank).where(F.col("rank") <= top)
    shipped = shares.sparkSession.sparkContext.broadcast(pickle.dumps(shards))

    def run(batches):
        words: Vocabulary = worker_state("terms", shipped.value, lambda s: Vocabulary(pickle.loads(s)))
        for batch in batches:
            item = [words.term(lang, place).decode() for lang, place in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1)), pa.array(item, pa.string()), batch.column(3), batch.column(4)],
                                             names=["lang", "source", "item", "value", "rank"])

    named = best.select("lang", "source", "place", "value", "rank").mapInArrow(
        run, "lang string, source string, item string, value bigint, rank int")
    return named.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
