"""Benchmark items inside documents: size-partitioned MinHash sketches, verified by exact containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.shingles import shingle_sets
from glossa.llm.words import lean

SHINGLE = 5            # words
THRESHOLD = (4, 5)     # containment of at least 0.8
BLOCK = 1 << 21        # item shingles that are searched for in one pass, 16 MB
_HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("shared", T.LongType()),
                                  T.StructField("size", T.LongType())]))


def item_sets(items: DataFrame, text: str = "text") -> DataFrame:
    """item_id and the sorted distinct shingles of each item, as bytes of 64-bit numbers."""
    def run(batches):
        for batch in batches:
            blobs = []
            for _, flat, counts in shingle_sets(batch.column(text), SHINGLE, short=False):
                blobs += [p.tobytes() for p in np.split(flat, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(blobs, pa.binary())], names=["item_id", "shingles"])

    return (items.select(F.col("item_id").cast("bigint").alias("item_id"), text)
            .mapInArrow(lean(run), "item_id bigint, shingles binary").where(F.length("shingles") > 0))


class ItemBlock:
    """Items of one pass, and the sketches that find them.

    Items are partitioned by size, in powers of two. The MinHash sketch of an
    item is its k least shingle hashes, with k one more than the number of
    shingles that the largest item of its partition may miss. A document that
    contains enough of the item then holds at least one of them, so none is lost;
    how many it must hold follows from the item's own size.
    """

    def __init__(self, rows: list[tuple[int, np.ndarray]]) -> None:
        over, under = THRESHOLD
        self.ids = [i for i, _ in rows]
        self.sizes = np.array([len(s) for _, s in rows], dtype=np.int64)
        self.shingles = [s for _, s in rows]
        largest = 1 << np.ceil(np.log2(self.sizes)).astype(np.int64)
        self.needed = -(-over * self.sizes // under)                      # shared shingles of a match
        sketch = np.minimum(largest - (-(-over * largest // under)) + 1, self.sizes)
        self.hits = np.maximum(1, sketch - (self.sizes - self.needed))    # sketch hits of a match
        keys = np.concatenate([s[:k] for s, k in zip(self.shingles, sketch)])
        owner = np.repeat(np.arange(len(rows)), sketch)
        order = np.argsort(keys, kind="stable")
        keys, self.owner = keys[order], owner[order]
        self.keys, self.first, self.count = np.unique(keys, return_index=True, return_counts=True)

    def find(self, flat: np.ndarray, counts: np.ndarray) -> list[list[dict]]:
        """Matches of each of several documents, given by their sorted shingles."""
        found: list[list[dict]] = [[] for _ in counts]
        at = np.searchsorted(self.keys, flat)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == flat)
        if not len(hit):
            return found
        ends = np.cumsum(counts)
        docs = np.searchsorted(ends, hit, side="right")
        reach = self.count[at[hit]]
        items = self.owner[np.repeat(self.first[at[hit]] - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())]
        pairs, number = np.unique(np.repeat(docs, reach) * len(self.ids) + items, return_counts=True)
        for pair, n in zip(pairs.tolist(), number.tolist()):
            doc, item = divmod(pair, len(self.ids))
            if n >= self.hits[item]:
                own = flat[ends[doc] - counts[doc] : ends[doc]]
                where = np.minimum(np.searchsorted(own, self.shingles[item]), len(own) - 1)
                shared = int((own[where] == self.shingles[item]).sum())
                if shared >= self.needed[item]:
                    found[doc].append({"item_id": self.ids[item], "shared": shared, "size": int(self.sizes[item])})
        return found


def item_blocks(items: DataFrame, text: str = "text", most: int = BLOCK):
    """The items in blocks of bounded size, one after another; one block at a time is on the driver."""
    block, size = [], 0
    for r in item_sets(items, text).orderBy("item_id", "shingles").toLocalIterator():
        shingles = np.frombuffer(r["shingles"], dtype=np.uint64)
        if block and size + len(shingles) > most:
            yield ItemBlock(block)
            block, size = [], 0
        block.append((r["item_id"], shingles))
        size += len(shingles)
    if block:
        yield ItemBlock(block)


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "hits") -> DataFrame:
    """Add the benchmark items that each document contains, as (item_id, shared, size).

    An item is contained when the document holds at least 0.8 of its distinct
    five-word shingles, anywhere. Items of fewer than five words have no shingle
    and are found nowhere; null texts hold nothing; repeated items and documents
    are each looked at. Rows and other columns of ``docs`` stay, a column named
    ``out`` is replaced. The documents are read where they lie, without a shuffle,
    once for each block of items.
    """
    docs = docs.drop(out)
    names = docs.columns
    found = docs.withColumn(out, F.lit([]).cast(_HITS))
    for block in item_blocks(items, text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            for batch in batches:
                hits = []
                for _, flat, counts in shingle_sets(batch.column(text), SHINGLE, short=False):
                    hits += sent.value.find(flat, counts)
                before = batch.column(out).to_pylist()
                both = pa.array([(b or []) + h for b, h in zip(before, hits)], type=batch.schema.field(out).type)
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], both], names=[*names, out])

        found = found.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(out, _HITS)]))
    return found


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """One row per document row and item it contains: doc_id, item_id, shared, size and containment."""
    hits = find_items(docs.select("doc_id", text), items, text).select("doc_id", F.explode("hits").alias("h"))
    return hits.select("doc_id", "h.item_id", "h.shared", "h.size", (F.col("h.shared") / F.col("h.size")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that contain no benchmark item; columns stay as they are."""
    return find_items(docs, items, text, "__hits").where(F.size("__hits") == 0).drop("__hits")
