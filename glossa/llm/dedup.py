"""Exact duplicates against immutable snapshots screened by static filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import lower_ascii, stored
from glossa.llm.fuse import FuseFilter, build
from glossa.llm.words import lean_group

BUCKET_DIGESTS = 200_000  # digests of the larger side that one filter bucket is meant for


def normalised(text: Column) -> Column:
    """Texts are equal when their normalised forms are: A-Z lower-cased, null as empty."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def digest_rows(docs: DataFrame, snapshot: Column, text: str = "text", digest=sha256) -> DataFrame:
    """One slim row per document: doc_id, place in the scan, digest of the normalised text, and its batch."""
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"),
                       digest(normalised(F.col(text))).alias("digest"), F.coalesce(snapshot, F.lit(False)).alias("old"))


def digest_groups(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays (largest doc_id, then last in the scan) and the number of rows."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"),
                                      F.count(F.lit(1)).alias("size"))


def _keyed(groups: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("digest")
    return groups.select("digest", key.alias("key"), F.pmod(F.shiftright(key, 7), F.lit(buckets)).cast("int").alias("bucket"))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One static filter per bucket over the distinct digests of a snapshot, to be written along with it."""
    def make(key, table):
        made = build(np.unique(table.column("key").to_numpy().astype(np.int64).view(np.uint64)))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()),
                         "seed": pa.array([made.seed - (1 << 63)], pa.int64()),
                         "segment": pa.array([made.segment], pa.int64()),
                         "segments": pa.array([made.segments], pa.int64()),
                         "prints": pa.array([made.prints.tobytes()], pa.binary())})

    return _keyed(groups, buckets).select("bucket", "key").groupBy("bucket").applyInArrow(
        lean_group(make), "bucket int, seed bigint, segment bigint, segments bigint, prints binary")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Incoming digests that the filter of their bucket holds: all that are in the snapshot, and one in 256 others."""
    def ask(left, right):
        if not right.num_rows or not left.num_rows:
            return left.select(["digest"]).slice(0, 0)
        row = right.to_pylist()[0]
        made = FuseFilter(row["seed"] + (1 << 63), row["segment"], row["segments"],
                          np.frombuffer(row["prints"], dtype=np.uint8))
        return left.select(["digest"]).filter(pa.array(made.holds(left.column("key").to_numpy().view(np.uint64))))

    return (_keyed(groups, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket"))
            .applyInArrow(lean_group(ask), f"digest {dict(groups.dtypes)['digest']}"))


def merge_groups(incoming: DataFrame, snapshots: list[DataFrame]) -> DataFrame:
    """Groups over an incoming batch and the snapshots before it, all given as ``digest_groups``.

    Each snapshot's filter screens the incoming digests. Only positives meet the
    exact buckets of that snapshot; the others are new to it and pass on. Digests
    are distinct on both sides, so no bucket is larger than its share of digests.
    """
    merged = incoming
    for snapshot in snapshots:
        buckets = max(1, -(-max(snapshot.count(), merged.count()) // BUCKET_DIGESTS))
        filters = stored(snapshot_filters(snapshot, buckets), "filters")
        positive = screen(merged, filters, buckets).withColumn("positive", F.lit(True))
        asked = merged.join(positive, "digest", "left")
        exact = (asked.where(F.col("positive")).select(merged.columns).unionByName(snapshot).groupBy("digest")
                 .agg(F.max("keep").alias("keep"), F.sum("size").alias("size")))
        merged = stored(exact.unionByName(asked.where(F.col("positive").isNull()).select(merged.columns)), "groups")
    return merged


def colliding(docs: DataFrame, rows: DataFrame, groups: DataFrame, text: str = "text", digest=sha256) -> DataFrame:
    """Byte check: digests that several different texts share (none, unless the digest is weak).

    Only rows of groups with more than one row are read with their text. They are
    grouped by digest and whole text, which map tasks pre-aggregate, so a group
    of very many copies arrives as a few rows.
    """
    suspects = rows.join(groups.where(F.col("size") > 1).select("digest"), "digest").select("doc_id").distinct()
    texts = docs.select("doc_id", normalised(F.col(text)).alias("norm")).join(
        suspects.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    exact = texts.groupBy(digest(F.col("norm")).alias("digest"), "norm").agg(F.count(F.lit(1)).alias("n"))
    return exact.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > 1).select("digest")


def exact_duplicates(docs: DataFrame, snapshot: Column, text: str = "text", digest=sha256) -> DataFrame:
    """One row per document: doc_id, row, digest, keep_id, group_size, kept.

    ``docs`` holds doc_id and text and must scan alike each time. Texts are equal
    when identical after lower-casing A-Z; null counts as empty. Of equal texts
    the row with the largest doc_id stays (null ids lowest, the last in the scan
    of repeated rows). ``snapshot`` says which documents form the immutable
    snapshot; the others are the incoming batch, whose own duplicates are grouped
    first. Extra columns are ignored, an empty table gives no rows.
    """
    rows = stored(digest_rows(docs, snapshot, text, digest), "digests")
    old = stored(digest_groups(rows.where("old")), "snapshot")
    new = stored(digest_groups(rows.where("not old")), "incoming")
    groups = merge_groups(new, [old])
    clash = stored(colliding(docs, rows, groups, text, digest), "colliding")
    if not clash.isEmpty():
        return _by_text(docs, text, digest)
    joined = rows.join(groups, "digest")
    return joined.select("doc_id", "row", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
                         (F.col("row") == F.col("keep.row")).alias("kept"))


def _by_text(docs: DataFrame, text: str, digest) -> DataFrame:
    """The same result when a weak digest put different texts together: groups are then whole texts."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), normalised(F.col(text)).alias("norm"))
    groups = rows.groupBy("norm").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("size"))
    return rows.join(groups, "norm").select(
        "doc_id", "row", digest(F.col("norm")).alias("digest"), F.col("keep.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"))


def halfway(docs: DataFrame) -> Column:
    """The documents up to the middle of the id range, as a snapshot that later ids arrive after."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.lit(False) if low is None else F.col("doc_id") <= (low + high) // 2


def drop_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents without all but one of equal texts; columns stay as they are."""
    found = exact_duplicates(docs, halfway(docs), text)
    keepers = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    marked = docs.withColumn("_sha", sha256(normalised(F.col(text))))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_digest"))
    return marked.join(keepers, same, "left_semi").dropDuplicates(["doc_id", "_sha"]).drop("_sha")
