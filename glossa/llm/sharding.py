"""K-d tree sharding: weighted medians along the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import stored

BINS = 1024          # histogram bins per cell and round
GROUP_SHARE = 0.02   # of a shard's bytes: a larger group of equal texts is cut into pieces of about this size
TOLERANCE = 0.0005   # of a shard's bytes: a median this close is taken
_TIES = 1 << 50


@dataclass
class Cell:
    """A node of the tree: its target number of shards and, once split, dimension, value, tie and children."""

    shards: int
    first: int
    dim: int = -1
    value: float = 0.0
    tie: float = 0.0
    children: list["Cell"] = field(default_factory=list)

    def leaves(self) -> list["Cell"]:
        return [leaf for c in self.children for leaf in c.leaves()] if self.children else [self]

    def number(self, dims: list[Column], tie: Column) -> Column:
        """First shard of the leaf that a unit lies in."""
        if not self.children:
            return F.lit(self.first)
        low = (dims[self.dim] < self.value) | ((dims[self.dim] == self.value) & (tie < self.tie))
        return F.when(low, self.children[0].number(dims, tie)).otherwise(self.children[1].number(dims, tie))


def text_number(column: Column) -> Column:
    """A string as a number in the same order, by its first six bytes; null as -1."""
    head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(-1.0))


def number(column: Column) -> Column:
    return F.coalesce(column.cast("double"), F.lit(-1.0))


def _units(rows: DataFrame, dims: list[str], target: float) -> tuple[DataFrame, DataFrame]:
    """Rows with the piece of their group, and one weighted point for each (group, piece).

    Groups heavier than ``GROUP_SHARE`` of a shard number at most shards / share, so their list is small.
    """
    most = max(1.0, GROUP_SHARE * target)
    weights = rows.groupBy("group").agg(F.sum("size").alias("_bytes"))
    heavy = weights.where(F.col("_bytes") > most).select("group", F.ceil(F.col("_bytes") / most).alias("_pieces"))
    pieced = rows.join(F.broadcast(heavy), "group", "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("_pieces")), F.lit(0))).drop("_pieces")
    tie = F.pmod(F.xxhash64("group", "piece"), F.lit(_TIES)).cast("double")
    units = pieced.groupBy("group", "piece").agg(
        F.sum("size").cast("double").alias("weight"), *[F.min(d).alias(d) for d in dims]).withColumn("tie", tie)
    return pieced, units


def build_tree(units: DataFrame, dims: list[str], shards: int) -> Cell:
    """Split cells until each is one shard; ``units`` has weight, tie (both double) and the dimensions.

    A level takes one job for the extents and a few for the medians; each sends
    at most ``BINS`` rows per cell to the driver, whatever the input's size.
    """
    columns, tie = [F.col(d) for d in dims], F.col("tie")
    total = units.agg(F.sum("weight")).first()[0] or 0.0
    slack = TOLERANCE * total / shards
    whole = units.agg(*[f(d) for d in dims for f in (F.min, F.max)]).first()
    root = Cell(shards, 0)
    while open_cells := [c for c in root.leaves() if c.shards > 1]:
        placed = units.withColumn("cell", root.number(columns, tie)).where(F.col("cell").isin([c.first for c in open_cells]))
        extents = {r["cell"]: r for r in placed.groupBy("cell").agg(
            F.sum("weight").alias("w"), *[f(d).alias(f"{n}{i}") for i, d in enumerate(dims)
                                          for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        asked = {}
        for c in open_cells:
            e = extents.get(c.first)
            if e is not None:
                spread = [(e[f"hi{i}"] - e[f"lo{i}"]) / max(whole[2 * i + 1] - whole[2 * i], 1e-300) for i in range(len(dims))]
                c.dim = max(range(len(dims)), key=lambda i: (spread[i], -i))
                asked[c.first] = e["w"] * (c.shards // 2) / c.shards
        by_value = _medians(placed, {c.first: columns[c.dim] for c in open_cells if c.first in asked}, asked, slack)
        again = {k: (v, left) for k, (v, left, weight) in by_value.items() if weight}
        tied = [(F.col("cell") == c.first) & (columns[c.dim] == again[c.first][0]) for c in open_cells if c.first in again]
        by_tie = _medians(placed.where(reduce(lambda a, b: a | b, tied)), {k: tie for k in again},
                          {k: left for k, (_, left) in again.items()}, slack) if again else {}
        for c in open_cells:
            c.dim = max(c.dim, 0)
            c.value = by_value[c.first][0] if c.first in by_value else 0.0
            c.tie = -1.0
            if c.first in by_tie:  # the point on the border goes where the error is smaller; ties are whole numbers
                at, left, weight = by_tie[c.first]
                c.tie = at + 0.5 if 2 * left > weight else at
            half = c.shards // 2
            c.children = [Cell(half, c.first), Cell(c.shards - half, c.first + half)]
    return root


def _medians(placed: DataFrame, keys: dict[int, Column], asked: dict[int, float], slack: float) -> dict:
    """Per cell: a key, the weight still asked for at it, and the weight of the points equal to it (0: cut before them).

    Histograms are refined around the asked weight until a bin holds one key or
    the border before a bin is close enough.
    """
    found, left = {}, dict(asked)
    key = reduce(lambda rest, k: F.when(F.col("cell") == k, keys[k]).otherwise(rest), keys, F.lit(None).cast("double"))
    keyed = placed.withColumn("_key", key).where(F.col("_key").isNotNull())
    ranges = {r["cell"]: (r["lo"], r["hi"]) for r in keyed.groupBy("cell").agg(
        F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect()}
    bounds = {k: ranges[k] for k in keys if k in ranges}
    while bounds:
        inside = reduce(lambda a, b: a | b, [(F.col("cell") == k) & F.col("_key").between(*b) for k, b in bounds.items()])
        step = reduce(lambda rest, k: F.when(F.col("cell") == k, F.least(F.lit(BINS - 1), F.floor(
            (F.col("_key") - bounds[k][0]) / max((bounds[k][1] - bounds[k][0]) / BINS, 1e-300)))).otherwise(rest),
            bounds, F.lit(0).cast("bigint"))
        bins: dict[int, list] = {}
        for r in (keyed.where(inside).groupBy("cell", step.alias("bin"))
                  .agg(F.sum("weight").alias("w"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect()):
            bins.setdefault(r["cell"], []).append(r)
        for k in list(bounds):
            for r in sorted(bins[k], key=lambda r: r["lo"]):
                if left[k] <= slack:
                    found[k] = (r["lo"], 0.0, 0.0)
                    break
                if r["w"] > left[k]:
                    if r["lo"] == r["hi"]:
                        found[k] = (r["lo"], left[k], r["w"])
                    else:
                        bounds[k] = (r["lo"], r["hi"])
                    break
                left[k] -= r["w"]
            else:  # all of it lies before the border
                found[k] = (r["hi"], r["w"], r["w"])
            if k in found:
                del bounds[k]
    return found


def shard_rows(docs: DataFrame, dimensions: dict[str, Column], shards: int = 8, text: str = "text") -> DataFrame:
    """Deal documents to ``shards`` shards of nearly equal bytes that are compact in the metadata.

    A document's size is the UTF-8 length of its text (null: none) plus one.
    Equal texts form a group, placed as one point at the least metadata of its
    rows; only a group above ``GROUP_SHARE`` of a shard is cut up, so shards differ
    by a few times that share at most (or by one document larger than it). Cells
    are split at weighted medians of the widest dimension, measured against its
    range over all documents; equal values are split by a hash of the group. Null
    metadata counts as -1. Returns one row per document, repeated ones too:
    doc_id, size, text_crc32, shard and slot, which numbers the rows of a shard
    from 0 without gaps in the order of the scan. Extra columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    raw = F.encode(body, "UTF-8")
    rows = stored(docs.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("group"), F.monotonically_increasing_id().alias("row"),
        *[c.alias(n) for n, c in dimensions.items()]), "rows")
    dims = list(dimensions)
    total = rows.agg(F.sum("size")).first()[0] or 0
    pieced, units = _units(rows, dims, total / shards)
    units = stored(units, "units")
    tree = build_tree(units, dims, shards)
    placed = units.select("group", "piece", tree.number([F.col(d) for d in dims], F.col("tie")).alias("shard"))
    dealt = stored(pieced.select("doc_id", "size", "text_crc32", "group", "piece", "row").join(placed, ["group", "piece"])
                   .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "row",
                           F.shiftright("row", 33).alias("part")), "dealt")
    runs = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return (dealt.withColumn("_at", local).join(runs, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("_at") - 1).alias("slot")))
