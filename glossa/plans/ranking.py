"""Ranks and sequential numbers that never put one group into one task.

``row_number()`` over a group sends the whole group to a single task. A group
here may hold a third of a 100 TB table, so both functions cut the order into
pieces, count the pieces, and add each piece's offset to a local position.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.plans.skew import HOT_ROWS, has_hot_key, tell_apart
from glossa.session import ensure_checkpoint_dir

_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, position below


def seeded_hash(seed, *cols: Column | str) -> Column:
    """md5 of ``seed|col|...``: a reproducible random order for keyed rows."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_number(digest: Column, digits: int = 8) -> Column:
    """Leading hex digits of a digest as a number."""
    return F.conv(F.substr(digest, F.lit(1), F.lit(digits)), 16, 10).cast("bigint")


def _group(by: Sequence[str]) -> Column:
    """Group key that compares nulls as equal, so null groups survive joins."""
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))


def hash_rank(df: DataFrame, key: Sequence[str], seed, by: Sequence[str] = (), out: str = "rank",
              top: int | None = None, digits: int = 4, total: str | None = None, unique: bool = False,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact 1-based rank of each row in the seeded hash order of its group.

    The hash prefix cuts each group into ``16**digits`` even pieces. Only piece
    counts are prefix-summed; rows meet their own piece's offset. With ``top``
    the pieces beyond it are dropped before any row is shuffled. ``total`` names
    an optional column for the group size. ``key`` should identify rows; should
    one key turn out to have very many rows, they are told apart first. That check
    is left out for a key known to be ``unique``.

    Pieces and rows are read separately, so ``df`` must yield the same rows every
    time: write or checkpoint a frame made by ``limit`` or ``sample`` first.
    """
    piece, key, by = "_piece", list(key), list(by)
    if not unique and has_hot_key(df, key, hot_rows):
        df, key = tell_apart(df, key, "_tie", hot_rows), [*key, "_tie"]
    keyed = df.withColumn("_hash", seeded_hash(seed, *key)).withColumn(
        "_by", _group(by)).withColumn(piece, hash_number(F.col("_hash"), digits))
    pieces = keyed.groupBy("_by", piece).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_by")
    earlier = whole.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        "_by", piece, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"))
    if top is not None:
        offsets = offsets.where(F.col("_before") < top)
    if not by:  # at most 16**digits rows
        offsets = F.broadcast(offsets)
    local = Window.partitionBy("_by", piece).orderBy("_hash", *key)  # the join's own partitioning
    ranked = keyed.join(offsets, ["_by", piece]).withColumn(
        out, F.col("_before") + F.row_number().over(local))
    if top is not None:
        ranked = ranked.where(F.col(out) <= top)
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_by", piece, "_hash", "_before", "_total", "_tie")


def sequential_id(df: DataFrame, order_by: Sequence[str | Column], by: Sequence[str] = (),
                  out: str = "id", start: int = 1, unique: bool = False, hot_rows: int = HOT_ROWS,
                  key: Sequence[str] | None = None) -> DataFrame:
    """Consecutive numbers in a given order, per group or over everything.

    One range shuffle sorts the rows by (group, order); the sorted partitions
    are checkpointed, which fixes their layout for good; every row is then
    numbered by its position plus the counts of the partitions before it. Rows
    that are equal in the order are spread as well, in no particular order; the
    check for very many of them is left out when the order is ``unique``.

    Columns that identify a row can be named as ``key``: then keys alone are laid out,
    checkpointed and numbered (``numbered_keys``), equal rows of the order come in key order, and
    the other columns meet their number by one join. ``df`` is read twice for it.
    """
    if key is not None:
        same = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(key)]
        numbers = numbered_keys(df, order_by, key, by, out, start).select(
            *[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)], F.col(out).alias("_number"))
        rest = df.drop(out)
        return rest.join(numbers, reduce(and_, same)).select(*rest.columns, F.col("_number").alias(out))
    return _numbered(_lay_out(df, order_by, by, unique, hot_rows), by, out, start)


def numbered_keys(df: DataFrame, order_by: Sequence[str | Column], key: Sequence[str], by: Sequence[str] = (),
                  out: str = "id", start: int = 1) -> DataFrame:
    """Group, key and number of each row; nothing else of a row is shuffled for its order or checkpointed.

    ``key`` identifies rows and breaks ties of the order. Columns that only ``order_by`` reads are shuffled
    once and left out of the checkpoint.
    """
    kept = [*by, *[c for c in key if c not in by]]
    named = [c for c in order_by if isinstance(c, str)]
    placed = _lay_out(df, [*order_by, *[c for c in key if c not in named]], by, True, keep=kept)
    return _numbered(placed, by, out, start).select(*kept, out)


def _numbered(placed: DataFrame, by: Sequence[str], out: str, start: int) -> DataFrame:
    slots = placed.groupBy("_slot").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = (Window.partitionBy(F.col("_slot")["by"]).orderBy(F.col("_slot")["part"])
               .rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.select("_slot", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    if not by:  # one row for each range partition
        slots = F.broadcast(slots)
    number = F.lit(start) + F.col("_before") + F.col("_at") - F.col("_first")
    return placed.join(slots, "_slot").withColumn(out, number).drop("_at", "_slot", "_first", "_before")


def _lay_out(df: DataFrame, order_by: Sequence[str | Column], by: Sequence[str], unique: bool,
             hot_rows: int = HOT_ROWS, keep: Sequence[str] | None = None) -> DataFrame:
    """Range-sorted, checkpointed rows with their position ``_at`` and partition ``_slot``.

    With ``keep`` only those columns are checkpointed; Catalyst reads and shuffles just them and the order's.
    """
    ensure_checkpoint_dir(df.sparkSession)
    named = [*by, *[c for c in order_by if isinstance(c, str)]]
    tied = df if unique else tell_apart(df, named or df.columns, "_tie", hot_rows)
    order = [*[F.col(c).asc_nulls_first() for c in by],
             *[c if isinstance(c, Column) else F.col(c) for c in order_by]]
    order = order if unique else [*order, F.col("_tie")]
    laid_out = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    laid_out = (laid_out if keep is None else laid_out.select(*keep)).checkpoint()
    return laid_out.withColumn("_at", F.monotonically_increasing_id()).withColumn("_slot", F.struct(
        _group(by).alias("by"), F.shiftright("_at", _POSITION_BITS).alias("part")))


def running_total(df: DataFrame, order_by: Sequence[str], weight: str, out: str = "total",
                  unique: bool = False) -> DataFrame:
    """Sum of ``weight`` over this row and all rows before it in a given order.

    Laid out like ``sequential_id``; a window then only runs inside one range
    partition at a time, on top of the sums of the partitions before it.
    """
    placed = _lay_out(df, order_by, [], unique)
    slots = placed.groupBy("_slot").agg(F.sum(weight).alias("_sum"))
    earlier = (Window.partitionBy(F.col("_slot")["by"]).orderBy(F.col("_slot")["part"])
               .rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.select("_slot", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_slot").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return (placed.join(slots, "_slot").withColumn(out, F.col("_before") + F.sum(weight).over(local))
            .drop("_at", "_slot", "_before"))


def first_per_group(df: DataFrame, by: Sequence[str], order_by: Sequence[Column | str], n: int = 1,
                    out: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in a given order.

    Spark limits each group to ``n`` rows inside every map task before the
    shuffle (window group limit), so a hot group shrinks where it is read.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n >= limit:  # beyond it a window would gather whole groups: number rows without one
        kept = sequential_id(df, order_by, by, out or "_rank").where(F.col(out or "_rank") <= n)
        return kept if out else kept.drop("_rank")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))
    kept = df.withColumn(out or "_rank", rank).where(F.col(out or "_rank") <= n)
    return kept if out else kept.drop("_rank")
