"""Counting, profiling and summary aggregates.

All of these pre-aggregate inside the map tasks, so hot labels or groups never
travel row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from glossa.functions.labels import split_labels
from glossa.plans.ranking import running_total
from glossa.session import scratch_path


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Label counts, most frequent first; missing labels are not counted."""
    return (df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), label))


def unpivot_labels(df: DataFrame, columns: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Wide model columns -> (model, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias(names[0]), F.col(c).alias(names[1])) for c in columns])
    return df.select(F.explode(pairs).alias("_p")).select("_p.*")


def label_shares(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Relative label frequency per model, one column per model, absent -> 0.

    Counts of every label are written, one row per label; each model's total is then one more small sum, so no task
    holds all labels of a model.
    """
    cells = unpivot_labels(df, models, ("_model", "label")).where(F.col("label").isNotNull())
    path = scratch_path(df.sparkSession, "labels")
    cells.groupBy("label").agg(*[F.count_if(F.col("_model") == m).alias(m) for m in models]).write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    totals = counts.agg(*[F.sum(m).alias(m) for m in models]).first()
    return counts.select("label", *[(F.col(m) / F.lit(totals[m]) if totals[m] else F.lit(0.0)).alias(m) for m in models])


def multi_label_counts(df: DataFrame, packed: str, include_empty: bool = False) -> DataFrame:
    """Counts of the single labels inside packed strings."""
    parts = F.split(packed, ";", -1) if include_empty else split_labels(F.col(packed))
    return label_counts(df.select(F.explode(parts).alias("label")), "label")


def rows_per_group(df: DataFrame, *by: str) -> DataFrame:
    """Rows per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def mean_length(df: DataFrame, text: str, *by: str) -> DataFrame:
    """Mean text length per group."""
    return df.groupBy(*by).agg(F.avg(F.length(text)).alias("mean_length"))


def first_values(df: DataFrame, by: Sequence[str], values: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First non-null value of each column per group, in a given order."""
    order = F.struct(*order_by)
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in values]
    return df.where(F.col(by[0]).isNotNull()).groupBy(*by).agg(*first)


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, as (column, nulls) rows."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return unpivot_labels(counted, df.columns, ("column", "nulls"))


def column_profile(df: DataFrame) -> DataFrame:
    """Non-null count and type per column."""
    counted = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null"), F.lit(t).alias("type"))
                     for c, t in df.dtypes])
    return counted.select(F.explode(rows).alias("_r")).select("_r.*")


def exact_quantiles(df: DataFrame, column: str, fractions: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles, exact at any size, as (fraction, value) rows.

    Equal values are counted first, so a very frequent value is one row; the
    distinct values get running totals from a distributed sort.
    """
    counts = (df.select(F.col(column).cast("double").alias("v")).dropna().groupBy("v")
              .agg(F.count(F.lit(1)).alias("n")))
    totals = running_total(counts, ["v"], "n", "upto", unique=True)
    rows = totals.agg(F.sum("n")).first()[0] or 0
    wanted = [F.struct(F.lit(f).alias("fraction"), F.lit(f * (rows - 1)).alias("pos"), F.lit(p).alias("at"))
              for f in fractions for p in sorted({floor(f * (rows - 1)), ceil(f * (rows - 1))})]
    held = F.filter(F.array(*wanted), lambda x: (x["at"] < F.col("upto")) & (x["at"] >= F.col("upto") - F.col("n")))
    hits = totals.select("v", F.explode(held).alias("_w")).select("v", "_w.*")
    low, high = F.min_by("v", "at"), F.max_by("v", "at")
    part = F.max(F.col("pos") - F.floor("pos"))
    return hits.groupBy("fraction").agg((low + (high - low) * part).alias("value"))


def refined_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float],
                      bins: int = 256) -> dict[tuple[str, float], float | None]:
    """Linear-interpolated quantiles of several numeric columns, exact at any size, by (column, fraction).

    One pass finds every column's extremes. Each further pass counts, for all columns together, the values by ``bins`` equal
    parts of the stretch that holds a wanted rank, and narrows the stretch to the extremes of the part that
    has it, until that is a single value: about one pass for each factor of ``bins`` in the number of different values. Tasks
    hand on counts only, so the shuffle does not grow with the rows. Null and NaN are left out, as missing;
    a column without values has None. ``df`` is read once per pass: write a frame first that is dear to compute.
    """
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    first = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(values.values())
                     for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    sizes = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    ranks = {(c, r) for c in columns for f in fractions if sizes[c] for r in (floor(f * (sizes[c] - 1)), ceil(f * (sizes[c] - 1)))}
    stretch = {(c, r): (first[f"lo{i}"], first[f"hi{i}"], 0) for i, c in enumerate(columns) for k, r in ranks if k == c}
    while wide := sorted({(c, lo, hi, before) for (c, _), (lo, hi, before) in stretch.items() if lo < hi}):
        parts = F.array(*[F.when(values[c].between(lo, hi), F.struct(F.lit(i).alias("i"), _part(values[c], lo, hi, bins).alias("part"),
                                                                     values[c].alias("v"))) for i, (c, lo, hi, _) in enumerate(wide)])
        counted = df.select(F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.part").agg(
            F.count(F.lit(1)).alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi")).collect()
        found: dict[int, list] = {}
        for row in sorted(counted, key=lambda x: (x["i"], x["part"])):
            found.setdefault(row["i"], []).append(row)
        for (c, r), (lo, hi, before) in list(stretch.items()):
            if lo < hi:
                for row in found[wide.index((c, lo, hi, before))]:
                    if r < before + row["n"]:
                        stretch[c, r] = (row["lo"], row["hi"], before)
                        break
                    before += row["n"]
    out = {}
    for c in columns:
        for f in fractions:
            at = f * (sizes[c] - 1)
            low, high = (stretch[c, r][0] if sizes[c] else None for r in (floor(at), ceil(at)))
            out[c, f] = low if low == high else low + (high - low) * (at - floor(at))
    return out


def _part(value: Column, low: float, high: float, bins: int) -> Column:
    """Number of the equal part of [low, high] that a value is in; never falls as the value grows."""
    most = 1.7976931348623157e308
    low, high = max(low, -most), min(high, most)
    width = high / 2 - low / 2
    if not width > 0 or bins / width == float("inf"):  # too close for arithmetic: the least value and the others
        return (value > low).cast("int")
    held = F.greatest(F.least(value, F.lit(most)), F.lit(-most))
    return F.least(F.floor((held / 2 - F.lit(low / 2)) / F.lit(width) * bins), F.lit(bins - 1)).cast("int")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, unique, top, freq, mean, std and exact quartiles, one row per column.

    One pass covers the moments of all numeric columns, a few more their exact quartiles, all columns at once
    (``refined_quantiles``); text columns take one count of their values.
    """
    columns = list(columns or df.columns)
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    out = None
    if numeric:
        stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"),
                          F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
                          F.max(c).cast("double").alias("max")) for c in numeric]
        out = df.agg(F.array(*stats).alias("_s")).select(F.explode("_s").alias("_s")).select("_s.*")
        found = refined_quantiles(df, numeric, (0.25, 0.5, 0.75))
        quartiles = df.sparkSession.createDataFrame([(c, *[found[c, f] for f in (0.25, 0.5, 0.75)]) for c in numeric],
                                                    "column string, q25 double, q50 double, q75 double")
        out = out.join(quartiles, "column", "left")
    for c in columns:
        if c not in numeric:
            counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast(StringType()).alias("v")).agg(
                F.count(F.lit(1)).alias("n"))
            row = counts.agg(F.lit(c).alias("column"), F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
                             F.max("n").alias("freq"), F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"))
            out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    order = ["column", "count", "unique", "top", "freq", "mean", "std", "min", "q25", "q50", "q75", "max"]
    return out.select(*[x for x in order if x in out.columns])


def crosstab(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """A10: confusion counts of two label columns in long form."""
    return (df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull()).groupBy(rows, cols)
            .agg(F.count(F.lit(1)).alias("n")))


def crosstab_wide(df: DataFrame, rows: str, cols: str, domain: Sequence[str]) -> DataFrame:
    """A10: confusion matrix with one column per domain label, absent -> 0."""
    return (df.where(F.col(rows).isNotNull()).groupBy(rows).pivot(cols, list(domain))
            .agg(F.count(F.lit(1))).fillna(0, list(domain)))


def score_histogram(df: DataFrame, models: Sequence[str], bins: int = 20) -> DataFrame:
    """Equal-width bins of each model's score between that model's own extremes.

    The scores are written once, as they may be dear to compute. One pass over them finds all extremes, another counts
    bins; tasks hand on a count per model and bin. Columns model, bin (from 1), n, low and high.
    """
    path = scratch_path(df.sparkSession, "scores")
    df.select(*[F.col(m).cast("double").alias(m) for m in models]).write.parquet(path)
    scores = df.sparkSession.read.parquet(path)
    span = scores.agg(*[f(m).alias(f"{n}_{m}") for m in models for n, f in (("low", F.min), ("high", F.max))]).first()
    found = []
    for m in models:
        low, high = span[f"low_{m}"], span[f"high_{m}"]
        if low is None:
            continue
        number = F.lit(1).cast("bigint")
        if high > low:
            number = F.least(F.floor((F.col(m) - F.lit(low)) / F.lit((high - low) / bins)) + 1, F.lit(bins).cast("bigint"))
        found.append(F.when(F.col(m).isNotNull(), F.struct(F.lit(m).alias("model"), number.alias("bin"), F.lit(low).alias("low"),
                                                           F.lit(high).alias("high"))))
    if not found:
        return df.sparkSession.createDataFrame([], "model string, bin bigint, n bigint, low double, high double")
    cells = scores.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("x.*")
    return cells.groupBy("model", "bin", "low", "high").agg(F.count(F.lit(1)).alias("n")).select("model", "bin", "n", "low", "high")


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values."""
    return df.select(*columns).distinct()


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys occurring more than once, with their counts."""
    return rows_per_group(df, *keys).where(F.col("n") > 1)


def audit_counts(df: DataFrame, by: Sequence[str] = (), **conditions: Column) -> DataFrame:
    """Rows in total and rows meeting each named condition."""
    counted = [F.count_if(c).alias(name) for name, c in conditions.items()]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *counted)


def unknown_values(df: DataFrame, value: str, known: Column) -> DataFrame:
    """Distinct unknown codes in order, one row each."""
    return df.where(F.col(value).isNotNull() & ~known).select(value).distinct().orderBy(value)


def summary_lines(df: DataFrame, unit: str, label: str) -> DataFrame:
    """One line per unit: ``unit — label: n, label: n``, most frequent first."""
    counts = (df.where(F.col(label).isNotNull()).groupBy(unit, label)
              .agg(F.count(F.lit(1)).alias("n")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(label).alias("l"))))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["l"], F.lit(": "), (-x["k"]).cast("string"))), ", ")
    return counts.groupBy(unit).agg(F.concat(F.col(unit), F.lit(" — "), text).alias("line"))
