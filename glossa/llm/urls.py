"""URL rules by a sort-merge range join: a sorted sweep over reversed-host keys. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import lower_ascii

SLICE_KEYS = 50_000  # url keys that one slice of the sweep sorts


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _host_key(labels: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``: a domain's key starts the keys of its subdomains."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."))


def _sort_key(host_key: Column, path: Column) -> Column:
    """Bytes in hex, so that ``g`` sorts behind every continuation of a key."""
    return F.hex(F.encode(F.concat(host_key, path), "UTF-8"))


def rule_boundaries(rules: DataFrame) -> DataFrame:
    """Start and end of each rule's interval of keys, with the rule on top of the stack from there on.

    ``rules`` has host, path and verdict. A start pushes its rule; an end pops it,
    which uncovers the nearest rule around it (null: none). Rules without a host
    are left out, a null path is empty, and of equal rules a blocking one counts.
    """
    clean = rules.where(F.col("host").isNotNull()).select(
        lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    keyed = (clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
             .withColumn("host_key", _host_key(F.split("host", r"\.")))
             .select("host_key", _sort_key(F.col("host_key"), F.col("path")).alias("key"),
                     F.struct(F.concat("host", "path").alias("rule"), "verdict").alias("top")))
    # Only rules of the same host nest here: a url asks once for each of its domains.
    inner = keyed.select("host_key", "key", F.explode(F.expr("sequence(0, length(key), 2)")).alias("_n")).where(
        F.col("_n") < F.length("key")).select("host_key", F.col("key").alias("inner_key"),
                                              F.expr("substring(key, 1, _n)").alias("key"))
    parents = (inner.join(keyed, ["host_key", "key"]).groupBy("inner_key")
               .agg(F.max_by("top", F.length("key")).alias("parent"))
               .withColumnRenamed("inner_key", "key"))
    both = keyed.join(parents, "key", "left")
    starts = both.select("host_key", "key", "top")
    ends = both.select("host_key", F.concat("key", F.lit("g")).alias("key"), F.col("parent").alias("top"))
    return starts.unionByName(ends)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to pages.

    A rule (host, path, verdict) fits its host and all subdomains if the url's
    path starts with the rule's path; the longest host and path wins, the deeper
    host at equal length. ``rule`` is host and path of that rule, null where none
    fits; the verdict is then ``default``. Null urls and urls without ``://``
    have an empty host and path and fit no rule. Repeated rows stay repeated,
    other columns stay, and input columns named like the new ones are replaced.

    Distinct (host, path) pairs ask once for each domain of the host that has
    rules. Asked keys and rule boundaries are sorted together, and the last
    boundary before a key carries the top of the stack of open rules. A slice of
    the sweep is one domain, or a hash share of the keys of a domain with many;
    each share meets all boundaries of the domain, so no domain is one task's.
    """
    boundaries = rule_boundaries(rules)
    pages = pages.drop("host", "path", "rule", "verdict")
    placed = pages.withColumns({"host": F.coalesce(url_host(F.col(url)), F.lit("")),
                                "path": F.coalesce(url_path(F.col(url)), F.lit(""))})
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda n: _host_key(F.slice(labels, F.size(labels) - n + 1, n)))
    asked = (placed.where(F.col("host") != "").select("host", "path").distinct()
             .select("host", "path", F.explode(domains).alias("host_key")))
    ruled = boundaries.select("host_key").distinct()
    shares = (asked.join(ruled, "host_key").groupBy("host_key").agg(F.count(F.lit(1)).alias("_keys"))
              .select("host_key", F.ceil(F.col("_keys") / SLICE_KEYS).cast("int").alias("_shares")))
    share = F.pmod(F.xxhash64("host", "path"), F.col("_shares")).cast("int")
    keys = asked.join(shares, "host_key").select(
        "host_key", share.alias("_share"), _sort_key(F.col("host_key"), F.col("path")).alias("key"),
        F.lit(1).alias("_kind"), F.lit(None).cast(boundaries.select(F.struct("top")).schema[0].dataType).alias("_open"),
        "host", "path")
    marks = boundaries.join(shares, "host_key").select(
        "host_key", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"), "key",
        F.lit(0).alias("_kind"), F.struct("top").alias("_open"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    sweep = Window.partitionBy("host_key", "_share").orderBy("key", "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    swept = (marks.unionByName(keys).withColumn("_top", F.last("_open", ignorenulls=True).over(sweep)["top"])
             .where((F.col("_kind") == 1) & F.col("_top").isNotNull()))
    best = (swept.groupBy("host", "path")
            .agg(F.max_by("_top", F.struct(F.length("_top.rule"), F.length("host_key"))).alias("_best")))
    return placed.join(best, ["host", "path"], "left").select(
        *pages.columns, "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
