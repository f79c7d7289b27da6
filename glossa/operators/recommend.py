"""Recommending corpus rows for requests."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa import domains
from glossa.functions.labels import citation, coarse_emotion, lookup, normalized_set
from glossa.functions.scores import top_prediction
from glossa.functions.text import normalize
from glossa.operators.filters import admissible, matches
from glossa.operators.scoring import BATCH, score_candidates, score_texts, top_theme
from glossa.plans.ranking import hash_number, hash_rank, seeded_hash
from glossa.plans.skew import lookup_join
from glossa.session import scratch_path

PER_SECTION = 2
MAX_RESULTS = 5
_SLOTS = 256  # positions a small candidate group is spread over, so that requests spread too


def localized(label: Column, lang: Column, mapping: dict) -> Column:
    """English request label -> corpus language; unknown labels stay."""
    return F.when(lang == "es", lookup(F.lower(label), mapping, label)).otherwise(label)


def section(book: Column, lang: Column, compat_sections: bool = False) -> Column:
    """Section of a book; books outside the fixed lists belong to ``ot``.

    ``compat_sections`` keeps hyphenated book names from matching the lists.
    """
    slug = normalize(book)
    if not compat_sections:
        slug = F.replace(slug, F.lit("-"), F.lit("_"))
    return F.when(lang == "en", lookup(slug, domains.sections("en"), "ot")).otherwise(
        lookup(slug, domains.sections("es"), "ot"))


def search_columns(corpus: DataFrame) -> DataFrame:
    """Add ``emotion_norm``, ``themes_norm`` and ``section``, computed once before the corpus is stored.

    Written with ``write_stage(..., partition_by=["lang", "emotion_norm"])``, a search
    for one emotion reads only its partitions.
    """
    return (corpus.withColumn("emotion_norm", normalize(F.col("emotion")))
            .withColumn("themes_norm", normalized_set(F.col("theme")))
            .withColumn("section", section(F.col("book"), F.col("lang"))))


def _hit(corpus: DataFrame, emotion: str, theme: str, lang: str, compat_contains: bool) -> Column:
    if lang == "es":
        emotion = domains.EMOTIONS_ES.get(emotion.lower(), emotion)
        theme = domains.THEMES_ES.get(theme.lower(), theme)
    if compat_contains or not {"emotion_norm", "themes_norm"} <= set(corpus.columns):
        return matches(F.col("emotion"), F.col("theme"), emotion, theme, compat_contains)
    return (F.col("emotion_norm") == normalize(F.lit(emotion))) & F.array_contains(
        "themes_norm", normalize(F.lit(theme)))


def recommend(corpus: DataFrame, emotion: str, theme: str, lang: str = "en", n: int = MAX_RESULTS,
              key: Sequence[str] = ("verse_id",), seed=0, compat_contains: bool = False) -> DataFrame:
    """Up to ``n`` random matches for one emotion and theme over the whole corpus.

    Uses stored search columns where the corpus has them.
    """
    return corpus.where(_hit(corpus, emotion, theme, lang, compat_contains)).orderBy(seeded_hash(seed, *key), *key).limit(n)


def recommend_by_section(corpus: DataFrame, emotion: str, theme: str, lang: str = "en",
                         n: int = PER_SECTION, key: Sequence[str] = ("verse_id",), seed=0) -> DataFrame:
    """W07 for one request: up to ``n`` random matches from each section."""
    found = corpus.where(_hit(corpus, emotion, theme, lang, False)).withColumn(
        "section", section(F.col("book"), F.lit(lang)))
    picked = hash_rank(found, key, seed, by=["section"], out="_rank", top=n).drop("_rank")
    return picked.orderBy(seeded_hash(f"{seed}-order", *key), *key)


def candidate_index(corpus: DataFrame, key: Sequence[str], group: Sequence[str], seed=0) -> DataFrame:
    """Corpus rows laid out on numbered slots per group, in a seeded random order.

    A group of ``size`` rows occupies slots 0 .. size*repeat-1, slot ``s`` holding
    the row of rank ``s mod size``. Groups below ``_SLOTS`` rows are repeated, so
    every group offers enough distinct join keys; the extra rows per group are
    below ``2 * _SLOTS``.
    """
    ranked = hash_rank(corpus, key, seed, by=group, out="_rank", total="_size")
    turns = F.sequence(F.lit(0).cast("bigint"), _repeats(F.col("_size")) - 1)
    return (ranked.withColumn("_turn", F.explode(turns))
            .withColumn("slot", F.col("_turn") * F.col("_size") + F.col("_rank") - 1)
            .drop("_turn", "_rank", "_size"))


def _repeats(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(_SLOTS) / size))


def group_sizes(corpus: DataFrame, group: Sequence[str]) -> DataFrame:
    """Size and slot count of each group of a corpus."""
    size = F.col("size")
    return corpus.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).withColumn("slots", size * _repeats(size))


def prepare_corpus(corpus: DataFrame, key: Sequence[str], seed=0) -> tuple[DataFrame, DataFrame]:
    """Candidate index over (lang, emotion, theme, section), with its group sizes.

    Normalised labels and sections are computed once here, not once per request.
    """
    group = ["lang", "emotion_norm", "theme_norm", "section"]
    rows = (corpus.withColumn("emotion_norm", normalize(F.col("emotion")))
            .withColumn("theme_norm", F.explode(normalized_set(F.col("theme"))))
            .withColumn("section", section(F.col("book"), F.col("lang")))
            .dropna(subset=["emotion_norm"]))
    return candidate_index(rows, key, group, seed), group_sizes(rows, group)


class StoredIndex(NamedTuple):
    """Tables that requests are answered from: numbered slots with keys, group sizes, and the corpus rows by bucket."""

    slots: DataFrame
    sizes: DataFrame
    rows: DataFrame


def key_bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def store_index(corpus: DataFrame, key: Sequence[str], path: str, seed=0, buckets: int = 16) -> StoredIndex:
    """The index over (lang, emotion, theme, section), written to tables below ``path`` to be computed once and served often.

    ``slots`` has keys only, as often as a row has themes and turns; it lies in folders by language and emotion, so
    the few labels of a batch of requests prune the folders that are read. ``rows`` has every corpus row once,
    whatever its themes, in ``buckets`` folders by a hash of its ``key``, sorted by key in each file: choose as many as make
    a bucket some hundred megabytes, so that a small batch of requests reads little. ``key`` identifies rows and is never null.
    """
    spark = corpus.sparkSession
    labels = [c for c in ("lang", "emotion", "theme", "book") if c not in key]
    slots, sizes = prepare_corpus(corpus.select(*key, *labels), key, seed)
    group = ["lang", "emotion_norm", "theme_norm", "section"]
    slots = slots.select(*group, "slot", *[c for c in key if c not in group], key_bucket(key, buckets).alias("bucket"))
    rows = corpus.withColumn("bucket", key_bucket(key, buckets))
    laid = {"slots": (slots.hint("rebalance", "lang", "emotion_norm"), ["lang", "emotion_norm"]), "sizes": (sizes, []),
            "rows": (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *key), ["bucket"])}
    parts = []
    for name, (df, folders) in laid.items():
        df.write.partitionBy(*folders).parquet(f"{path}/{name}")
        parts.append(spark.read.schema(df.schema).parquet(f"{path}/{name}").select(df.columns))
    return StoredIndex(*parts)


def answer_requests(requests: DataFrame, index: DataFrame, sizes: DataFrame, payload: Sequence[str],
                    n: int = PER_SECTION, seed=0) -> DataFrame:
    """For every (request_id, lang, emotion, theme) up to ``n`` rows per section.

    A request starts at a random slot of each matching group and takes the next
    ``min(n, size)`` slots. Slots follow a random order of the group, so this is a
    random sample without replacement, found by an equi-join on one slot per
    pick: no request is ever paired with a whole group, however common its
    labels are.
    """
    return _picked(requests, index, sizes, payload, n, seed).select("request_id", "lang", "section", "pick", *payload)


def _picked(requests: DataFrame, index: DataFrame, sizes: DataFrame, columns: Sequence[str], n: int, seed) -> DataFrame:
    """Picks of each request with columns of the index."""
    wanted = requests.select(
        "request_id", "lang",
        normalize(localized(F.col("emotion"), F.col("lang"), domains.EMOTIONS_ES)).alias("emotion_norm"),
        normalize(localized(F.col("theme"), F.col("lang"), domains.THEMES_ES)).alias("theme_norm"))
    group = ["lang", "emotion_norm", "theme_norm"]
    sized = lookup_join(wanted, sizes, group, "inner")
    begin = F.pmod(hash_number(seeded_hash(seed, "request_id", "section"), 12), F.col("slots"))
    picks = (sized.withColumn("pick", F.explode(F.sequence(
                 F.lit(0).cast("bigint"), F.least(F.lit(n), F.col("size")) - 1)))
             .withColumn("slot", F.pmod(begin + F.col("pick"), F.col("slots")))
             .select("request_id", *group, "section", "pick", "slot"))
    # few picks are broadcast to the corpus rows by Spark itself, which knows their bytes
    columns = [c for c in columns if c not in (*group, "section", "slot")]
    return index.select(*group, "section", "slot", *columns).join(picks, [*group, "section", "slot"])


def answer_from_store(requests: DataFrame, index: StoredIndex, payload: Sequence[str], key: Sequence[str],
                      n: int = PER_SECTION, seed=0) -> DataFrame:
    """J08 from the tables of ``store_index``: the same picks, then their rows by key.

    The picked keys of the batch are written first. Only the buckets that they fall into, numbers below the
    index's count of buckets, come to the driver, so that the scan of the corpus rows is pruned to those folders.
    """
    spark = requests.sparkSession
    path = scratch_path(spark, "picked")
    own = [c for c in key if c not in ("lang", "section")]
    picked = _picked(requests, index.slots, index.sizes, [*own, "bucket"], n, seed).select(
        "request_id", "lang", "section", "pick", *own, "bucket")
    picked.write.parquet(path)
    picked = spark.read.schema(picked.schema).parquet(path)
    if set(payload) <= {"request_id", "lang", "section", "pick", *own}:
        return picked.select("request_id", "lang", "section", "pick", *payload)
    buckets = sorted(r["bucket"] for r in picked.select("bucket").distinct().collect())
    rest = [c for c in payload if c not in picked.columns]
    rows = index.rows.where(F.col("bucket").isin(buckets)).select("bucket", *key, *[c for c in rest if c not in key])
    return picked.join(rows, ["bucket", *key]).select("request_id", "lang", "section", "pick", *payload)


def admitted(requests: DataFrame, text: str = "text") -> DataFrame:
    """Requests that pass the length rule."""
    return requests.where(admissible(F.col(text)))


def analyze_requests(requests: DataFrame, emotion: Callable, theme: Callable,
                     themes: Sequence[str] = tuple(t.capitalize() for t in domains.THEMES),
                     batch: int = BATCH) -> DataFrame:
    """Emotion and theme of admitted request texts, with scores.

    Adds ``emotion``, ``emotion_score``, ``theme`` and ``theme_score``; emotions are
    the coarse ones, the theme is the single best and in the request's language.
    """
    scored = score_texts(admitted(requests), "text", emotion, "_e", batch)
    scored = score_candidates(scored, "text", theme, themes, "_t", batch, multi_label=False)
    best, shown = top_prediction(F.col("_e")), top_theme(F.col("_t"), F.col("lang"))
    return (scored.withColumn("_b", best).withColumn("_s", shown)
            .withColumn("emotion", F.when(F.col("_b").isNotNull(), coarse_emotion(F.col("_b.label"))))
            .withColumn("emotion_score", F.col("_b.score")).withColumn("theme", F.col("_s.label"))
            .withColumn("theme_score", F.col("_s.score"))
            .drop("_e", "_e_error", "_t", "_t_error", "_b", "_s"))


def citations(answers: DataFrame) -> DataFrame:
    """the picks of each request as an array of citations, by section and pick.

    An answered request has at most ``n`` rows per section, so its array is short.
    """
    line = citation(F.col("book"), F.col("chapter"), F.col("verse"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("section", "pick", line.alias("line"))))
    return answers.groupBy("request_id").agg(F.transform(listed, lambda x: x["line"]).alias("verses"))
