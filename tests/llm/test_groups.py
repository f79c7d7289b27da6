"""Duplicates, joins, contamination and shards against brute force on small fixtures."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import common, decontam, dedup, fuse, jaccard, sharding
from glossa.llm.components import components

SCHEMA = "doc_id bigint, text string, digest string, n string, hits int, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)


# Exact duplicates

@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 50000])
def test_fuse_filter_holds_its_keys(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    made = fuse.build(keys)
    assert made.holds(keys).all()
    others = np.random.default_rng(n + 1).integers(0, 1 << 63, 20000, dtype=np.uint64)
    assert made.holds(others).mean() < 0.02
    assert n < 10000 or len(made.prints) < 1.4 * n


def copies(seed):
    rng = random.Random(seed)
    texts = ["Same Text", "same text", "SAME TEXT", "É", "é", "", None, "x" * 100000, "other", "Other "]
    rows = [(rng.randrange(200), rng.choice(texts)) for _ in range(400)] + [(i, f"only {i}") for i in range(100)]
    return [*rows, (None, "same text"), (None, "null only"), (None, "null only"), (7, "twice"), (7, "twice")]


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("digest", [dedup.sha256, lambda c: F.crc32(F.encode(c, "UTF-8")) % 5], ids=["sha256", "weak"])
def test_exact_duplicates(spark, digest):
    rows = copies(1)
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    want = Counter()
    for g in groups.values():
        keep = max((i for i in g if i is not None), default=None)
        spare = 1
        for i in sorted(g, key=lambda i: i is not None and i):
            kept = i == keep and spare == 1
            spare -= kept
            want[(i, keep, len(g), kept)] += 1
    docs = frame(spark, rows)
    got = dedup.exact_duplicates(docs, dedup.halfway(docs), digest=digest)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()) == want


def test_snapshots_screen_the_incoming_batch(spark):
    group = lambda lo, hi: dedup.digest_groups(dedup.digest_rows(
        spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 700).alias("text")), F.lit(True)))
    merged = dedup.merge_groups(group(1000, 1500), [group(0, 300), group(300, 600)])
    sizes = {r["keep"]["doc_id"]: r["size"] for r in merged.collect()}
    want = {}
    for i in [*range(600), *range(1000, 1500)]:
        want.setdefault(i % 700, []).append(i)
    assert sizes == {max(g): len(g) for g in want.values()}
    filters = dedup.snapshot_filters(group(0, 300), 3)
    positive = dedup.screen(group(250, 2000), filters, 3).count()
    assert 300 <= positive < 330 + 20


def test_drop_duplicates_keeps_columns_and_one_row(spark):
    docs = frame(spark, copies(2))
    kept = dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(fold(r["text"]) for r in kept.collect()) == Counter({fold(t) for _, t in copies(2)})
    assert dedup.drop_duplicates(docs.limit(0)).count() == 0


# Near duplicates

def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", fold(text).encode())


def shingles(text, size):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, rule):
    sets = [shingles(t, rule.size) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= rule.percent * (len(a) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return Counter((rows[i][0], len(sets[i]), rows[i][0] if not sets[i] else least.get(top(i))) for i in range(len(rows)))


def near(seed, size=160, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passage = [word() for _ in range(40)]
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 14, 25, 60, 300]))]
        text += passage if rng.random() < 0.5 else []
        for _ in range(rng.choice([1, 2, 5, size // 5])):
            now = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(now))
                now[at:at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
                now = now or [word()]
            rows.append("  ".join(now) if rng.random() < 0.5 else "\n".join(now).upper())
    rows += ["", None, " \t\n", "one", "ONE", "one two", "é one two three", "long " * 20000, "long " * 20000 + "end"]
    return [(i if i % 17 else None, t) for i, t in enumerate(rng.sample(rows, len(rows)), 1)]


@pytest.mark.parametrize("seed,size,percent,vocabulary", [(1, 4, 85, 400), (3, 4, 85, 6), (4, 2, 50, 30)])
def test_join_equals_brute_force(spark, seed, size, percent, vocabulary):
    rule, rows = jaccard.Rule(size, percent), near(seed, vocabulary=vocabulary)
    got = jaccard.near_duplicates(frame(spark, rows).repartition(4), rule)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, rule)


@pytest.mark.parametrize("limit", [0, 30, 10 ** 6])
def test_every_boundary_gives_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "boundary", lambda ordered, rule: limit)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "SMALL_LIST", 0)
    rule, rows = jaccard.Rule(3, 80), near(9, 60, 60)
    got = jaccard.near_duplicates(frame(spark, rows).repartition(3), rule)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, rule)


def brute_links(rows, rule):
    sets = [shingles(t, rule.size) for _, t in rows]
    links = [sum(1 for j, b in enumerate(sets) if i != j and a & b and 100 * len(a & b) >= rule.percent * len(a | b))
             for i, a in enumerate(sets)]
    return Counter((doc_id, len(own), n) for (doc_id, _), own, n in zip(rows, sets, links))


@pytest.mark.parametrize("limit", [None, 0, 30, 10 ** 6])
def test_every_link_is_counted(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda ordered, rule: limit)
        monkeypatch.setattr(jaccard, "BLOCK", 3)
    rule, rows = jaccard.Rule(3, 80), near(9, 60, 60)
    base = [f"v{i}" for i in range(60)]
    rows += [(1000 + i, " ".join(base[:i] + ["new"] + base[i + 1:])) for i in range(0, 60, 2)]  # a group of variants
    rows += [(2000, " ".join(base)), (2001, " ".join(base)), (None, " ".join(base))]
    got = jaccard.link_counts(frame(spark, rows).repartition(3), rule)
    want = brute_links(rows, rule)
    assert Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got.collect()) == want
    assert want[(2000, 58, 32)] == want[(2001, 58, 32)] == 1


def test_drop_near_duplicates(spark):
    rows = [(i, t) for i, t in near(6) if i is not None]
    docs = frame(spark, rows)
    kept = jaccard.drop_near_duplicates(docs, jaccard.Rule())
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute(rows, jaccard.Rule()) if i == c}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_drop_near_duplicates_goes_by_row(spark):
    base, alone = [f"v{i}" for i in range(90)], " ".join(f"u{i}" for i in range(40))
    near_ = lambda i: " ".join([*base[:-1], f"end{i}"])
    rows = [(1, near_(0)), (1, near_(1)), (2, near_(2)), (2, alone), (None, near_(3)), (None, "a b c d e f"), (None, "a b c d e f"),
            (None, None), (None, None), (2, ""), (2, "")]
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.drop_near_duplicates(frame(spark, rows)).collect())
    of_group = [k for k in kept.elements() if (k[1] or "").startswith("v0 ")]
    assert len(of_group) == 1 and of_group[0][0] == 1
    assert kept - Counter(of_group) == Counter([(2, alone), (None, "a b c d e f"), (None, None), (None, None), (2, ""), (2, "")])


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_small_tables_of_near_duplicates_are_few_files(spark, monkeypatch):
    """pipeline, op4: no file of edges or suspects for each shuffle partition, and more files if there are rows for them."""
    files = []

    def noted(df, name, *args, **kwargs):
        out = common.stored(df, name, *args, **kwargs)
        if name in ("edges", "suspects"):
            files.append(len(out.inputFiles()))
        return out

    for module in ("components", "jaccard"):
        monkeypatch.setattr(f"glossa.llm.{module}.stored", noted)
    same = [f"text {i // 4} " + " ".join(f"w{i // 4}x{k}" for k in range(30)) + f" end{i}" for i in range(160)]
    docs = spark.createDataFrame(list(enumerate(same)), "doc_id bigint, text string")
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in names}
    cores, got, most = spark.sparkContext.defaultParallelism, [], []
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        for rows in (common.FILE_ROWS, 10):
            monkeypatch.setattr(common, "FILE_ROWS", rows)
            files.clear()
            found = jaccard.near_duplicates(docs, jaccard.Rule(5, 80)).collect()
            got.append(sorted((r["doc_id"], r["component_id"]) for r in found))
            most.append(max(files))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got[0] == got[1] == [(i, i - i % 4) for i in range(160)]
    assert most[0] <= cores < most[1]


# Contamination

def test_contamination(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(50)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 5, 6, 14, 40])))) for i in range(40)]
    items += [(3, items[3][1]), (None, items[5][1]), (99, None), (98, "")]
    docs = []
    for i in range(150):
        body = [word() for _ in range(rng.choice([0, 10, 400]))]
        planted = words(rng.choice(items)[1])
        planted = [w.decode() for w in planted]
        if planted and rng.random() < 0.5:
            planted[rng.randrange(len(planted))] = word()
        body[len(body) // 2:len(body) // 2] = planted
        docs.append((i % 140, "\t".join(body).upper()))
    docs += [(None, items[7][1]), (1, None), (2, ""), (500, "x " * 50000 + items[8][1])]
    want = Counter()
    for i, t in docs:
        own = shingles(t, 5) if len(words(t)) >= 5 else set()
        for k, x in items:
            s = shingles(x, 5) if len(words(x)) >= 5 else set()
            if s and 5 * len(s & own) >= 4 * len(s):
                want[(i, k, len(s & own), len(s))] += 1
    monkeypatch.setattr(decontam, "BLOCK", 200)
    frame_ = frame(spark, docs)
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id bigint, text string, hits int")
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", ("text", 200))
    got = decontam.contaminated(frame_, bench)
    assert Counter((r["doc_id"], r["item_id"], r["shared"], r["size"]) for r in got.collect()) == want
    clean = decontam.drop_contaminated(frame_, bench)
    assert clean.columns == frame_.columns and clean.count() == len(docs) - sum(
        any(5 * len(shingles(t, 5) & shingles(x, 5)) >= 4 * len(shingles(x, 5)) for _, x in items if len(words(x)) >= 5)
        for _, t in docs if len(words(t)) >= 5)
    assert decontam.contaminated(frame_.limit(0), bench).count() == 0
    assert decontam.contaminated(frame_, bench.limit(0)).count() == 0


# Shards

def shard(spark, rows, shards=8):
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, lang string, n bigint, shard string")
    dims = {"l": sharding.text_number(F.col("lang")), "m": sharding.number(F.col("n"))}
    return [r.asDict() for r in sharding.shard_rows(docs, dims, shards).collect()]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(spark, shards):
    rng = random.Random(shards)
    rows = [(rng.randrange(2000), "ab" * rng.randrange(200) + str(rng.randrange(12)), rng.choice(["en", "de", None, "é"]), rng.choice([None, 1, 1, 1, rng.random() * 1e6 // 1]))
            for _ in range(3000)]
    rows = [(i, t, lang, None if n is None else int(n)) for i, t, lang, n in rows]
    rows += [(5, "hot " * 50, "en", 1)] * 1500 + [(None, None, None, None)] * 3
    got = shard(spark, rows, shards)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / shards
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    groups = {}
    for r in got:
        groups.setdefault((r["text_crc32"], r["size"]), []).append(r["shard"])
    light = sharding.GROUP_SHARE * sum(sizes.values()) / shards
    assert all(len(set(p)) == 1 for (_, size), p in groups.items() if size * len(p) <= light)


def test_shards_of_odd_tables(spark):
    assert shard(spark, []) == []
    one = shard(spark, [(1, "x" * 300000, "en", 1)])
    assert len(one) == 1 and one[0]["slot"] == 0 and 0 <= one[0]["shard"] < 8
    same = shard(spark, [(i, "same", "en", 1) for i in range(4000)])
    assert max(Counter(r["shard"] for r in same).values()) < 700
