"""Distributed ranks, numbering, sampling and hot-key joins against brute force."""

from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from glossa.operators import sampling, sets
from glossa.operators.transfer import first_wins, last_wins
from glossa.plans.ranking import first_per_group, hash_rank, running_total, sequential_id
from glossa.plans.skew import filter_join, lookup_join, tell_apart


@pytest.fixture(scope="module")
def rows(spark):
    """3000 rows, a third of them in one group, some without a group."""
    group = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(
        F.concat(F.lit("g"), F.col("id") % 17))
    return spark.range(3000).select("id", group.alias("g"), ((F.col("id") * 7919) % 3001).alias("v")).repartition(7)


def digest(seed, key):
    return md5(f"{seed}|{key}".encode()).hexdigest()


@pytest.mark.parametrize("digits", [1, 4])
def test_hash_rank_per_group(rows, digits):
    got = {r["id"]: (r["g"], r["rank"], r["n"]) for r in
           hash_rank(rows, ["id"], 5, ["g"], digits=digits, total="n").collect()}
    groups = defaultdict(list)
    for i, (g, _, _) in got.items():
        groups[g].append(i)
    assert len(got) == 3000 and len(groups["hot"]) == 1000 and groups[None]
    for g, ids in groups.items():
        for rank, i in enumerate(sorted(ids, key=lambda i: (digest(5, i), i)), start=1):
            assert got[i] == (g, rank, len(ids))


@pytest.mark.parametrize("top", [1, 10, 2999, 5000])
def test_hash_rank_top(rows, top):
    got = {r["id"]: r["rank"] for r in hash_rank(rows, ["id"], "s", top=top).collect()}
    best = sorted(range(3000), key=lambda i: digest("s", i))[:top]
    assert got == {i: n for n, i in enumerate(best, start=1)}


def test_sequential_id_global_and_per_group(rows):
    everything = [(r["id"], r["n"]) for r in sequential_id(rows, ["v"], out="n", start=0).collect()]
    order = sorted(range(3000), key=lambda i: (i * 7919) % 3001)
    assert sorted(everything, key=lambda x: x[1]) == [(i, n) for n, i in enumerate(order)]
    grouped = sequential_id(rows, [F.col("v").desc()], ["g"], "n").collect()
    groups = defaultdict(list)
    for r in grouped:
        groups[r["g"]].append((r["n"], r["v"]))
    assert sum(map(len, groups.values())) == 3000
    for pairs in groups.values():
        pairs.sort()
        assert [n for n, _ in pairs] == list(range(1, len(pairs) + 1))
        assert [v for _, v in pairs] == sorted((v for _, v in pairs), reverse=True)


@pytest.fixture(scope="module")
def copies(spark):
    """Two rows with 450 exact copies each."""
    return spark.range(900).select(F.lit("same").alias("a"), (F.col("id") % 2).alias("b")).repartition(5)


@pytest.mark.parametrize("hot_rows", [10, 100_000])
def test_copies_are_numbered_whole(copies, hot_rows):
    got = sorted((r["id"], r["b"]) for r in sequential_id(copies, ["b"], hot_rows=hot_rows).collect())
    assert [i for i, _ in got] == list(range(1, 901))
    assert [b for _, b in got] == [0] * 450 + [1] * 450
    ranked = hash_rank(copies, ["a"], 1, ["b"], hot_rows=hot_rows).collect()
    assert sorted((r["b"], r["rank"]) for r in ranked) == [(b, n) for b in (0, 1) for n in range(1, 451)]
    assert hash_rank(copies, ["a"], 1, top=70, hot_rows=hot_rows).count() == 70


@pytest.mark.parametrize("how,rows", [("left", 900), ("inner", 450), ("left_semi", 450), ("left_anti", 450)])
def test_copies_join_whole(spark, copies, how, rows):
    right = spark.createDataFrame([(1, "w")], "b bigint, w string")
    right = right if how in ("left", "inner") else right.select("b")
    assert lookup_join(copies, right, ["b"], how).count() == rows


def test_copies_are_told_apart(copies):
    spread = tell_apart(copies, ["a"], "t", 10).agg(F.countDistinct("t")).first()[0]
    hashed = tell_apart(copies, ["a"], "t", 100_000).agg(F.countDistinct("t")).first()[0]
    assert (spread, hashed) == (900, 2)


def test_running_total(rows):
    got = sorted((r["v"], r["s"]) for r in running_total(rows, ["v"], "id", "s").collect())
    total = 0
    for v, i in sorted((i * 7919 % 3001, i) for i in range(3000)):
        total += i
        assert got.pop(0) == (v, total)


def test_first_and_last_wins(rows):
    first = {r["g"]: r["id"] for r in first_wins(rows, ["g"], ["id"]).collect()}
    last = {r["g"]: r["id"] for r in last_wins(rows, ["g"], ["id"]).collect()}
    data = rows.collect()
    for g in {r["g"] for r in data}:
        ids = [r["id"] for r in data if r["g"] == g]
        assert first[g] == min(ids) and last[g] == max(ids)
    assert first_per_group(rows, ["g"], ["id"], 3).count() == sum(
        min(3, n) for n in Counter(r["g"] for r in data).values())


def test_first_per_group_beyond_the_window_limit(rows):
    sizes = Counter(r["g"] for r in rows.collect())
    got = Counter(r["g"] for r in first_per_group(rows, ["g"], ["id"], 1000).collect())
    assert got == {g: min(n, 1000) for g, n in sizes.items()}


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_filter_join(spark, rows, how):
    keys = spark.createDataFrame([("hot",), ("hot",), ("g1",), (None,)], "g string")
    plain = Counter(map(tuple, rows.join(keys, ["g"], how).collect()))
    assert Counter(map(tuple, filter_join(rows, keys, ["g"], how).collect())) == plain


def test_first_per_group_limits_before_the_shuffle(rows):
    plan = first_per_group(rows, ["g"], ["id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.fixture
def conf(spark):
    """Settings of one test, put back after it."""
    before = {}

    def put(**settings):
        for key, value in settings.items():
            name = "spark.sql." + key.replace("__", ".")
            before.setdefault(name, spark.conf.get(name))
            spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.set(name, value)


def test_lookup_join_keeps_every_row_of_many_hot_keys(spark, conf):
    conf(autoBroadcastJoinThreshold="-1")
    left = spark.range(0, 120_000, 1, 6).select((F.col("id") % 1200).alias("k"))
    right = spark.range(0, 1000, 1, 2).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    sizes = {how: lookup_join(left, right if how in ("left", "inner") else right.select("k"), ["k"], how).count()
             for how in ("left", "inner", "left_semi", "left_anti")}
    assert sizes == {"left": 120_000, "inner": 100_000, "left_semi": 100_000, "left_anti": 20_000}


def test_ranked_rows_are_exchanged_once(rows, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    plan = hash_rank(rows, ["id"], 1, ["g"], unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("Window"):plan.index("SortMergeJoin")]
    for alone in (hash_rank(rows, ["id"], 1, unique=True, top=50), hash_rank(rows, ["id"], 1, unique=True)):
        plan = alone._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_numbered_rows_are_not_exchanged_after_their_layout(rows, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    plan = sequential_id(rows, ["v"], unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sample_sizes_and_repeatability(rows):
    a = {r["id"] for r in sampling.sample_exact(rows, 100, ["id"], 1).collect()}
    b = {r["id"] for r in sampling.sample_exact(rows.repartition(3), 100, ["id"], 1).collect()}
    assert len(a) == 100 and a == b
    assert sampling.sample_exact(rows, 9999, ["id"], 1).count() == 3000
    assert sampling.sample_exact(rows.where("false"), 5, ["id"], 1).count() == 0


def test_folds_are_balanced(rows):
    got = sampling.stratified_folds(rows, "g", ["id"], 5, 42).collect()
    sizes = Counter((r["g"], r["fold"]) for r in got)
    assert len(got) == 3000
    for g in {r["g"] for r in got}:
        per = [sizes[(g, f)] for f in range(5)]
        assert max(per) - min(per) <= 1


def test_split_sizes(rows):
    sizes = Counter(r["split"] for r in sampling.train_test_split(rows.where("id < 1999"), ["id"]).collect())
    assert sizes == {"train": 1799, "test": 200}


def test_oversample_reaches_the_majority(rows):
    labelled = rows.where("g is not null")
    before = Counter(r["g"] for r in labelled.collect())
    made = sampling.oversample(labelled, "g", ["id"], 3).collect()
    after = Counter(r["g"] for r in made)
    assert set(after.values()) == {max(before.values())} and set(after) == set(before)
    assert len({(r["id"], r["copy"]) for r in made}) == len(made)


def test_combine_rounds(spark):
    one = spark.createDataFrame([(5, "a", "joy"), (6, "b", "fear")], "id int, verse_id string, label string")
    two = spark.createDataFrame([(7, "b", "anger"), (8, "c", "joy")], "id int, verse_id string, label string")
    got = sets.combine_rounds([one, two], "verse_id", ["verse_id"]).orderBy("id").collect()
    assert [(r["id"], r["verse_id"], r["label"]) for r in got] == [(0, "a", "joy"), (1, "b", "fear"), (2, "c", "joy")]


@pytest.fixture
def checkpointed(spark, monkeypatch):
    """Columns of every checkpoint that is made."""
    seen, frame = [], type(spark.range(0))
    real = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **k: seen.append(self.columns) or real(self, *a, **k))
    return seen


def test_only_keys_are_laid_out(spark, rows, checkpointed):
    texts = rows.withColumn("text", F.repeat(F.lit("long "), 50)).withColumn("n", F.lit("clash"))
    got = sequential_id(texts, [F.col("v").desc()], ["g"], "n", key=["id"])
    assert checkpointed == [["g", "id"]] and got.columns == [*texts.drop("n").columns, "n"]
    want = {r["id"]: r["n"] for r in sequential_id(rows, [F.col("v").desc()], ["g"], "n").collect()}
    assert {r["id"]: r["n"] for r in got.collect()} == want and got.where("text is null").isEmpty()


def test_keys_break_ties_and_null_keys_stay(spark):
    tied = spark.createDataFrame([(None, 1, "x"), (3, 1, "y"), (2, 1, "z"), (9, 0, "w")], "id int, v int, text string")
    got = {r["text"]: r["n"] for r in sequential_id(tied, ["v"], out="n", key=["id"]).collect()}
    assert got == {"w": 1, "x": 2, "z": 3, "y": 4}
    assert sequential_id(tied.where("false"), ["v"], out="n", key=["id"]).count() == 0


def test_only_the_order_is_shuffled_for_keys(spark, tmp_path):
    from glossa.plans.ranking import _lay_out
    spark.range(100).select("id", (F.col("id") % 7).alias("v"), F.lit("long").alias("text")).write.parquet(f"{tmp_path}/t")
    read = []
    frame = type(spark.range(0))
    real = frame.checkpoint
    try:
        frame.checkpoint = lambda self, *a, **k: read.append(self._jdf.queryExecution().executedPlan().toString()) or real(self, *a, **k)
        _lay_out(spark.read.parquet(f"{tmp_path}/t"), ["v", "id"], [], True, keep=["id"])
    finally:
        frame.checkpoint = real
    assert "ReadSchema: struct<id:bigint,v:bigint>" in read[0] and "text" not in read[0]


def test_positional_transfer_moves_texts_once(spark, checkpointed):
    from glossa.operators.transfer import transfer_by_position
    target = spark.createDataFrame([(u, i * 7 % 13, f"t{u}-{i}", "old") for u in range(6) for i in range(9 + u % 2)],
                                   "unit int, id int, text string, emotion string")
    source = spark.createDataFrame([(u, i, f"s{u}-{i}", f"e{i}") for u in range(5) for i in range(9)], "unit int, id int, text string, mood string")
    source = source.withColumn("place", F.col("id"))
    target = target.withColumn("place", F.col("id"))
    labels = {"emotion": F.upper("mood")}
    plain = transfer_by_position(target, source, "unit", ["place"], labels)
    checkpointed.clear()
    late = transfer_by_position(target, source, "unit", ["place"], labels, key=["unit", "id"])
    assert checkpointed == [["unit", "id"], ["unit", "id"]] and late.columns == plain.columns
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, plain.collect())) and late.count() == 27
