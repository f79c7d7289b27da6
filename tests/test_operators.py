"""Table operators on small fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glossa.catalog.scoring import theme_scorer, vowel_scorer
from glossa.domains import EMOTIONS, EMOTIONS_ES, THEMES, THEMES_ES, sections
from glossa.operators import aggregates, annotate, evaluate, filters, recommend, scoring
from glossa.operators.transfer import transfer_audit, transfer_by_position, transfer_labels
from glossa.plans import labeling
from glossa.session import scratch_path
from glossa.sources.tables import write_stage


def test_domains():
    assert len(sections("en")) == 27 == len(sections("es"))
    assert sections("es")["3_juan"] == "nt_rest" and sections("en")["john"] == "gospels"


@pytest.mark.parametrize("book,chapter,verse,ok", [
    ("John", "3", "16", True), ("John", "2", "5.0", True), (" ", "1", "1", False), ("John", "abc", "1", False),
    ("John", "1", "0", False), ("John", "-1", "2", False), (None, None, None, False), ("John", "1.9", "0.5", False),
    ("John", "inf", "1", False), ("John", "nan", "1", False), ("John", "", "1", False)])
def test_valid_row(spark, book, chapter, verse, ok):
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(c) for c, v in zip("bcv", (book, chapter, verse))])
    assert row.select(filters.valid_row(F.col("b"), F.col("c"), F.col("v"))).first()[0] is ok


def test_clean_corpus(spark):
    raw = spark.createDataFrame(
        [("John", "2", "1", None, " a  b ", "u"), ("John", "1", "2", "s", "“x”\n  y", "u"), ("John", "0", "2", "s", "bad", "u"),
         ("Ruth", "1", "1", "s", None, "u")], "book string, chapter string, verse string, subtitle string, text string, source_url string")
    got = labeling.clean_corpus(raw)
    assert got.columns == ["id", "book", "chapter", "verse", "subtitle", "text", "verse_id", "source_url", "theme", "emotion"]
    assert sorted((r["id"], r["book"], r["verse_id"], r["text"]) for r in got.collect()) == [
        (1, "John", "John_1_2", '"x"\ny'), (1, "Ruth", "Ruth_1_1", ""), (2, "John", "John_2_1", "a b")]


def test_assert_domain(spark):
    df = spark.createDataFrame([("joy",), ("awe",)], "label string")
    with pytest.raises(ValueError, match="awe"):
        filters.assert_domain(df, "label", EMOTIONS)
    assert filters.assert_domain(df.where("label = 'joy'"), "label", EMOTIONS).count() == 1


CORPUS = [("John", "joy", "love;faith", "John_3_16"), ("Genesis", "joy", "hope", "Genesis_1_1"), ("Ruth", "joy", None, "Ruth_1_1"),
          ("3-juan", "Alegría", "amor; fe", "3-Juan_1_1")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "book string, emotion string, theme string, verse_id string")


def test_recommend(corpus):
    def ids(df):
        return [r["verse_id"] for r in df.collect()]
    assert ids(recommend.recommend(corpus, "joy", "love")) == ["John_3_16"]
    assert ids(recommend.recommend(corpus, "JOY ", "Love")) == ["John_3_16"]
    assert ids(recommend.recommend(corpus, "joy", "love", "es")) == ["3-Juan_1_1"]
    assert ids(recommend.recommend(corpus, "fear", "love")) == []
    assert ids(recommend.recommend(corpus.where("false"), "joy", "love")) == []
    assert set(ids(recommend.recommend(corpus, "joy", "a", compat_contains=True))) == {"John_3_16", "Ruth_1_1"}


def test_stored_search_reads_one_partition(spark, corpus):
    path = scratch_path(spark, "search")
    write_stage(recommend.search_columns(corpus.withColumn("lang", F.lit("en"))), path, ["lang", "emotion_norm"])
    found = recommend.recommend(spark.read.parquet(path), "JOY", "Faith")
    assert [r["verse_id"] for r in found.collect()] == ["John_3_16"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "emotion_norm" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.fixture(scope="module")
def crowd(spark):
    """A corpus whose hot label pair holds most rows, and requests that mostly ask for it."""
    hot = F.col("id") % 3 != 0
    corpus = spark.range(1500).select(
        F.concat(F.lit("v"), "id").alias("verse_id"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 5 == 0, "john").when(F.col("id") % 5 == 1, "acts").otherwise("ruth").alias("book"),
        F.when(hot, "joy").otherwise("fear").alias("emotion"),
        F.when(hot, "love;hope").when(F.col("id") == 3, "faith").otherwise("hope").alias("theme"))
    asks = spark.range(400).select(
        F.col("id").cast("string").alias("request_id"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 4 == 0, "fear").otherwise("joy").alias("emotion"),
        F.when(F.col("id") % 4 != 0, "Love").when(F.col("id") % 8 == 0, "faith").otherwise("forgiveness").alias("theme"),
        F.lit("long enough").alias("text"))
    return corpus, asks


def test_batch_requests_are_whole_and_correct(crowd):
    corpus, asks = crowd
    index, sizes = recommend.prepare_corpus(corpus, ["verse_id"])
    rows = recommend.answer_requests(asks, index, sizes, ["verse_id"]).collect()
    labels = {r["verse_id"]: r for r in corpus.collect()}
    found = {}
    for r in rows:
        found.setdefault((r["request_id"], r["section"]), []).append(r["verse_id"])
    part = {"john": "gospels", "acts": "nt_rest", "ruth": "ot"}
    for ask in asks.collect():
        for section in ("gospels", "nt_rest", "ot"):
            fits = {v for v, c in labels.items() if c["emotion"] == ask["emotion"]
                    and ask["theme"].lower() in c["theme"].split(";") and part[c["book"]] == section}
            got = found.get((ask["request_id"], section), [])
            assert len(got) == len(set(got)) == min(2, len(fits)) and set(got) <= fits
    used = {r["verse_id"] for r in rows if labels[r["verse_id"]]["theme"] == "love;hope"}
    assert len(used) > 400  # requests with equal labels get different rows


def test_batch_requests_never_pair_with_a_whole_group(crowd):
    corpus, asks = crowd
    index, sizes = recommend.prepare_corpus(corpus, ["verse_id"])
    assert index.count() < 1500 * 2 + 20 * 2 * 256
    most = index.groupBy("lang", "emotion_norm", "theme_norm", "section", "slot").count().agg(F.max("count")).first()[0]
    assert most == 1


def test_stored_index_answers_alike_and_keeps_texts_once(spark, crowd, tmp_path):
    corpus, asks = crowd
    corpus = corpus.withColumn("text", F.concat(F.lit("text of "), "verse_id"))
    index, sizes = recommend.prepare_corpus(corpus, ["verse_id"])
    want = recommend.answer_requests(asks, index, sizes, ["verse_id", "book", "text"])
    store = recommend.store_index(corpus, ["verse_id"], f"{tmp_path}/index", buckets=8)
    got = recommend.answer_from_store(asks, store, ["verse_id", "book", "text"], ["verse_id"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert store.rows.count() == corpus.count() and store.slots.count() > corpus.count()
    assert not {"text", "book", "theme"} & set(store.slots.columns)
    assert recommend.answer_from_store(asks.where("false"), store, ["text"], ["verse_id"]).count() == 0


def test_few_requests_read_few_buckets(spark, crowd, tmp_path):
    corpus, asks = crowd
    store = recommend.store_index(corpus.withColumn("text", F.lit("long")), ["verse_id"], f"{tmp_path}/index", buckets=64)
    one = recommend.answer_from_store(asks.where("request_id = '5'"), store, ["text"], ["verse_id"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"PartitionFilters: \[bucket#\d+ IN \(([\d,]+)\)", plan).group(1).split(",")
    rows = one.collect()
    assert 1 <= len(read) <= len(rows) <= 6 and len(rows) == len({(r["section"], r["pick"]) for r in rows})


def test_transfer(spark):
    source = spark.createDataFrame(
        [(1, 1, 1, 0, "love;faith", "joy"), (1, 1, 2, 1, None, "sadness"), (1, 1, 1, 2, " Hope ", " FEAR"), (2, None, 1, 3, "love", "joy")],
        "book_no int, chapter int, verse int, id int, theme string, emotion string")
    target = spark.createDataFrame(
        [(1, "1", "1", "a"), (1, "1", "2.0", "b"), (1, "x", "1", "c"), (2, "1", "1", "d"), (3, "1", "1", "e")],
        "book_no int, chapter string, verse string, text string")
    out = transfer_labels(target, source, ["id"])
    assert {r["text"]: (r["theme"], r["emotion"], r["matched"], r["chapter"]) for r in out.collect()} == {
        "a": ("esperanza", "Miedo", True, "1"), "b": ("", "Tristeza", True, "1"), "c": ("", "", False, "x"),
        "d": ("", "", False, "1"), "e": ("", "", False, "1")}
    audit = {r["book_no"]: (r["rows"], r["unmatched"]) for r in transfer_audit(out, "book_no").collect()}
    assert audit == {1: (3, 1), 2: (1, 1), 3: (1, 1)}


def test_transfer_by_position_skips_unequal_units(spark):
    target = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "book int, verse int, text string")
    source = spark.createDataFrame([(1, 5, "x"), (1, 9, "y"), (2, 1, "p"), (2, 2, "q")], "book int, verse int, emotion string")
    got = transfer_by_position(target, source, "book", ["verse"], {"emotion": F.col("emotion")}).collect()
    assert sorted((r["text"], r["emotion"]) for r in got) == [("a", "x"), ("b", "y")]


def test_annotation_round_trip(spark):
    text = spark.createDataFrame(
        [("Genesis_1_1", "a", 0), ("Genesis_1_2", "b", 1), ("Genesis_1_2", "late", 2), ("Genesis_1_3", "c", 3), (None, "n", 4),
         ("Genesis_1_4", None, 5)], "verse_id string, text string, row int")
    done = spark.createDataFrame([("Genesis_1_1",), (None,)], "verse_id string")
    picked = annotate.select_for_annotation(text, 2, done, position=["row"])
    assert picked.columns == ["id", "verse_id", "verse"]
    assert {r["verse_id"]: r["verse"] for r in picked.collect()} == {"Genesis_1_2": "b", "Genesis_1_3": "c"}
    assert sorted(r["id"] for r in picked.collect()) == [0, 1]
    samples = spark.createDataFrame([(1, "v1", "a"), (2, "v2", "b"), (3, "v3", "c")], "id int, verse_id string, verse string")
    answers = spark.createDataFrame([("1", "v1", " Love"), ("3", "v3", "HOPE "), ("99", "v99", "error"), ("2", "vX", "joy")],
                                    "id string, verse_id string, label string")
    merged = annotate.merge_annotations(samples, answers)
    assert merged.columns == ["id", "verse_id", "verse", "label"]
    assert {r["id"] for r in merged.collect()} == {"1", "3"}
    assert [(r["id"], r["label"]) for r in annotate.tidy_labels(merged).collect()] == [("3", "joy")]


def test_report_and_agreement(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None), ("c", "a"), ("c", "d")], "t string, p string")
    got = {r["label"]: r for r in evaluate.classification_report(df, "t", "p").collect()}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["f1"], got["a"]["support"]) == (0.5, 0.5, 0.5, 2)
    assert (got["c"]["precision"], got["c"]["recall"], got["c"]["f1"]) == (0.0, 0.0, 0.0)
    assert (got["d"]["support"], got["d"]["recall"]) == (0, 0.0)
    assert got["accuracy"]["f1"] == pytest.approx(2 / 6) and got["weighted avg"]["support"] == 6
    assert evaluate.macro_f1(df, "t", "p", ["a", "b", "z"]).first()[0] == pytest.approx((0.5 + 2 / 3) / 3)
    assert evaluate.agreement_rates(df, ["t", "p"]).first()["agreement"] == pytest.approx(2 / 6)
    sets = spark.createDataFrame([(["x", "y"], ["y", "x"]), ([], []), (["x"], ["x", "z"])], "a array<string>, b array<string>")
    row = evaluate.set_agreement(sets, "a", "b").first()
    assert row["exact_match"] == pytest.approx(2 / 3) and row["mean_jaccard"] == pytest.approx((1 + 0 + 0.5) / 3)


def test_describe_and_quantiles(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (4.0, "b"), (None, None), (10.0, "a")], "x double, s string")
    got = {r["column"]: r for r in aggregates.describe(df).collect()}
    assert (got["x"]["q25"], got["x"]["q50"], got["x"]["q75"], got["x"]["count"]) == (1.75, 3.0, 5.5, 4)
    assert (got["s"]["unique"], got["s"]["top"], got["s"]["freq"]) == (2, "a", 2)
    assert aggregates.exact_quantiles(df.where("x = 2"), "x", [0.25]).first()["value"] == 2.0


def test_multi_label_and_summary(spark):
    df = spark.createDataFrame([("u", "a;b"), ("u", "a"), ("w", ""), ("w", None)], "unit string, l string")
    assert {r["label"]: r["n"] for r in aggregates.multi_label_counts(df, "l").collect()} == {"a": 2, "b": 1}
    assert {r["label"]: r["n"] for r in aggregates.multi_label_counts(df, "l", True).collect()} == {"a": 2, "b": 1, "": 1}
    assert [r["line"] for r in aggregates.summary_lines(df.where("unit = 'u'"), "unit", "l").collect()] == ["u — a: 1, a;b: 1"]
    models = spark.createDataFrame([(0.0, 5.0), (1.0, 5.0), (0.5, None)], "m1 double, m2 double")
    bins = {(r["model"], r["bin"]): r["n"] for r in aggregates.score_histogram(models, ["m1", "m2"]).collect()}
    assert bins == {("m1", 1): 1, ("m1", 11): 1, ("m1", 20): 1, ("m2", 1): 2}


def test_scorer_contract(spark):
    df = spark.createDataFrame([(1, "eee"), (2, "boom"), (3, None), (4, "iii")], "id int, text string").coalesce(1)
    got = {r["id"]: (r["e"], r["preds_error"]) for r in scoring.score_texts(
        df, "text", vowel_scorer(fail_on="boom"), batch=2).select("id", scoring.emotion_label().alias("e"), "preds_error").collect()}
    assert got[1] == ("error", "RuntimeError: cannot score") and got[2][0] == "error"
    assert got[3] == (None, None) and got[4] == ("fear", None)
    short = scoring.score_texts(df, "text", vowel_scorer(short_by=1), batch=4).collect()
    assert all(("predictions for 3 rows" in (r["preds_error"] or "")) == (r["id"] != 3) for r in short)
    kept = scoring.without_failed_units(
        spark.createDataFrame([("a", None), ("a", "x"), ("b", None)], "unit string, err string"), "unit", "err")
    assert [r["unit"] for r in kept.collect()] == ["b"]


def test_factory_runs_once_per_task(spark):
    def factory():
        seen = []

        def classify(texts):
            seen.append(len(texts))
            return [[{"label": f"{len(seen)}:{len(texts)}", "score": 1.0}] for _ in texts]

        return classify

    df = spark.range(0, 100, 1, 1).select(F.col("id").cast("string").alias("text"))
    labels = [r[0] for r in scoring.score_texts(df, "text", factory, batch=32).select(scoring.emotion_label()).collect()]
    assert labels == ["1:32"] * 32 + ["2:32"] * 32 + ["3:32"] * 32 + ["4:4"] * 4


def test_theme_scorer_gets_labels(spark):
    df = spark.createDataFrame([("l" * 9 + "f", "x")], "text string, lang string")
    scored = scoring.score_candidates(df, "text", theme_scorer(), THEMES)
    assert scored.select(scoring.theme_labels(threshold=1.0)).first()[0] == "love;faith;forgiveness;fear"


def test_two_stage_labeling(spark):
    df = spark.createDataFrame([("c", 1, "eee l", "old"), ("c", 2, "iii f", "old"), ("c", 3, "ooo", "old")],
                               "corpus string, book_no int, text string, emotion string")
    done = spark.createDataFrame([("c", 3)], "corpus string, book_no int")
    both = labeling.run_labeling(df, vowel_scorer(), theme_scorer(), done=done).collect()
    assert {(r["book_no"], r["emotion"], r["theme"]) for r in both} == {(1, "joy", "love"), (2, "fear", "faith;forgiveness;fear")}
    trial = labeling.run_labeling(df, None, theme_scorer(), only={"book_no": 1}).collect()
    assert [(r["book_no"], r["emotion"], r["theme"]) for r in trial] == [(1, "old", "love")]


def test_back_translation_closes(spark):
    from glossa.functions.labels import back_translate, translate_emotion, translate_themes
    df = spark.createDataFrame([(e,) for e in EMOTIONS], "e string")
    assert df.where(back_translate(translate_emotion(F.col("e")), EMOTIONS_ES) != F.col("e")).count() == 0
    themes = spark.createDataFrame([(";".join(THEMES),)], "t string").select(translate_themes(F.col("t"))).first()[0]
    assert themes == ";".join(THEMES_ES.values())


def test_label_tables_resume(spark):
    folder = scratch_path(spark, "labeled")
    df = spark.createDataFrame([("c", 1, "eee l"), ("c", 2, "iii f"), ("c", 3, "ooo")], "corpus string, book_no int, text string")
    first = labeling.label_tables(df.where("book_no < 3"), folder, vowel_scorer(), None)
    assert [(a["stage"], a["rows"]) for a in first] == [("emotion", 2)]
    second = labeling.label_tables(df, folder, vowel_scorer(), theme_scorer())
    assert [(a["stage"], a["rows"]) for a in second] == [("emotion", 1), ("theme", 3)]
    third = labeling.label_tables(df, folder, vowel_scorer(), theme_scorer())
    assert [(a["stage"], a["rows"]) for a in third] == [("emotion", 0), ("theme", 0)]
    rows = spark.read.parquet(folder + "/emotion_theme").collect()
    assert {(r["book_no"], r["emotion"], r["theme"]) for r in rows} == {
        (1, "joy", "love"), (2, "fear", "faith;forgiveness;fear"), (3, "anger", "")}


def test_lexicon_of_any_size(spark, monkeypatch):
    rng = random.Random(1)
    lexicon = {x: {f"w{rng.randrange(10 ** 6):06d}".translate(str.maketrans("0123456789", "abcdefghij")): rng.choice([0.5, 1.0, 2.0])
                   for _ in range(70_000)} for x in ("en", "fr", "de")}
    known = sorted({w for ws in lexicon.values() for w in ws})
    texts = [" ".join(rng.choice(known).title() for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "zzz 12", "same " * 500 + known[0]]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts + texts[:5])], "id int, text string, preds string")

    def want(text):
        sums = {x: sum(ws.get(w, 0) for w in (text or "").lower().split()) for x, ws in lexicon.items()}
        return {x: v / sum(sums.values()) for x, v in sums.items()} if any(sums.values()) else None

    assert sum(map(len, lexicon.values())) > 200_000
    table = scoring.lexicon_predictions(df, "text", lexicon)
    assert table.columns == ["id", "text", "preds"]
    for r in table.collect():
        got = r["preds"] and {p["label"]: p["score"] for p in r["preds"]}
        assert got == (want(r["text"]) and pytest.approx(want(r["text"])))
    small = {x: dict(list(ws.items())[:300]) for x, ws in lexicon.items()}
    literal = {r["id"]: r["preds"] for r in scoring.lexicon_predictions(df, "text", small).collect()}
    monkeypatch.setattr(scoring, "LITERAL_WORDS", 10)
    joined = {r["id"]: r["preds"] for r in scoring.lexicon_predictions(df, "text", small).collect()}
    assert joined == literal and any(literal.values())


def test_quantiles_by_refinement(spark):
    rng = random.Random(4)
    inf = float("inf")
    columns = {
        "even": [rng.random() for _ in range(4000)], "ties": [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(4000)],
        "skewed": [10.0 ** rng.randint(-300, 300) for _ in range(4000)], "one": [5.0] + [None] * 3999, "none": [None] * 4000,
        "ends": [rng.choice([-inf, inf, 1.7e308, -1.7e308, 5e-324, 0.0, -0.0, 1.0]) for _ in range(4000)],
        "nan": [rng.choice([float("nan"), 3.0, 4.0]) for _ in range(4000)], "whole": [rng.randint(-10 ** 15, 10 ** 15) for _ in range(4000)]}
    types = ", ".join(f"{c} {'bigint' if c == 'whole' else 'double'}" for c in columns)
    df = spark.createDataFrame(list(zip(*columns.values())), types).repartition(4)
    got = aggregates.refined_quantiles(df, list(columns), (0.0, 0.25, 0.5, 0.9, 1.0), bins=16)
    for c, values in columns.items():
        kept = sorted(float(v) for v in values if v is not None and v == v)
        for f in (0.0, 0.25, 0.5, 0.9, 1.0):
            at = f * (len(kept) - 1)
            low, high = (kept[int(at)], kept[min(-int(-at // 1), len(kept) - 1)]) if kept else (None, None)
            want = low if low == high else low + (high - low) * (at - int(at))
            assert got[c, f] == want, (c, f)
    assert aggregates.refined_quantiles(df.where("false"), ["even"], (0.5,)) == {("even", 0.5): None}


def test_quantiles_shuffle_counts_only(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    got = aggregates.refined_quantiles(df, ["v"], (0.5,))
    values = sorted(i * 7919 % 200_003 for i in range(200_000))
    assert got["v", 0.5] == (values[99_999] + values[100_000]) / 2


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 5.0, None), (1.0, 5.0, None), (0.5, None, None), (0.05, 5.0, None)], "a double, b double, c double")
    got = {(r["model"], r["bin"]): (r["n"], r["low"], r["high"]) for r in aggregates.score_histogram(df, ["a", "b", "c"]).collect()}
    assert got == {("a", 1): (1, 0.0, 1.0), ("a", 2): (1, 0.0, 1.0), ("a", 11): (1, 0.0, 1.0), ("a", 20): (1, 0.0, 1.0), ("b", 1): (3, 5.0, 5.0)}
    assert aggregates.score_histogram(df.where("false"), ["a"]).count() == 0


def test_table_lexicon_shuffles_words_once(spark, capsys):
    """words are counted where they are read and shuffled only to meet the lexicon."""
    from glossa.operators.scoring import lexicon_table_predictions
    docs = spark.createDataFrame([(1, "Good good, bad x"), (2, None), (3, " 1 good"), (4, "x")], "id int, text string")
    lexicon = spark.createDataFrame([("p", "good", 1.0), ("n", "bad", 3.0), ("p", "good", 2.0)], "label string, word string, weight double")
    found = lexicon_table_predictions(docs, "text", lexicon, ["p", "n"], key=["id"])
    found.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(word" in plan and "hashpartitioning(id" in plan
    assert not any("hashpartitioning(id" in line and "word" in line for line in plan.splitlines())
    got = {r["id"]: r["preds"] and [p["score"] for p in r["preds"]] for r in found.collect()}
    assert got == {1: [6 / 9, 3 / 9], 2: None, 3: [1.0, 0.0], 4: None}
