"""File sources and sinks, audits and streams on small files."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glossa import schemas
from glossa.catalog.scoring import vowel_scorer
from glossa.operators import sets
from glossa.operators.filters import valid_row
from glossa.plans.labeling import label_emotions
from glossa.session import ensure_checkpoint_dir, scratch_path
from glossa.sources import tables
from glossa.streaming import jobs, sessions


@pytest.fixture()
def folder(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        return path

    write.root = str(tmp_path)
    return write


HEAD = "book,chapter,verse,subtitle,text,source_url\n"


def test_read_csv_quotes_newlines_and_missing(spark, folder):
    folder("1_a.csv", HEAD + 'a,1,1,,"line one\nline ""two"", end",u\na,1,2,"",plain,\n')
    rows = tables.read_csv(spark, folder.root, schemas.RAW, origin=True).orderBy("verse").collect()
    assert [(r["text"], r["subtitle"], r["source_url"]) for r in rows] == [
        ('line one\nline "two", end', None, "u"), ("plain", None, None)]
    assert (rows[0]["file"], rows[0]["book_no"], rows[0]["slug"]) == ("1_a.csv", 1, "a")


def test_recursive_and_headerless(spark, folder):
    folder("x/1_a.csv", HEAD + "a,1,1,,t,u\n")
    folder("y/z/2_b.csv", HEAD + "b,1,1,,t,u\n")
    folder("y/notes.txt", "no\n")
    assert tables.read_csv(spark, folder.root, schemas.RAW, recursive=True).count() == 2
    folder("ann/labels.csv", "1,v1,love\n2,v2,\n")
    got = tables.read_csv(spark, folder.root + "/ann", schemas.ANNOTATION, header=False).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", "v1", "love"), ("2", "v2", None)]


def test_load_corpus(spark, folder):
    head = ",".join(schemas.LABELED.names) + "\n"
    folder("es/emotion_theme/1_genesis_emotion_theme.csv", head + "1,genesis,1,1,,t,genesis_1_1,u,fe;amor,Ira\n")
    folder("es/emotion_theme/merged.csv", head + "1,genesis,1,1,,t,genesis_1_1,u,fe,Ira\n")
    got = tables.load_corpus(spark, folder.root + "/es/emotion_theme").collect()
    assert [(r["source_file"], r["theme"]) for r in got] == [("1_genesis_emotion_theme", "fe;amor")]
    empty = tables.load_corpus(spark, folder.root + "/nowhere")
    assert empty.count() == 0 and "source_file" in empty.columns
    assert tables.corpus_folder("b", "fr") == tables.corpus_folder("b", "es") != tables.corpus_folder("b", "en")


def test_checked_read_sets_bad_files_aside(spark, folder):
    folder("a.csv", HEAD + "a,1,1,s,t,u\na,0,1,s,t,u\n")
    folder("b.csv", "﻿\"text\",\"verse\",\"book\",\"chapter\"\r\nhello,2,b,3\r\n")
    folder("c.csv", "book,chapter,text\nc,1,t\n")
    folder("d.csv", HEAD + "d,x,1,s,t,u\n")
    folder("e.csv", "")
    checked = tables.read_checked(spark, folder.root)
    rows = sorted((r["book"], r["chapter"], r["verse"], r["text"], r["subtitle"]) for r in checked.rows.collect())
    assert [x for x in rows if x[0] != "a"] == [("b", "3", "2", "hello", None), ("d", "x", "1", "t", "s")]
    audit = tables.audit_files(checked, valid_row(F.col("book"), F.col("chapter"), F.col("verse")))
    got = {r["file"].rsplit("/", 1)[1]: (r["missing"], r["rows"], r["kept"], r["removed"], r["processed"]) for r in audit.collect()}
    assert got == {"a.csv": ("", 2, 1, 1, True), "b.csv": ("", 1, 1, 0, True), "c.csv": ("verse", 0, 0, 0, False),
                   "d.csv": ("", 1, 0, 1, False), "e.csv": ("book,chapter,text,verse", 0, 0, 0, False)}
    folder("f/f.csv", HEAD + "f,1,1,s,t\nf,1,2,s,t,u,extra\nf,1,3,s,t,u\n")
    odd = tables.read_checked(spark, folder.root + "/f")
    assert sorted(r["verse"] for r in odd.malformed.collect()) == ["1", "2"]
    assert {r["verse"]: r["source_url"] for r in odd.rows.collect()} == {"1": None, "2": "u", "3": "u"}
    total = tables.session_summary(audit).first()
    assert (total["processed"], total["failed"], total["rows"], total["kept"]) == (2, 3, 4, 2)


def test_written_csv_is_fully_quoted(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x"', None, ["a", "b"]), (2, "two\nlines", "", [])],
                               "id int, t string, n string, l array<string>").coalesce(1)
    path = str(tmp_path / "out")
    tables.write_csv(df, path)
    text = next((tmp_path / "out").glob("part-*.csv")).read_bytes().decode()
    assert text == '"id","t","n","l"\n"1","say ""x""","","a;b"\n"2","two\nlines","",""\n'


def test_merge_corpus_in_file_order(spark, folder):
    head = "id,book,chapter,verse,verse_id,text,theme,emotion\n"
    folder("2_exodus_cleaned.csv", head + "1,Exodus,1,1,Exodus_1_1,c,,\n")
    folder("10_late_cleaned.csv", head + "1,Late,1,1,Late_1_1,d,,\n")
    folder("1_genesis_cleaned.csv", head + "1,Genesis,1,1,Genesis_1_1,a,,\n2,Genesis,1,2,Genesis_1_2,b,,\n")
    folder("3_empty_cleaned.csv", head)
    folder("odd_cleaned.csv", head + "9,Odd,1,1,Odd_1_1,e,,\n")
    schema = "id int, book string, chapter int, verse int, verse_id string, text string, theme string, emotion string"
    from pyspark.sql.types import _parse_datatype_string
    df = tables.read_csv(spark, folder.root, _parse_datatype_string(schema), pattern="*_cleaned.csv", origin=True)
    merged = sets.merge_corpus(df, [F.col("book_no").asc_nulls_last(), F.col("file"), F.col("chapter"), F.col("verse")])
    assert merged.columns[0] == "id"
    assert [(r["id"], r["verse_id"]) for r in merged.orderBy("id").collect()] == [
        (1, "Genesis_1_1"), (2, "Genesis_1_2"), (3, "Exodus_1_1"), (4, "Late_1_1"), (5, "Odd_1_1")]


def test_write_books_reports_missing(spark, tmp_path):
    df = spark.createDataFrame([("genesis", "1", "t"), ("jude", "1", "u")], "book string, chapter string, text string")
    missing = tables.write_books(df, str(tmp_path / "books"))
    assert missing.count() == 64 and missing.first()["book"] == "exodus"
    assert (tmp_path / "books" / "book_no=65" / "book=jude").is_dir()


def test_feedback_columns_grow(spark, tmp_path):
    path = str(tmp_path / "feedback")
    first = spark.createDataFrame([("ana", "like", ["v1"])], "usuario string, feedback string, verses array<string>")
    second = spark.createDataFrame([("bo", "dislike", ["v1", "v2"])], "usuario string, feedback string, verses array<string>")
    tables.append_feedback(tables.feedback_rows(first), path)
    tables.append_feedback(tables.feedback_rows(second), path)
    got = {r["usuario"]: (r["versiculo_1"], r["versiculo_2"]) for r in tables.read_feedback(spark, path).collect()}
    assert got == {"ana": ("v1", ""), "bo": ("v1", "v2")}


def test_new_units(spark):
    df = spark.createDataFrame([("c", 1), ("c", 2), ("c", 2)], "corpus string, book_no int")
    done = spark.createDataFrame([("c", 1)], "corpus string, book_no int")
    assert [r["book_no"] for r in tables.new_units(df, done, ["corpus", "book_no"]).collect()] == [2, 2]
    assert tables.new_units(df, None, ["corpus"]).count() == 3


def test_label_arrivals_only_once(spark, folder, tmp_path):
    folder("in/1.csv", HEAD + "a,1,1,,eee,u\n")
    out, state = scratch_path(spark, "labeled"), scratch_path(spark, "state")
    source = jobs.stream_files(spark, folder.root + "/in", schemas.RAW, "csv", header="true")
    label = lambda df: label_emotions(df.select("book", "text"), vowel_scorer()).select("book", "text", "emotion")
    for expected in (1, 1):
        jobs.run_to_end(jobs.label_arrivals(source, label, out, state))
        assert spark.read.parquet(out).count() == expected
    folder("in/2.csv", HEAD + "b,1,1,,iii,u\n")
    jobs.run_to_end(jobs.label_arrivals(source, label, out, state))
    assert {(r["book"], r["emotion"]) for r in spark.read.parquet(out).collect()} == {("a", "joy"), ("b", "fear")}


def test_checkpoint_dir_is_taken_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert ensure_checkpoint_dir(spark) and (configured is None or ensure_checkpoint_dir(spark) == configured)
    assert scratch_path(spark, "x").startswith(ensure_checkpoint_dir(spark))


def test_checked_read_takes_any_number_of_headers(spark, tmp_path):
    for i in range(230):
        names = ["book", f"x{i}", "chapter", "verse", "text"]
        values = ["B", "z", "1", str(i), f"t{i}"]
        turn = i % 5
        (tmp_path / f"f{i}.csv").write_text(",".join(names[turn:] + names[:turn]) + "\n" + ",".join(values[turn:] + values[:turn]) + "\n")
    got = tables.read_checked(spark, str(tmp_path)).rows
    assert {(r["book"], r["chapter"], int(r["verse"]), r["text"]) for r in got.collect()} == {("B", "1", i, f"t{i}") for i in range(230)}


def test_feedback_sessions_expire(spark, tmp_path):
    days = [[("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:20:00")], [("b", "2024-01-05 10:00:00")],
            [("b", "2024-01-05 10:30:00")], [("b", "2024-01-05 10:40:00"), ("a", "2024-01-05 11:00:00")]]
    for i, rows in enumerate(days):  # files arrive in this order, one per batch
        frame = spark.createDataFrame([(s, t, f"{s}{i}") for s, t in rows], "session_id string, ts string, feedback string")
        frame.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=1)
    jobs.run_to_end(jobs.write_stream(jobs.unique_feedback(stream, delay="1 hour"), str(tmp_path / "out"), str(tmp_path / "check")))
    got = sorted(r["feedback"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["a0", "a3", "b1"]


def test_keyed_sessions_end_by_their_timer(spark, tmp_path):
    days = [[("a", "01 10:00"), ("a", "01 10:50"), ("b", "01 11:00"), (None, "01 11:00"), ("c", None)],
            [("a", "01 10:20"), ("b", "01 12:30"), ("a", "01 12:00")],                   # a1 comes late, b1 and a2 begin anew
            [("a", "03 09:00"), ("b", "01 11:20")],                                     # ends the first day's sessions; b1 lies behind
            [("b", "01 12:40"), ("a", "03 09:10"), ("a", "05 00:00")],                  # in the batch that ends its session
            [("b", "01 12:50"), ("a", "05 00:10")]]                                     # b lies behind the watermark and is dropped
    for i, rows in enumerate(days):
        frame = spark.createDataFrame([(s, t and f"2024-01-{t}:00", f"{s}{i}{n}") for n, (s, t) in enumerate(rows)],
                                      "session_id string, ts string, event_id string")
        frame.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=1)
    with sessions.timed_state(spark):
        found = sessions.feedback_sessions(stream, 3600, "2 hours")
        jobs.run_to_end(jobs.write_stream(found, str(tmp_path / "out"), str(tmp_path / "check")))
    got = {r["event_id"]: (r["session_id"], f"{r['end']:%d %H:%M}", r["feedbacks"], r["repeated"], r["late"])
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a00": ("a", "01 10:50", 3, 2, 1), "b02": ("b", "01 11:20", 2, 1, 0), "b11": ("b", "01 12:40", 2, 1, 0),
                   "a12": ("a", "01 12:00", 1, 0, 0), "a20": ("a", "03 09:10", 2, 1, 0)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


@pytest.mark.parametrize("more", [{}, {"buckets": 1}])
def test_sessions_that_end_at_the_watermark(spark, tmp_path, more):
    days = [[("a", "10:00"), ("b", "12:00"), ("a", "14:30"), ("c", "12:01")], [("z", "15:00")]]  # the watermark gets to 13:00
    for i, rows in enumerate(days):
        frame = spark.createDataFrame([(s, f"2024-01-01 {t}:00", f"{s}{t}") for s, t in rows], "session_id string, ts string, event_id string")
        frame.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    with sessions.timed_state(spark):
        jobs.run_to_end(jobs.write_stream(sessions.feedback_sessions(stream, 3600, "2 hours", **more), str(tmp_path / "out"), str(tmp_path / "check")))
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a10:00", "b12:00"]


def test_sessions_share_state_calls():
    """A batch costs the state store a read, a write and a timer, however many keys and sessions a bucket has."""
    calls, timers = [], set()

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        def getValueState(self, name, schema):
            return value

        def registerTimer(self, at):
            calls.append("timer")
            timers.add(at)

        def deleteTimer(self, at):
            timers.remove(at)

    class Times:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

        getExpiryTimeInMs = getCurrentWatermarkInMs

    value = Value()
    state = sessions._Sessions(1_000, StringType())
    state.init(Handle())
    rows = [Row(session_id=f"k{i % 7}", us=i // 7 * 5_000, event=f"e{i}") for i in range(350)]
    assert not list(state.handleInputRows((0,), iter(rows), Times(0)))
    assert calls == ["update", "timer"] and timers == {1}
    done = list(state.handleExpiredTimer((0,), Times(200), Times(1)))
    assert len(done) == 280 and timers == {1, 201}  # the timer that fired is Spark's to delete
    assert len(list(state.handleExpiredTimer((0,), Times(10_000), Times(201)))) == 70 and value.held is None
