"""Streaming queries (T01-T03): the tables arrive as files, results are read back from the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.catalog.joins import PICKS_SQL, requests
from glossa.catalog.registry import Tables, query
from glossa.catalog.roles import LABELED_SQL, LEXICON, corpus
from glossa.functions.scores import top_prediction
from glossa.functions.text import clean_text
from glossa.operators import recommend
from glossa.operators.scoring import lexicon_predictions
from glossa.session import scratch_path
from glossa.streaming import jobs, sessions


class _Arrivals(Tables):
    """The same tables as streams."""

    def __getattr__(self, name):
        path = f"{self.folder}/{name}.parquet"
        # as a glob the path may be one file or a folder of files
        return jobs.stream_files(self.spark, path + "*", self.spark.read.parquet(path).schema)


def _run(stream, spark, name):
    path = scratch_path(spark, name)
    jobs.run_to_end(jobs.write_stream(stream, path, path + "-checkpoint"))
    return spark.read.schema(stream.schema).parquet(path)


def _label(docs):
    cleaned = docs.withColumn("text", clean_text(F.col("text")))
    best = top_prediction(F.col("preds"))
    return lexicon_predictions(cleaned, "text", LEXICON).select("doc_id", "lang", best["label"].alias("pred"))


@query("t01_label_arrivals", f"WITH {LABELED_SQL} SELECT doc_id, lang, pred FROM labeled")
def t01(spark, sf_dir):
    path = scratch_path(spark, "labeled")
    source = _Arrivals(spark, sf_dir).documents
    jobs.run_to_end(jobs.label_arrivals(source, _label, path, path + "-checkpoint"))
    return spark.read.parquet(path)


@query("t02_unique_feedback", "SELECT DISTINCT user_id, event_type FROM events")
def t02(spark, sf_dir):
    events = _Arrivals(spark, sf_dir).events.withColumn("session_id", F.concat_ws("-", "user_id", "event_type"))
    # one session stays open for the whole table here, so the watermark spans it
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    unique = jobs.unique_feedback(events, delay="3650 days")
    return _run(unique.select("user_id", "event_type"), spark, "feedback")


_GAP, _DELAY = 2 * 86_400, 86_400  # seconds


@query("t02_feedback_sessions", f"""WITH e AS (SELECT user_id || '-' || event_type AS session_id, event_id::VARCHAR AS event_id, epoch_us(ts) AS us FROM events),
  l AS (SELECT *, us - lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS since FROM e),
  s AS (SELECT *, count(*) FILTER (since IS NULL OR since > {_GAP}000000) OVER (PARTITION BY session_id ORDER BY us, event_id) AS nth FROM l),
  done AS (SELECT session_id, arg_min(event_id, (us, event_id)) AS event_id, min(us) AS start_us, max(us) AS end_us, count(*) AS feedbacks,
    count(*) - 1 AS repeated FROM s GROUP BY session_id, nth)
SELECT * FROM done WHERE ceil((end_us + {_GAP}000000) / 1000) <= (SELECT floor(max(us) / 1000) FROM e) - {_DELAY}000""")
def t02_sessions(spark, sf_dir):
    events = _Arrivals(spark, sf_dir).events.withColumn("session_id", F.concat_ws("-", "user_id", "event_type"))
    found = sessions.feedback_sessions(events.withColumn("ts", F.col("ts").cast("timestamp")), _GAP, f"{_DELAY} seconds")
    with sessions.timed_state(spark):
        done = _run(found, spark, "sessions")
    return done.select("session_id", "event_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"),
                       "feedbacks", "repeated")


@query("t03_answer_stream", f"WITH {PICKS_SQL} SELECT request_id, lang, section, pick, verse_id FROM answers")
def t03(spark, sf_dir):
    rows = corpus(Tables(spark, sf_dir)).select("verse_id", "lang", "book", "emotion", "theme")
    index = recommend.store_index(rows, ["verse_id"], scratch_path(spark, "index"))
    path = scratch_path(spark, "answers")
    arriving = requests(_Arrivals(spark, sf_dir))
    jobs.run_to_end(jobs.answer_arrivals(arriving, index, ["verse_id"], ["verse_id"], path, path + "-checkpoint"))
    return spark.read.parquet(path).drop("batch")


@query("flagship_label_report", f"""WITH {LABELED_SQL}, c AS (SELECT lang AS label, count(*) AS support,
    count(*) FILTER (WHERE lang = pred) AS tp FROM labeled GROUP BY 1),
p AS (SELECT pred AS label, count(*) AS predicted FROM labeled WHERE pred IS NOT NULL GROUP BY 1),
r AS (SELECT label, tp / predicted AS precision, tp / support AS recall, 2 * tp / (predicted + support) AS f1, support, tp FROM c JOIN p USING (label)),
long AS (SELECT label, precision, recall, f1, support FROM r
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM r
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM r)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM long""")
def flagship_report(spark, sf_dir):
    from glossa.catalog.flagship import flagship
    report = flagship(spark, sf_dir)
    return report.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")
