"""Arrival-driven jobs (T01-T03): label new files, take feedback, answer requests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from glossa.operators.recommend import PER_SECTION, StoredIndex, admitted, answer_from_store


def stream_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                 files_per_trigger: int | None = 1_000, **options) -> DataFrame:
    """New files of a folder as a stream; the checkpoint remembers the ones already read."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Exactly-once Parquet sink that processes what has arrived and stops."""
    writer = (df.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start()


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def label_arrivals(source: DataFrame, label: Callable[[DataFrame], DataFrame], path: str,
                   checkpoint: str) -> StreamingQuery:
    """Apply the labelling steps to files that have not been labelled yet."""
    return write_stream(label(source), path, checkpoint)


def unique_feedback(events: DataFrame, session: str = "session_id", time: str = "ts",
                    delay: str = "1 hour") -> DataFrame:
    """At most one feedback per session within ``delay``; the watermark bounds the remembered sessions."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([session])


def answer_arrivals(requests: DataFrame, index: StoredIndex, payload: Sequence[str], key: Sequence[str], path: str,
                    checkpoint: str, n: int = PER_SECTION, seed=0) -> StreamingQuery:
    """Recommendations for arriving requests, one folder ``batch=<id>`` per micro-batch.

    ``index`` is the result of ``store_index``; a micro-batch reads the corpus buckets that its picks fall into. A repeated
    batch overwrites its own folder, so every request is answered exactly once.
    """
    def answer(batch: DataFrame, batch_id: int) -> None:
        answers = answer_from_store(admitted(batch), index, payload, key, n, seed)
        answers.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
