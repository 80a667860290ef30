"""Structured Streaming: validate and score records, append events to daily partitions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.contracts import validate_records
from plumbline.sources.prediction_log import DAY


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_score(
    stream: DataFrame, record: str, enums: Mapping[str, Sequence[str]], ranges: Mapping[str, tuple[int, int]],
    score: Callable[[DataFrame], DataFrame], to_events: Callable[[DataFrame], DataFrame], log_path: str, quarantine_path: str, checkpoint: str,
) -> StreamingQuery:
    """Validate -> score -> event log; invalid records go to the quarantine.

    A micro-batch writes below its own batch folder, replacing what a failed
    attempt left there, so a retry repeats nothing. Row counts are observed as
    ``read`` and ``rejected``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        # read and validated once for both writes
        checked = validate_records(batch, record, enums, ranges).persist()
        try:
            bad = checked.where("NOT is_valid").select(record, F.array_join("errors", "; ").alias("errors"))
            bad.write.mode("overwrite").json(f"{quarantine_path}/batch={batch_id}")
            good = to_events(score(checked.where("is_valid").drop("errors", "is_valid")))
            good.write.mode("overwrite").partitionBy(DAY).json(f"{log_path}/batch={batch_id}")
        finally:
            checked.unpersist()

    observed = stream.observe("records", F.count(F.lit(1)).alias("read"))
    return observed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_log_sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append an event stream to daily JSON partitions, exactly once through the sink's commit log."""
    return (
        events.observe("log", F.count(F.lit(1)).alias("written"))
        .writeStream.format("json").partitionBy(DAY).option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


OUTCOMES = ("written", "late", "malformed", "other_version")


def outcome(event: Column, version: str, since: str) -> Column:
    """What becomes of a logged event (a parsed struct): malformed without probability or time, else of another version, else late before `since`."""
    broken = event.isNull() | event["probability"].isNull() | event["timestamp"].isNull()
    return (
        F.when(broken, "malformed").when(~event["model_version"].eqNullSafe(F.lit(version)), "other_version")
        .when(event["timestamp"].cast("timestamp") < F.lit(since).cast("timestamp"), "late").otherwise("written")
    )


def stream_counted_log(lines: DataFrame, event_schema: str, version: str, since: str, path: str, checkpoint: str, line: str = "value") -> StreamingQuery:
    """Parse JSON lines, log the good events and count all outcomes.

    A batch is parsed once and cached for its two writes: events below
    ``log/batch=id`` and a row per outcome below ``counts/batch=id``. A retry
    replaces its batch, so the counts are exact over any number of batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        event = F.from_json(F.col(line), event_schema)
        parsed = batch.select(event.alias("event")).withColumn("outcome", outcome(F.col("event"), version, since)).persist()
        try:
            parsed.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
            parsed.where("outcome = 'written'").select("event.*").write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")
        finally:
            parsed.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counters(spark: SparkSession, path: str) -> DataFrame:
    """(counter, n) over all batches of a counted log; outcomes that never came have 0."""
    every = spark.createDataFrame([(o,) for o in OUTCOMES], "counter string")
    seen = spark.read.schema("outcome string, n bigint").parquet(f"{path}/counts/batch=*").groupBy("outcome").agg(F.sum("n").alias("n"))
    return every.join(seen, F.col("counter") == F.col("outcome"), "left").select("counter", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def dropped_rows(progress: Sequence) -> int:
    """Rows behind the watermark in the given progress reports (a finished query keeps its last 100 only)."""
    return sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)
