"""Prediction logs: JSON lines in daily partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.contracts import finite_score_gate
from plumbline.operators.drift import MAX_MALFORMED

DAY = "event_date"


def prediction_events(
    scored: DataFrame, features: list[str], model_version: str, threshold: float, time: str = "ts",
    request_id: Column | None = None,
) -> DataFrame:
    """One event per scored row: timestamp, version, nested features, probability, label and confidence."""
    checked = finite_score_gate(scored)
    hit = F.col("score") >= F.lit(threshold)
    return checked.select(
        F.date_format(F.col(time).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"),
        (request_id if request_id is not None else F.col("row_id").cast("string")).alias("request_id"),
        F.lit(model_version).alias("model_version"),
        F.struct(*features).alias("features"),
        F.col("score").alias("probability"),
        F.when(hit, "Yes").otherwise("No").alias("prediction"),
        F.when(hit, F.col("score")).otherwise(1 - F.col("score")).alias("confidence"),
        F.lit(threshold).alias("decision_threshold"),
        F.to_date(F.col(time)).alias(DAY),
    )


def append_predictions(events: DataFrame, path: str) -> None:
    """Append events to daily partitions of JSON lines."""
    events.write.mode("append").partitionBy(DAY).json(path)


def log_lines(spark: SparkSession, path: str, since: str | None = None, pattern: str | None = None) -> DataFrame:
    """Raw lines of the log; with ``since`` (a UTC timestamp) whole earlier days are never read."""
    reader = spark.read.format("text").option("basePath", path)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.load(path)
    if since is not None and DAY in lines.columns:
        lines = lines.where(F.col(DAY) >= F.to_date(F.lit(since)))
    return lines


def event_schema(features: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("timestamp", T.StringType()), T.StructField("request_id", T.StringType()),
        T.StructField("model_version", T.StringType()), T.StructField("features", features),
        T.StructField("probability", T.StringType()), T.StructField("prediction", T.StringType()),
    ])


def parse_log(lines: DataFrame, features: T.StructType) -> DataFrame:
    """Typed events with ``malformed``: no JSON, no features, or a bad timestamp or probability. Blank lines go."""
    parsed = lines.where(F.trim("value") != "").withColumn("__e", F.from_json("value", event_schema(features)))
    flat = parsed.select(
        F.try_to_timestamp(F.col("__e.timestamp")).alias("ts"), F.col("__e.request_id").alias("request_id"),
        F.col("__e.model_version").alias("model_version"), F.col("__e.features").alias("features"),
        F.col("__e.probability").try_cast("double").alias("probability"), F.col("__e.prediction").alias("prediction"),
    )
    bad = F.col("ts").isNull() | F.col("features").isNull() | F.col("probability").isNull()
    return flat.withColumn("malformed", bad)


def _conditions(since: str | None, model_version: str | None, group: tuple[str, str] | None) -> tuple[Column, Column, Column]:
    in_window = F.lit(True) if since is None else F.col("ts") >= F.lit(since).cast("timestamp")
    same_version = F.lit(True) if model_version is None else F.coalesce(F.col("model_version") == model_version, F.lit(False))
    in_group = F.lit(True) if group is None else F.coalesce(F.col("features")[group[0]] == group[1], F.lit(False))
    return in_window, same_version, in_group


def scan_statistics(parsed: DataFrame, since: str | None = None, model_version: str | None = None, group: tuple[str, str] | None = None) -> DataFrame:
    """Lines read, malformed, other versions inside the window, and rows that pass, in filter order."""
    window, version, member = _conditions(since, model_version, group)
    ok = ~F.col("malformed")
    return parsed.agg(
        F.count(F.lit(1)).alias("lines_read"), F.count_if("malformed").alias("malformed"),
        F.count_if(ok & window & ~version).alias("other_model_versions"),
        F.count_if(ok & window & version & member).alias("n_events"),
    )


def scan_log(
    parsed: DataFrame, since: str | None = None, model_version: str | None = None, group: tuple[str, str] | None = None,
    max_malformed: float = MAX_MALFORMED,
) -> DataFrame:
    """Well-formed events of the window, version and group; fails when too many lines are malformed."""
    window, version, member = _conditions(since, model_version, group)
    stats = scan_statistics(parsed, since, model_version, group)
    broken = F.col("malformed") > F.lit(max_malformed) * F.col("lines_read")
    message = F.concat(F.col("malformed").cast("string"), F.lit("/"), F.col("lines_read").cast("string"), F.lit(" log lines are malformed"))
    gate = stats.select(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)).alias("ok")).scalar()
    return parsed.where(~F.col("malformed") & window & version & member).where(gate).drop("malformed")
