"""The drift check as one job: log -> scan -> window -> report with counters, status and code."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import drift
from plumbline.operators.contracts import ContractError, fingerprint
from plumbline.roles import require
from plumbline.sources.prediction_log import parse_log, scan_log, scan_statistics


@dataclass(frozen=True)
class Reference:
    """A profile and what it was built from."""

    profile: DataFrame
    rates: DataFrame
    model_version: str
    data: tuple[int, str]
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    score: str
    group: str | None


def build_reference(
    df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], score: str, positive: Column, model_version: str,
    group: str | None = None, expected: tuple[int, str] | None = None,
) -> Reference:
    """Profile, rates and identity of reference rows; other data than the `expected` fingerprint are refused."""
    columns = [*dict.fromkeys([*categorical, *numeric, score, *([group] if group else [])])]
    data = tuple(fingerprint(df, columns).first())
    if expected is not None and data != tuple(expected):
        raise ContractError(f"reference data {data} are not the expected {tuple(expected)}")
    profile = drift.build_profile(df, categorical, numeric, score, group)
    return Reference(profile, drift.segment_rates(df, positive, group), model_version, data, tuple(categorical), tuple(numeric), score, group)


def drift_check(
    lines: DataFrame, features, reference: Reference, since: str | None = None, n: int | None = None, any_version: bool = False,
    segment: str = drift.POOLED, min_samples: int = drift.MIN_SAMPLES,
) -> tuple[DataFrame, DataFrame]:
    """(report of one row, feature drift) of a prediction log's lines for one segment of the reference.

    Events of other model versions than the reference's are counted and left out,
    unless `any_version`. The window is a time (`since`) or the last `n` events.
    """
    require(since is None or n is None, "a window is a time or a number of events")
    profile = drift.require_segment(reference.profile, segment)
    version = None if any_version else reference.model_version
    member = None if segment == drift.POOLED else (reference.group, segment)
    parsed = parse_log(lines, features)
    events = scan_log(parsed, since, version, member)
    if n is not None:
        events = drift.last_n(events, n, "ts", "request_id")
    flat = events.select("ts", "prediction", F.col("probability").alias(reference.score), "features.*")
    found = drift.feature_drift(profile, flat, reference.categorical, reference.numeric, reference.score, reference.group).where(F.col("segment") == segment)
    recent = drift.segment_rates(flat, F.col("prediction") == "Yes", reference.group).where(F.col("segment") == segment)
    none = reference.rates.where(F.col("segment") == segment).select("segment", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("positive_rate"))
    recent = recent.unionByName(none.join(recent, "segment", "left_anti"))
    verdict = drift.drift_verdict(found, reference.rates, recent, min_samples)
    counters = scan_statistics(parsed, since, version, member).drop("n_events")
    with_counters = verdict.withColumn("__c", counters.agg(F.first(F.struct(*counters.columns))).scalar())
    return with_counters.select(F.lit(reference.model_version).alias("model_version"), *verdict.columns, "__c.*"), found
