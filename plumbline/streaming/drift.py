"""Population stability per event-time window, as a stream and as its batch twin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import drift as R

WINDOW = ["window_start", "window_end"]
NO_REFERENCE = -1


def binned_rows(profile: DataFrame, df: DataFrame, time: str, categorical: Sequence[str], numeric: Sequence[str], score: str | None, group: str | None) -> DataFrame:
    """One row per (event, segment, feature) with its profile bin; works on streams and tables.

    Segments and features that the profile lacks keep their rows, in bin NO_REFERENCE.
    """
    keys = ["segment", "feature"]
    spread = R.spread_segments(df, group)
    named = spread.withColumn(R.SCORE_FEATURE, F.col(score)) if score else spread
    entries = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("level"))
        for c in [*numeric, *([R.SCORE_FEATURE] if score else [])]
    ] + [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("value"), F.col(c).cast("string").alias("level")) for c in categorical]
    long = named.select(time, "segment", F.inline(F.array(*entries)))
    # one row per (segment, feature): edges of a numeric feature, or level -> bin of a categorical one
    specs = profile.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "numeric", F.col("hi")))).alias("edges"),
        F.map_from_entries(F.collect_list(F.when((F.col("kind") == "categorical") & (F.col("label") != R.UNSEEN), F.struct("label", "bin")))).alias("bins"),
        F.max("bin").alias("last"), F.first("kind").alias("kind"),
    )
    joined = long.join(specs, keys, "left")
    bin_no = F.when(F.col("kind").isNull(), NO_REFERENCE).when(F.col("kind") == "numeric", R.bin_index(F.col("value"), F.col("edges"))).otherwise(
        F.coalesce(F.try_element_at("bins", F.col("level")), F.col("last"))
    )
    # inside a group's segment the group itself is constant and no feature
    own = (F.col("feature") == F.lit(group)) & (F.col("segment") != R.POOLED) if group else F.lit(False)
    usable = F.coalesce(F.col("kind") == "categorical", F.col("level").isNotNull()) | F.col("value").isNotNull()
    return joined.where(usable & ~own).select(time, *keys, bin_no.cast("int").alias("bin"))


def window_counts(profile: DataFrame, df: DataFrame, time: str, window: str, categorical, numeric, score=None, group=None) -> DataFrame:
    """Rows per window, segment, feature and bin."""
    rows = binned_rows(profile, df, time, categorical, numeric, score, group)
    counted = rows.groupBy(F.window(time, window).alias("w"), "segment", "feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "segment", "feature", "bin", "n")


def stream_counts(
    profile: DataFrame, stream: DataFrame, time: str, window: str, late: str, categorical, numeric, path: str, checkpoint: str, score=None, group=None
) -> StreamingQuery:
    """Append the counts of closed windows to Parquet; rows later than ``late`` are dropped by the watermark."""
    counts = window_counts(profile, stream.withWatermark(time, late), time, window, categorical, numeric, score, group)
    return (
        counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def window_drift(profile: DataFrame, counts: DataFrame) -> DataFrame:
    """PSI, status and largest shift per window, segment and feature; without PSI and with status ``no_reference`` where the profile has none."""
    known = R.drift_from_counts(profile, counts.where(F.col("bin") != NO_REFERENCE), extra=WINDOW)
    unknown = counts.where(F.col("bin") == NO_REFERENCE).select(*WINDOW, "segment", "feature").distinct()
    return known.unionByName(unknown.withColumn("status", F.lit("no_reference")), allowMissingColumns=True)
