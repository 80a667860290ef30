"""Population stability: reference profiles, PSI per feature and verdicts.

A profile is a long table ``segment, feature, kind, bin, lo, hi, label,
ref_share``: segments x features x bins rows, whatever the size of the data.
Numeric bins are right-closed between observed deciles, open at both ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import exact_quantiles, first_n
from plumbline.functions.scalars import unpivot_number, unpivot_text
from plumbline.functions.session import cut
from plumbline.operators.contracts import ContractError

# Fixed values of the method.
STABLE_BELOW = 0.10
SIGNIFICANT_ABOVE = 0.25
SHARE_FLOOR = 1e-4
UNSEEN = "(unseen)"
POOLED = "all"
SCORE_FEATURE = "prediction_score"
MIN_SAMPLES = 500
MAX_MALFORMED = 0.01
STATUS_CODES = {"stable": 0, "moderate": 10, "significant": 20, "insufficient_data": 30, "no_reference": 40}

DECILES = {f"d{i}": i / 10 for i in range(1, 10)}


def decile_edges(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, edges``: deduplicated inverted-CDF deciles; every edge is an observed value."""
    found = exact_quantiles(df, column, DECILES, by=by, method="inverted_cdf")
    return found.select(*by, F.array_distinct(F.array(*DECILES)).alias("edges"))


def bin_index(value: Column, edges: Column) -> Column:
    """0-based bin among ``(-inf, e1], (e1, e2], ..., (ek, inf)``."""
    return F.size(F.filter(edges, lambda edge: edge < value))


def _trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def general_format(x: Column) -> Column:
    """Six significant digits without trailing zeros, scientific from one million on."""
    size = F.floor(F.log10(F.abs(x)) + 1e-12).cast("int")
    scale = F.pow(F.lit(10.0), F.lit(5) - size)
    plain = _trim(((F.round(x * scale) / scale).cast("decimal(30,6)")).cast("string"))
    mantissa = _trim(F.format_string("%.5f", x / F.pow(F.lit(10.0), size)))
    science = F.concat(mantissa, F.lit("e+"), F.lpad(size.cast("string"), 2, "0"))
    return F.when(F.abs(x) >= 1e6, science).otherwise(plain)


def edge_text(x: Column) -> Column:
    return F.when(F.abs(x) >= 1, general_format(x)).otherwise(F.format_string("%.3f", x))


def bin_label(lo: Column, hi: Column) -> Column:
    """``(lo, hi]`` with ``-inf`` and ``inf`` for open ends."""
    low = F.when(lo.isNull(), F.lit("-inf")).otherwise(edge_text(lo))
    high = F.when(hi.isNull(), F.lit("inf")).otherwise(edge_text(hi))
    return F.concat(F.lit("("), low, F.lit(", "), high, F.lit("]"))


def _numeric_grid(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every bin of every edge list, empty ones included."""
    grid = edges.select(*by, "edges", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    lo = F.when(F.col("bin") > 0, F.get("edges", F.col("bin") - 1))
    hi = F.get("edges", F.col("bin"))
    return grid.select(*by, "bin", lo.alias("lo"), hi.alias("hi"), bin_label(lo, hi).alias("label"))


def numeric_counts(long: DataFrame, edges: DataFrame, by: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Rows per bin for ``by, value`` rows and ``by, edges``; the edge table stays small."""
    binned = long.join(edges, list(by)).select(*extra, *by, bin_index(F.col("value"), F.col("edges")).alias("bin"))
    return binned.groupBy(*extra, *by, "bin").agg(F.count(F.lit(1)).alias("n"))


def _shares(grid: DataFrame, counts: DataFrame, by: Sequence[str], share: str) -> DataFrame:
    """Counts over the full grid as shares of the group; an empty group raises."""
    filled = grid.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*by))
    checked = F.when(total > 0, F.col("n") / total).otherwise(F.raise_error(F.lit("cannot compute shares of an empty sample")).cast("double"))
    return filled.withColumn(share, checked).drop("n")


def numeric_shares(long: DataFrame, edges: DataFrame, by: Sequence[str], share: str = "share") -> DataFrame:
    return _shares(_numeric_grid(edges, by), numeric_counts(long, edges, by), by, share)


def categorical_grid(levels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sorted levels per ``by`` as bins 0..n-1, and the unseen bin n."""
    order = Window.partitionBy(*by).orderBy("level")
    known = levels.select(*by, (F.row_number().over(order) - 1).alias("bin"), F.col("level").alias("label"))
    unseen = levels.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("bin")).withColumn("label", F.lit(UNSEEN))
    return known.unionByName(unseen)


def categorical_counts(long: DataFrame, grid: DataFrame, by: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Rows per level bin; a level outside the grid counts as unseen."""
    counted = long.groupBy(*extra, *by, "level").agg(F.count(F.lit(1)).alias("n"))
    known = grid.where(F.col("label") != UNSEEN).select(*by, F.col("label").alias("level"), "bin")
    unseen = grid.where(F.col("label") == UNSEEN).select(*by, F.col("bin").alias("__u"))
    joined = counted.join(unseen, list(by)).join(known, [*by, "level"], "left")
    return joined.groupBy(*extra, *by, F.coalesce("bin", "__u").alias("bin")).agg(F.sum("n").alias("n"))


def categorical_shares(long: DataFrame, levels: DataFrame, by: Sequence[str], share: str = "share") -> DataFrame:
    grid = categorical_grid(levels, by)
    return _shares(grid, categorical_counts(long, grid, by), by, share)


def psi_term(expected: Column, actual: Column) -> Column:
    """(a - e) ln(a / e) with both shares floored."""
    e, a = F.greatest(expected, F.lit(SHARE_FLOOR)), F.greatest(actual, F.lit(SHARE_FLOOR))
    return (a - e) * F.ln(a / e)


def psi_status(value: Column) -> Column:
    return F.when(value < STABLE_BELOW, "stable").when(value <= SIGNIFICANT_ABOVE, "moderate").otherwise("significant")


def psi(reference: DataFrame, recent: DataFrame, by: Sequence[str]) -> DataFrame:
    """PSI per group of two share tables (``by, bin, share``); differing bins raise."""
    e = reference.select(*by, "bin", F.col("share").alias("__e"))
    a = recent.select(*by, "bin", F.col("share").alias("__a"))
    joined = e.join(a, [*by, "bin"], "full_outer")
    both = F.col("__e").isNotNull() & F.col("__a").isNotNull()
    term = F.when(both, psi_term(F.col("__e"), F.col("__a"))).otherwise(F.raise_error(F.lit("bin count mismatch")).cast("double"))
    return joined.groupBy(*by).agg(F.sum(term).alias("psi"))


def spread_segments(df: DataFrame, group: str | None) -> DataFrame:
    """Each row in the pooled segment and, given a group column, in its own."""
    if group is None:
        return df.withColumn("segment", F.lit(POOLED))
    return df.withColumn("segment", F.explode(F.array(F.lit(POOLED), F.col(group).cast("string"))))


def long_features(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], score: str | None, group: str | None):
    """Long numeric ``segment, feature, value`` and text ``segment, feature, level`` rows.

    The group column is a feature of the pooled segment only.
    """
    spread = spread_segments(df, group)
    named = spread.withColumn(SCORE_FEATURE, F.col(score)) if score else spread
    numbers = unpivot_number(named, ["segment"], [*numeric, *([SCORE_FEATURE] if score else [])])
    texts = unpivot_text(named, ["segment"], categorical).withColumnRenamed("column", "feature")
    if group is not None:
        texts = texts.where((F.col("segment") == POOLED) | (F.col("feature") != group))
    return numbers.where(F.col("value").isNotNull()), texts


def build_profile(
    df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], score: str | None = None, group: str | None = None
) -> DataFrame:
    """Reference shares per segment, feature and bin.

    Levels are those of the whole reference, in every segment. The profile is
    written once (checkpoint): it is small and every check reads it several times.
    """
    numbers, texts = long_features(df, categorical, numeric, score, group)
    keys = ["segment", "feature"]
    # both tables are small (segments x features x bins or levels) and are read twice below
    edges = cut(decile_edges(numbers, "value", keys))
    level_counts = cut(texts.where("level IS NOT NULL").groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("n")))
    by_number = numeric_shares(numbers, edges, keys, "ref_share").withColumn("kind", F.lit("numeric"))
    pooled_levels = level_counts.where(F.col("segment") == POOLED).select("feature", "level")
    grid = categorical_grid(level_counts.select(*keys).distinct().join(pooled_levels, "feature"), keys)
    labelled = level_counts.withColumnRenamed("level", "label")
    counts = grid.join(labelled, [*keys, "label"]).select(*keys, "bin", "n")
    by_level = _shares(grid, counts, keys, "ref_share")
    by_level = by_level.withColumns({"kind": F.lit("categorical"), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
    columns = [*keys, "kind", "bin", "lo", "hi", "label", "ref_share"]
    return cut(by_number.select(*columns).unionByName(by_level.select(*columns)))


def segment_rates(df: DataFrame, positive: Column, group: str | None) -> DataFrame:
    """Rows and positive rate per segment."""
    return spread_segments(df, group).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.avg(positive.cast("double")).alias("positive_rate")
    )


def profile_edges(profile: DataFrame) -> DataFrame:
    """``segment, feature, edges`` of the numeric part of a profile."""
    return profile.where("kind = 'numeric'").groupBy("segment", "feature").agg(F.array_sort(F.collect_set("hi")).alias("edges"))


def recent_counts(profile: DataFrame, numbers: DataFrame, texts: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Rows per profile bin; features and segments without a profile drop out."""
    keys = ["segment", "feature"]
    a = numeric_counts(numbers, profile_edges(profile), keys, extra)
    grid = profile.where("kind = 'categorical'").select(*keys, "bin", "label")
    b = categorical_counts(texts, grid, keys, extra)
    return a.unionByName(b)


def drift_from_counts(profile: DataFrame, counts: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """PSI, status and the bin with the largest contribution, per segment and feature (and ``extra``)."""
    keys = [*extra, "segment", "feature"]
    seen = counts.select(*keys).distinct()
    grid = seen.join(profile, ["segment", "feature"])
    filled = grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    terms = filled.withColumn("recent_share", share).withColumn("term", psi_term(F.col("ref_share"), F.col("recent_share")))
    worst = F.max_by(F.struct("label", "ref_share", "recent_share"), F.struct(F.round("term", 12), -F.col("bin")))
    out = terms.groupBy(*keys).agg(F.sum("term").alias("psi"), worst.alias("w"))
    return out.select(
        *keys, "psi", psi_status(F.col("psi")).alias("status"), F.col("w.label").alias("largest_shift_bin"),
        F.col("w.ref_share").alias("reference_share"), F.col("w.recent_share").alias("recent_share"),
    )


def feature_drift(
    profile: DataFrame, recent: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
    score: str | None = None, group: str | None = None,
) -> DataFrame:
    """Drift of recent rows against a profile, for every segment, largest PSI first.

    Segments and features that the profile lacks come last, without PSI and with
    status ``no_reference``.
    """
    keys = ["segment", "feature"]
    numbers, texts = long_features(recent, categorical, numeric, score, group)
    known = drift_from_counts(profile, recent_counts(profile, numbers, texts))
    unknown = numbers.select(*keys).unionByName(texts.select(*keys)).distinct().join(profile.select(*keys).distinct(), keys, "left_anti")
    both = known.unionByName(unknown.withColumn("status", F.lit("no_reference")), allowMissingColumns=True)
    return both.orderBy(F.desc_nulls_last("psi"), "segment", "feature")


def drift_verdict(
    drift: DataFrame, reference_rates: DataFrame, recent_rates: DataFrame, min_samples: int = MIN_SAMPLES
) -> DataFrame:
    """Worst status per segment with its code; too few recent rows give ``insufficient_data``."""
    code = F.lit(None).cast("int")
    for status, value in STATUS_CODES.items():
        code = F.when(F.col("status") == status, value).otherwise(code)
    worst = drift.withColumn("code", code).groupBy("segment").agg(F.max("code").alias("code"), F.max_by("status", "code").alias("status"), F.max("psi").alias("max_psi"))
    rates = recent_rates.select("segment", F.col("n").alias("n_recent"), F.col("positive_rate").alias("recent_positive_rate")).join(
        reference_rates.select("segment", F.col("positive_rate").alias("reference_positive_rate")), "segment", "left"
    )
    joined = rates.join(worst, "segment", "left")
    enough = F.col("n_recent") >= min_samples
    return joined.select(
        "segment", "n_recent", "reference_positive_rate", "recent_positive_rate",
        F.when(enough, F.col("max_psi")).alias("max_psi"),
        F.when(enough, F.col("status")).otherwise("insufficient_data").alias("status"),
        F.when(enough, F.col("code")).otherwise(STATUS_CODES["insufficient_data"]).alias("code"),
    )


def require_segment(profile: DataFrame, segment: str) -> DataFrame:
    """The profile of one segment; an unknown one raises."""
    chosen = profile.where(F.col("segment") == segment)
    if chosen.limit(1).count() == 0:
        raise ContractError(f"no reference segment {segment!r}")
    return chosen


def last_n(df: DataFrame, n: int, time: str = "ts", tie: str = "row_id") -> DataFrame:
    """The most recent ``n`` rows by (time, tie); rows without a time come last.

    The minute is found from which on the rows are enough; only rows from there on are ranked, minute by minute.
    """
    minute = F.coalesce(-F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 60_000_000), F.lit(1 << 62))
    return first_n(df, n, minute, [F.desc_nulls_last(time), F.desc(tie)])
