"""Profiling: group tables, rates, summaries, association and distances.

Totals over all rows are labelled ``ALL``. Shares and statistics are computed
from pre-aggregated cells, whose number depends on levels, not on rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import exact_quantiles
from plumbline.functions.scalars import safe_ratio, unpivot_number, unpivot_text
from plumbline.operators.encode import qcut_edges, right_closed_bin

TOTAL = "ALL"


def _rolled(df: DataFrame, group: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates per group and over all rows, the latter named ALL."""
    out = df.rollup(group).agg(F.grouping(group).alias("__g"), *aggregates)
    return out.withColumn(group, F.when(F.col("__g") == 1, F.lit(TOTAL)).otherwise(F.col(group).cast("string"))).drop("__g")


def group_profile(df: DataFrame, group: str = "grp", target: str = "y", other: DataFrame | None = None) -> DataFrame:
    """Rows, positives, prevalence and shares per group and in total, with another table's row counts."""
    y = F.col(target)
    counts = _rolled(df, group, [F.count(F.lit(1)).alias("rows"), F.sum(y).cast("bigint").alias("positives")])
    n_all = F.max(F.when(F.col(group) == TOTAL, F.col("rows"))).over(Window.partitionBy(F.lit(0)))
    p_all = F.max(F.when(F.col(group) == TOTAL, F.col("positives"))).over(Window.partitionBy(F.lit(0)))
    out = counts.select(
        group, "rows", "positives", (F.col("rows") - F.col("positives")).alias("negatives"),
        (F.col("positives") / F.col("rows")).alias("prevalence"), (F.col("rows") / n_all).alias("share_of_rows"),
        safe_ratio(F.col("positives"), p_all).alias("share_of_positives"),
    )
    if other is None:
        return out
    extra = _rolled(other, group, [F.count(F.lit(1)).alias("other_rows")])
    return out.join(extra, group, "left").withColumn("other_rows", F.coalesce("other_rows", F.lit(0)))


def target_share(df: DataFrame, group: str = "grp", target: str = "y") -> DataFrame:
    """Long class shares inside each group."""
    return crosstab(df, group, target, "row").select(group, target, "share")


def crosstab(df: DataFrame, a: str, b: str, normalize: str | None = None) -> DataFrame:
    """Long contingency counts, with shares of the row, the column or everything."""
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    if normalize is None:
        return counts
    keys = {"row": [a], "column": [b], "all": [F.lit(0)]}[normalize]
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def rate_by_level(df: DataFrame, columns: Sequence[str], target: str = "y", group: str | None = None) -> DataFrame:
    """Positive rate per level of each column, optionally inside each group."""
    ids = [target] if group is None else [target, group]
    long = unpivot_text(df, ids, columns)
    keys = ["column", "level", *([] if group is None else [group])]
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("rate"))


def rate_by_bin(df: DataFrame, column: str, edges: Sequence[float], target: str = "y") -> DataFrame:
    """Positive rate per right-closed bin; rows outside the edges form the NULL bin."""
    binned = df.withColumn("bin", right_closed_bin(F.col(column), edges))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("rate"))


def disguised_missing_profile(df: DataFrame, placeholders: Mapping[str, str], group: str = "grp", target: str = "y") -> DataFrame:
    """Placeholder answers per column and group: count, share of the group's rows and positives."""
    aggregates = [F.count(F.lit(1)).alias("__rows")]
    for i, (c, v) in enumerate(placeholders.items()):
        hit = F.coalesce(F.col(c) == v, F.lit(False))
        aggregates += [F.count_if(hit).alias(f"n{i}"), F.count_if(hit & (F.col(target) == 1)).alias(f"p{i}")]
    counted = _rolled(df, group, aggregates)
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(v).alias("placeholder"), F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("positives"))
        for i, (c, v) in enumerate(placeholders.items())
    ])
    out = counted.select(group, "__rows", F.explode(entries).alias("e"))
    return out.select("e.column", "e.placeholder", group, "e.n", (F.col("e.n") / F.col("__rows")).alias("share_of_group_rows"), "e.positives")


def numeric_summary(df: DataFrame, columns: Sequence[str], group: str = "grp", outlier_above: float | None = None) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max and outliers per column, per group and in total."""
    scoped = df.withColumn("__scope", F.explode(F.array(F.lit(TOTAL), F.col(group).cast("string"))))
    long = unpivot_number(scoped, ["__scope"], columns).withColumnRenamed("__scope", group)
    keys = ["feature", group]
    above = F.lit(float("inf") if outlier_above is None else float(outlier_above))
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count_if(F.col("value") > above).alias("n_outliers"),
    )
    quartiles = exact_quantiles(long, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, by=keys)
    return moments.join(quartiles, keys, "left")


def level_group_counts(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Rows per column, level and group on the full level x group grid; absent cells are 0."""
    counts = unpivot_text(df, [group], columns).groupBy("column", "level", group).agg(F.count(F.lit(1)).alias("n"))
    groups = df.agg(F.collect_set(group).alias("g")).scalar()
    grid = counts.select("column", "level").distinct().withColumn("__g", groups).withColumn(group, F.explode("__g")).drop("__g")
    return grid.join(counts, ["column", "level", group], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rare_levels(df: DataFrame, columns: Sequence[str], group: str = "grp", min_cell: int = 30) -> DataFrame:
    """Levels with fewer than ``min_cell`` rows in some group."""
    cells = level_group_counts(df, columns, group)
    return cells.groupBy("column", "level").agg(F.min("n").alias("min_cell")).where(F.col("min_cell") < min_cell)


def pearson_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson r of every unordered column pair, all in one aggregate."""
    pairs = list(combinations(columns, 2))
    found = df.groupBy(*by).agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return found.select(*by, F.inline(entries))


def correlation_shift(before: DataFrame, after: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The ``k`` column pairs whose correlation changed most."""
    x = pearson_matrix(before, columns).withColumnRenamed("r", "r_before")
    y = pearson_matrix(after, columns).withColumnRenamed("r", "r_after")
    joined = x.join(y, ["a", "b"]).withColumn("shift", F.abs(F.col("r_after") - F.col("r_before")))
    return joined.orderBy(F.desc("shift"), "a", "b").limit(k)


def pair_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Contingency cells ``a, b, la, lb, n`` for every unordered column pair.

    Each row emits its column pairs (their number is fixed by the schema) and is
    combined before the shuffle; no self join of rows.
    """
    entries = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("la"), F.col(b).cast("string").alias("lb"))
        for a, b in combinations(columns, 2)
    ])
    cells = df.select(F.inline(entries)).where("la IS NOT NULL AND lb IS NOT NULL")
    return cells.groupBy("a", "b", "la", "lb").agg(F.count(F.lit(1)).alias("n"))


def cramers_v_from_cells(cells: DataFrame, corrected: bool = False) -> DataFrame:
    """Cramer's V per pair from contingency cells.

    Plain: sqrt(chi2 / (n (min(r, k) - 1))), 0 when a side has one level.
    Corrected: bias-corrected, with Yates' correction on 2x2 tables only.
    """
    n_a = F.sum("n").over(Window.partitionBy("a", "b", "la"))
    n_b = F.sum("n").over(Window.partitionBy("a", "b", "lb"))
    marked = cells.withColumn("ra", n_a).withColumn("cb", n_b)
    # first cell of every row and column of the table, to count levels without a distinct
    marked = marked.withColumn("fa", F.row_number().over(Window.partitionBy("a", "b", "la").orderBy("lb")))
    marked = marked.withColumn("fb", F.row_number().over(Window.partitionBy("a", "b", "lb").orderBy("la")))
    n = F.sum("n")
    sums = marked.groupBy("a", "b").agg(
        n.alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("s"),
        F.count_if(F.col("fa") == 1).alias("r"), F.count_if(F.col("fb") == 1).alias("k"),
        F.max_by(F.struct("n", "ra", "cb"), F.struct(F.col("la"), F.col("lb"))).alias("one"),
    )
    total, r, k = F.col("n"), F.col("r"), F.col("k")
    chi2 = total * (F.col("s") - 1)
    if not corrected:
        v = F.when(F.least(r, k) < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(chi2, F.lit(0.0)) / (total * (F.least(r, k) - 1))))
        return sums.select("a", "b", v.alias("v"))
    ra, cb = F.col("one.ra").cast("double"), F.col("one.cb").cast("double")
    cross = F.abs(total * F.col("one.n") - ra * cb)  # |ad - bc| of a 2x2 table, from any one cell
    reduced = cross - F.least(total / 2, cross)
    yates = total * reduced * reduced / (ra * (total - ra) * cb * (total - cb))
    stat = F.when((r == 2) & (k == 2), yates).otherwise(chi2)
    phi2 = F.greatest(F.lit(0.0), stat / total - (k - 1) * (r - 1) / (total - 1))
    rc = r - (r - 1) * (r - 1) / (total - 1)
    kc = k - (k - 1) * (k - 1) / (total - 1)
    v = F.when(F.least(r, k) >= 2, F.sqrt(phi2 / F.least(kc - 1, rc - 1)))
    return sums.select("a", "b", v.alias("v"))


def cramers_v(df: DataFrame, a: str, b: str, corrected: bool = False) -> DataFrame:
    return cramers_v_from_cells(pair_counts(df, [a, b]), corrected)


def with_quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric columns as quartile labels."""
    out = df
    for c in columns:
        out = out.withColumn("__e", qcut_edges(df, c, 4).scalar())
        bin_no = F.greatest(F.size(F.filter("__e", lambda e: e < F.col(c))) - 1, F.lit(0))
        out = out.withColumn(c, F.concat(F.lit("q"), bin_no.cast("string"))).drop("__e")
    return out


def association_matrix(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str] = (), corrected: bool = False) -> DataFrame:
    """Cramer's V for every column pair, numerics in quartiles."""
    return cramers_v_from_cells(pair_counts(with_quartiles(df, numeric), [*categorical, *numeric]), corrected)


def total_variation(df: DataFrame, columns: Sequence[str], group: str = "grp") -> DataFrame:
    """Half the absolute share difference per column and group pair (0 same, 1 disjoint)."""
    cells = level_group_counts(df, columns, group)
    shares = cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column", group)))
    a = shares.select("column", "level", F.col(group).alias("a"), F.col("share").alias("sa"))
    b = shares.select("column", "level", F.col(group).alias("b"), F.col("share").alias("sb"))
    joined = a.join(b, ["column", "level"]).where("a < b")
    return joined.groupBy("column", "a", "b").agg((F.sum(F.abs(F.col("sa") - F.col("sb"))) / 2).alias("distance"))


def resampling_balance(before: DataFrame, after: DataFrame, fold: str = "fold", target: str = "y") -> DataFrame:
    """Class counts per fold before and after resampling."""
    parts = [
        part.groupBy(fold, target).agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(stage))
        for stage, part in (("before", before), ("after", after))
    ]
    return parts[0].unionByName(parts[1])


def blended_levels(df: DataFrame, block: Mapping[str, str], full: float = 0.999) -> DataFrame:
    """Dominant level of a one-hot block ``{level: column}`` with rows, and rows whose block is blended."""
    names = F.array(*[F.lit(level) for level in block])
    values = F.array(*[F.col(c).cast("double") for c in block.values()])
    top = F.array_max(values)
    marked = df.select(F.element_at(names, F.array_position(values, top).cast("int")).alias("dominant"), (top < full).alias("blended"))
    return marked.groupBy("dominant").agg(F.count(F.lit(1)).alias("n"), F.count_if("blended").alias("n_blended"))


def non_integer_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows whose code is not a whole number, per column."""
    found = df.agg(*[F.avg((F.col(c) % 1 != 0).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)])
    return found.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("share")) for i, c in enumerate(columns)])))


def positive_share(df: DataFrame, threshold: float, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Share of rows scored at or above the threshold."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(score) >= threshold).cast("double")).alias("positive_share"))


def latency_summary(df: DataFrame, latency: str, by: Sequence[str] = (), batch: Column | None = None) -> DataFrame:
    """Mean with a 95% interval (sample std), exact p50/p95/p99, max and throughput of logged latencies in ms."""
    rows = batch if batch is not None else F.lit(1)
    moments = df.groupBy(*by).agg(
        F.count(latency).alias("runs"), F.avg(latency).alias("mean"),
        (F.lit(1.96) * F.stddev_samp(latency) / F.sqrt(F.count(latency))).alias("half_width"),
        F.max(latency).alias("max"), safe_ratio(F.sum(rows) * 1000.0, F.sum(latency)).alias("rows_per_second"),
    )
    points = exact_quantiles(df, latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by=by)
    if by:
        joined = moments.join(points, list(by))
    else:
        one = points.select(F.struct("p50", "p95", "p99").alias("p")).scalar()
        joined = moments.withColumn("__p", one).select("*", "__p.*").drop("__p")
    return joined.withColumns({"ci_low": F.col("mean") - F.col("half_width"), "ci_high": F.col("mean") + F.col("half_width")}).drop("half_width")


def log_loss(score: Column, y: Column, floor: float = 1e-15) -> Column:
    p = F.least(F.greatest(score, F.lit(floor)), F.lit(1 - floor))
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def group_mean_loss(df: DataFrame, group: str = "grp", weight: str = "weight", n_groups: int | None = None) -> DataFrame:
    """Weighted log-loss mean per group; fewer than ``n_groups`` groups raise."""
    per_group = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(log_loss(F.col("score"), F.col("y")) * F.col(weight)).alias("loss")
    )
    if n_groups is None:
        return per_group
    seen = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    message = F.lit(f"expected {n_groups} groups in every batch")
    return per_group.withColumn("loss", F.when(seen == n_groups, F.col("loss")).otherwise(F.raise_error(message).cast("double")))


def history_mean(history: DataFrame, arrays: Sequence[str] = ("q", "loss")) -> DataFrame:
    """Mean over seeds and folds per epoch and group of per-epoch arrays of group values.

    ``history`` has one row per run with ``array<array<double>>`` columns
    (epoch, group).
    """
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    epochs = history.select(F.posexplode(zipped).alias("e", "v"))
    groups = epochs.select((F.col("e") + 1).alias("epoch"), F.posexplode(F.arrays_zip(*[F.col("v")[a].alias(a) for a in arrays])).alias("group", "w"))
    return groups.groupBy("epoch", "group").agg(*[F.avg(F.col("w")[a]).alias(a) for a in arrays])
