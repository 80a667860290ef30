"""Threshold and ranking metrics, pooled and per group.

Inputs carry ``y`` (0/1) and ``score``. Ranking metrics first reduce rows to one
cell per distinct score, then take exact prefix sums over ordered score buckets
whose number follows the cells, so no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import running_totals
from plumbline.functions.scalars import mean_pm_std, safe_ratio
from plumbline.roles import require

SCOPE_ALL = "pooled"


def _counts(threshold: Column | float) -> dict[str, Column]:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    said, true = F.col("score") >= t, F.col("y") == 1
    return {
        "tn": F.count_if(~true & ~said), "fp": F.count_if(~true & said),
        "fn": F.count_if(true & ~said), "tp": F.count_if(true & said),
    }


def confusion(df: DataFrame, threshold: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """TN, FP, FN, TP at ``score >= threshold``."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in _counts(threshold).items()])


def sum_confusion(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_fold.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])


def _threshold_columns() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def zero(ratio: Column) -> Column:
        return F.coalesce(ratio, F.lit(0.0))

    return {
        "precision": zero(safe_ratio(tp, tp + fp)),
        "recall": zero(safe_ratio(tp, tp + fn)),
        "f1": zero(safe_ratio(2 * tp, 2 * tp + fp + fn)),
        "accuracy": zero(safe_ratio(tp + tn, tp + tn + fp + fn)),
    }


def threshold_metrics(df: DataFrame, threshold: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and accuracy; 0 where undefined."""
    counted = confusion(df, threshold, by)
    return counted.select(*by, *[c.alias(n) for n, c in _threshold_columns().items()])


def _masses(weight: Column | None) -> dict[str, Column]:
    w = F.lit(1) if weight is None else weight
    return {"pos": w * F.col("y"), "neg": w * (1 - F.col("y"))}


def ranking_cells(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None, score: str = "score") -> DataFrame:
    """Per distinct score, descending: ``pos``/``neg`` mass, prefix sums and totals."""
    return running_totals(df, score, _masses(weight), by=by, descending=True)


def _ap() -> Column:
    """Step-wise average precision; ties share one threshold. NULL without positives."""
    precision = F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    gained = F.sum(F.when(F.col("pos") > 0, F.col("pos") * precision))
    return safe_ratio(gained, F.sum("pos"))


def _auc() -> Column:
    """Mann-Whitney with ties at one half. NULL without both classes."""
    wins = F.sum(F.col("neg") * (F.col("pos_cum") - F.col("pos") / 2))
    return safe_ratio(wins, F.sum("pos") * F.sum("neg"))


def average_precision(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    return ranking_cells(df, by, weight).groupBy(*by).agg(_ap().alias("ap"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    return ranking_cells(df, by, weight).groupBy(*by).agg(_auc().alias("roc_auc"))


def ranking_metrics(df: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """``ap`` and ``roc_auc`` from one pass over the cells."""
    return ranking_cells(df, by, weight).groupBy(*by).agg(_ap().alias("ap"), _auc().alias("roc_auc"))


def pr_curve(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every distinct threshold, with the no-skill base rate.

    Without positives recall is 1 by convention.
    """
    cells = ranking_cells(df, by)
    tp, fp, p = F.col("pos_cum"), F.col("neg_cum"), F.col("pos_total")
    return cells.select(
        *by,
        F.col("score").alias("threshold"),
        (tp / (tp + fp)).alias("precision"),
        F.when(p > 0, tp / p).otherwise(F.lit(1.0)).alias("recall"),
        (p / (p + F.col("neg_total"))).alias("base_rate"),
    )


def best_f1_threshold(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest F1 (ties to the lowest); ``(0.5, 0)`` for an empty input."""
    p, r = F.col("precision"), F.col("recall")
    points = pr_curve(df, by).withColumn("f1", 2 * p * r / (p + r + 1e-12))
    best = points.groupBy(*by).agg(F.max(F.struct(F.round("f1", 12).alias("k"), (-F.col("threshold")).alias("t"), F.col("f1"))).alias("b"))
    return best.select(
        *by,
        F.coalesce(-F.col("b.t"), F.lit(0.5)).alias("threshold"),
        F.coalesce(F.col("b.f1"), F.lit(0.0)).alias("f1"),
    )


def spread_scopes(df: DataFrame, group: str = "grp", scope: str = "scope", pooled: str = SCOPE_ALL) -> DataFrame:
    """Each row once under the pooled scope and once under its own group."""
    return df.withColumn(scope, F.explode(F.array(F.lit(pooled), F.col(group).cast("string"))))


def scope_cells(
    df: DataFrame, by: Sequence[str], group: str = "grp", weight: Column | None = None, sums: dict[str, Column] | None = None
) -> DataFrame:
    """Ranking cells of the pooled scope and of every group, with further ``sums``; rows become (group, score) cells before they are copied into scopes."""
    masses = {**_masses(weight), **(sums or {})}
    cells = df.groupBy(*by, group, "score").agg(*[F.sum(c).alias(n) for n, c in masses.items()])
    return running_totals(spread_scopes(cells, group), "score", {n: F.col(n) for n in masses}, by=[*by, "scope"], descending=True)


def metrics_by_group(df: DataFrame, threshold: Column | float, group: str = "grp", by: Sequence[str] = ("fold",)) -> DataFrame:
    """All metrics for the pooled scope and each group, within each ``by`` cell, from one pass over the cells.

    A number is held against the cells' scores; a column belongs to the rows, so its counts are summed there.
    """
    of_rows = isinstance(threshold, Column)
    said = F.col("score") >= (threshold if of_rows else F.lit(threshold))

    def split(of: dict[str, Column]) -> dict[str, Column]:
        return {"tn": F.when(~said, of["neg"]), "fp": F.when(said, of["neg"]), "fn": F.when(~said, of["pos"]), "tp": F.when(said, of["pos"])}

    sums = split(_masses(None)) if of_rows else {}
    parts = {n: F.col(n) for n in sums} or split({n: F.col(n) for n in ("pos", "neg")})
    counts = {n: F.coalesce(F.sum(c), F.lit(0)) for n, c in parts.items()}
    keys = [*by, "scope"]
    summed = scope_cells(df, by, group, sums=sums).groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()], _ap().alias("ap"), _auc().alias("roc_auc"))
    return summed.select(*keys, *[c.alias(n) for n, c in _threshold_columns().items()], "ap", "roc_auc")


def to_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``keys, metric, value`` rows."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.inline(cells))


def summarize(long: DataFrame, by: Sequence[str], digits: int = 3) -> DataFrame:
    """Mean and population std over folds of a long metric table, with ``m ± s`` text."""
    out = long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.withColumn("text", mean_pm_std(F.col("mean"), F.col("std"), digits))


def scope_ap(df: DataFrame, by: Sequence[str], group: str = "grp", weight: Column | None = None) -> DataFrame:
    """AP of the pooled scope and of every group."""
    return scope_cells(df, by, group, weight).groupBy(*by, "scope").agg(_ap().alias("ap"))


def derived_metrics(scope_values: DataFrame, prevalence: DataFrame, by: Sequence[str]) -> DataFrame:
    """P, P_c, Ex_c, L_c, W, G, W_ex and W_lift from AP per scope.

    ``scope_values`` has ``by, scope, ap``; ``prevalence`` has ``scope, prevalence``
    per group. Returns ``by, metric, scope, value``; W carries the worst group. A
    window over one cell's scopes: its size is the number of groups.
    """
    by = list(by)
    require(len(by) > 0, "derived metrics need at least one key column")
    pooled, ap, prev = F.col("scope") == SCOPE_ALL, F.col("ap"), F.col("prevalence")
    known = scope_values.join(prevalence, "scope", "left").where(pooled | prev.isNotNull())
    cell = Window.partitionBy(*by)
    lowest = F.min(F.when(~pooled & ap.isNotNull(), F.struct("ap", "scope"))).over(cell)
    spread = known.select(
        *by, "scope", "ap", "prevalence", F.count_if(~pooled).over(cell).alias("__n"), lowest.alias("__w"),
        F.min(F.when(~pooled, ap - prev)).over(cell).alias("__ex"), F.min(F.when(~pooled, ap / prev)).over(cell).alias("__lift"),
    )

    def metric(name: str, scope: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), scope.alias("scope"), value.alias("value"))

    everyone, own = F.lit(SCOPE_ALL), F.col("scope")
    per_group = [metric("P_c", own, ap), metric("Ex_c", own, ap - prev), metric("L_c", own, ap / prev)]
    top = [
        metric("P", everyone, ap), metric("W", F.col("__w.scope"), F.col("__w.ap")), metric("G", everyone, ap - F.col("__w.ap")),
        metric("W_ex", everyone, F.col("__ex")), metric("W_lift", everyone, F.col("__lift")),
    ]
    rows = F.when(~pooled, F.array(*per_group)).when(F.col("__n") > 0, F.array(*top))
    return spread.select(*by, F.inline(rows)).select(*by, "metric", "scope", "value")


def prevalence(df: DataFrame, group: str = "grp") -> DataFrame:
    return df.groupBy(F.col(group).cast("string").alias("scope")).agg(F.avg("y").alias("prevalence"))


def fairness_metrics(
    df: DataFrame, by: Sequence[str] = ("arm",), seed: str = "seed", group: str = "grp", row_id: str = "row_id"
) -> DataFrame:
    """Seed-mean AP per scope, then every derived metric; W is the minimum of the seed means.

    Prevalence is that of the distinct rows of all arms and seeds together, so an
    arm that lacks a group doesn't change the others' reference.
    """
    per_seed = scope_ap(df, [*by, seed], group)
    means = per_seed.groupBy(*by, "scope").agg(F.avg("ap").alias("ap"))
    return derived_metrics(means, prevalence(df.select(row_id, group, "y").distinct(), group), by)


def selection_score(df: DataFrame, kind: str, by: Sequence[str] = (), group: str = "grp") -> DataFrame:
    """Pooled AP, or the lowest group AP; groups without positives are skipped."""
    require(kind in ("pooled", "worst_group"), f"unknown selection {kind!r}")
    if kind == "pooled":
        return average_precision(df, by).withColumnRenamed("ap", "selection")
    return average_precision(df, [*by, group]).groupBy(*by).agg(F.min("ap").alias("selection"))


def fold_mean_ap(df: DataFrame, by: Sequence[str] = (), fold: str = "fold") -> DataFrame:
    """Mean of per-fold AP beside the AP of the concatenated scores."""
    means = average_precision(df, [*by, fold]).groupBy(*by).agg(F.avg("ap").alias("fold_mean_ap"))
    whole = average_precision(df, by).withColumnRenamed("ap", "concatenated_ap")
    if by:
        return means.join(whole, list(by))
    return means.withColumn("concatenated_ap", whole.scalar())
