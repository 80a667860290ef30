"""Agreement between two attributions of the same rows.

Attributions are packed to one short array per row (its features), joined once
on the row, and compared with array expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import arrays as A
from plumbline.functions.ordering import exact_quantiles
from plumbline.functions.session import cut
from plumbline.operators import inference as B
from plumbline.operators.attribution import importance_share, mean_abs_importance
from plumbline.operators.profile import association_matrix

SHARED_ZERO = 1e-9


def pack(attr: DataFrame, name: str, keys: Sequence[str] = ("row_id",), position: str = "feature") -> DataFrame:
    """One array of values per row, ordered by feature position."""
    packed = attr.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col("value").alias("v")))).alias("__z"))
    return packed.select(*keys, F.transform("__z", lambda z: z["v"]).alias(name))


def pair(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("row_id",), position: str = "feature") -> DataFrame:
    """Aligned arrays ``a`` and ``b`` per row."""
    return pack(a, "a", keys, position).join(pack(b, "b", keys, position), list(keys))


def _abs(values: Column) -> Column:
    return F.transform(values, lambda v: F.abs(v))


def rank_corr(a: Column, b: Column) -> Column:
    """Correlation of ordinal ranks of absolute values; NULL when either is constant."""
    def over(x: Column, y: Column) -> Column:
        rho = A.pearson(A.ordinal_ranks_desc(x), A.ordinal_ranks_desc(y))
        return F.when(~A.is_constant(x) & ~A.is_constant(y), rho)

    return A.let(_abs(a), lambda x: A.let(_abs(b), lambda y: over(x, y)))


def rank_corr_no_shared_zeros(a: Column, b: Column) -> Column:
    """Average-rank Spearman over features not zero in both; NULL when fewer than 3 remain or one is constant."""
    informative = F.filter(
        F.arrays_zip(_abs(a).alias("x"), _abs(b).alias("y")), lambda z: ~((z["x"] < SHARED_ZERO) & (z["y"] < SHARED_ZERO))
    )

    def over(zipped: Column) -> Column:
        x, y = F.transform(zipped, lambda z: z["x"]), F.transform(zipped, lambda z: z["y"])
        return F.when(F.size(zipped) >= 3, A.pearson(A.average_ranks(x), A.average_ranks(y)))

    return A.let(informative, over)


def instance_rank_corr(pairs: DataFrame, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    return pairs.select(*keys, rank_corr(F.col("a"), F.col("b")).alias("rho"))


def instance_rank_corr_no_shared_zeros(pairs: DataFrame, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    return pairs.select(*keys, rank_corr_no_shared_zeros(F.col("a"), F.col("b")).alias("rho"))


def _importances(pairs: DataFrame, m: int, by: Sequence[str], weight: Column) -> DataFrame:
    """Weighted mean absolute value per feature as two arrays; one aggregate, no explode."""
    def means(name: str) -> Column:
        return F.array(*[F.sum(weight * F.abs(F.get(name, j))) / F.sum(weight) for j in range(m)])

    return pairs.groupBy(*by).agg(means("a").alias("ia"), means("b").alias("ib"))


def _global_columns() -> dict[str, Column]:
    a, b = F.col("ia"), F.col("ib")
    return {
        "global_spearman": A.pearson(A.average_ranks(a), A.average_ranks(b)), "global_kendall": A.kendall_tau_b(a, b),
        "top3_overlap": A.top_k_overlap(a, b, 3), "top5_overlap": A.top_k_overlap(a, b, 5),
    }


def global_agreement(pairs: DataFrame, m: int, by: Sequence[str] = ()) -> DataFrame:
    """Spearman, Kendall and top-3/5 overlap of the two global importances over ``m`` features."""
    packed = _importances(pairs, m, by, F.lit(1))
    return packed.select(*by, *[c.alias(n) for n, c in _global_columns().items()])


def _row_statistics(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    zipped = F.arrays_zip(a.alias("x"), b.alias("y"))
    nonzero = F.filter(zipped, lambda z: (z["x"] != 0) & (z["y"] != 0))
    return pairs.withColumns({
        "rho": rank_corr(a, b), "rho_nz": rank_corr_no_shared_zeros(a, b),
        "same_top": (A.argmax(_abs(a)) == A.argmax(_abs(b))).cast("double"),
        "n_nonzero": F.size(nonzero), "n_same_sign": F.size(F.filter(nonzero, lambda z: F.signum(z["x"]) == F.signum(z["y"]))),
        "abs_diff": F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, v: acc + v) / F.size(a),
        "shared_zeros": F.size(F.filter(zipped, lambda z: (F.abs(z["x"]) < SHARED_ZERO) & (F.abs(z["y"]) < SHARED_ZERO))),
    })


def summarize_agreement(pairs: DataFrame, m: int, by: Sequence[str] = ()) -> DataFrame:
    """Every point measure of two aligned attributions, per ``by``."""
    by = list(by)
    # a constant key makes the join below an ordinary equi-join on a stored column
    keyed = cut(_row_statistics(pairs if by else pairs.withColumn("__1", F.lit(1))))
    keys = by or ["__1"]
    simple = keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.round("rho", 12) < 0.5).cast("double")).alias("share_below_half"),
        F.avg("same_top").alias("same_top_feature_share"), (F.sum("n_same_sign") / F.sum("n_nonzero")).alias("sign_agreement_share"),
        F.avg("abs_diff").alias("mean_abs_difference"), F.avg("shared_zeros").alias("mean_shared_zero_features"),
    )
    quartiles = exact_quantiles(keyed, "rho", {"q25": 0.25, "median": 0.5, "q75": 0.75}, by=keys)
    out = simple.join(quartiles, keys, "left").join(global_agreement(keyed, m, keys), keys)
    return out if by else out.drop("__1")


def agreement_with_ci(
    pairs: DataFrame, m: int, reps: int, seed: object, by: Sequence[str] = (), level: float = 0.95, row_id: str = "row_id"
) -> DataFrame:
    """``(by, metric, estimate, ci_low, ci_high, reps)`` with percentile intervals over resampled rows.

    ``by`` may hold several comparisons at once; rows are resampled inside each.
    """
    B.check_bootstrap(reps, level)
    by = list(by)
    keyed = cut(_row_statistics(pairs))
    ids = keyed.select(*by, row_id)
    drawn = B.bootstrap_draws(ids, by, reps, seed, row_id, keep=by)
    point = keyed.withColumn("rep", F.lit(B.POINT)).withColumn("c", F.lit(1).cast("bigint"))
    weighted = keyed.join(drawn, [*by, row_id]).unionByName(point)
    keys = [*by, "rep"]
    c = F.col("c")
    simple = weighted.groupBy(*keys).agg(
        (F.sum(c * F.col("same_top")) / F.sum(c)).alias("same_top_feature_share"),
        (F.sum(c * F.col("n_same_sign")) / F.greatest(F.sum(c * F.col("n_nonzero")), F.lit(1))).alias("sign_agreement_share"),
    )
    world = _importances(weighted, m, keys, c).select(*keys, *[col.alias(n) for n, col in _global_columns().items()])
    medians = [
        exact_quantiles(weighted, source, {name: 0.5}, by=keys, weight=c)
        for source, name in (("rho", "instance_spearman_median"), ("rho_nz", "instance_spearman_median_no_shared_zeros"))
    ]
    wide = simple.join(world, keys).join(medians[0], keys, "left").join(medians[1], keys, "left")
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in wide.columns if n not in keys])
    long = wide.select(*keys, F.inline(cells))
    return B.point_and_interval(long, [*by, "metric"], level)


def agreement_table(
    attr: DataFrame, specs: Sequence[tuple[str, str, str]], samples: DataFrame, m: int, reps: int, seed: object, position: str = "feature"
) -> DataFrame:
    """All registered comparisons ``(id, set a, set b)`` on every sample ``(sample, row_id)`` in one job."""
    spark = attr.sparkSession
    listed = spark.createDataFrame(list(specs), "id string, set_a string, set_b string")
    packed = pack(attr, "x", ["set_id", "row_id"], position)
    a = packed.select(F.col("set_id").alias("set_a"), "row_id", F.col("x").alias("a"))
    b = packed.select(F.col("set_id").alias("set_b"), "row_id", F.col("x").alias("b"))
    pairs = listed.join(a, "set_a").join(b, ["set_b", "row_id"]).join(samples, "row_id")
    return agreement_with_ci(pairs.select("id", "sample", "row_id", "a", "b"), m, reps, seed, by=["id", "sample"])


def per_feature_disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean absolute difference relative to the two's mean size, per feature; NULL where both are zero."""
    joined = a.select("row_id", "feature", F.col("value").alias("__a")).join(b.select("row_id", "feature", F.col("value").alias("__b")), ["row_id", "feature"])
    scale = (F.avg(F.abs("__a")) + F.avg(F.abs("__b"))) / 2
    return joined.groupBy("feature").agg(F.when(scale > 0, F.avg(F.abs(F.col("__a") - F.col("__b"))) / scale).alias("disagreement"))


def tp_vs_tn(attr: DataFrame, scores: DataFrame, threshold: float, reps: int, seed: object, level: float = 0.95) -> DataFrame:
    """Mean attribution of true positives and true negatives and their difference with an interval, per feature."""
    hit = F.col("score") >= F.lit(threshold)
    marked = scores.select("row_id", (hit & (F.col("y") == 1)).cast("int").alias("tp"), (~hit & (F.col("y") == 0)).cast("int").alias("tn"))
    rows = attr.select("row_id", "feature", "value").join(marked.where("tp = 1 OR tn = 1"), "row_id")
    drawn = B.bootstrap_draws(rows.select("row_id", "tp").distinct(), ["tp"], reps, seed)
    weighted = B.with_draws(rows, drawn)
    c, v = F.col("c"), F.col("value")

    def mean(flag: str) -> Column:
        return F.sum(c * v * F.col(flag)) / F.sum(c * F.col(flag))

    stats = weighted.groupBy("rep", "feature").agg(mean("tp").alias("mean_tp"), mean("tn").alias("mean_tn"))
    stats = stats.withColumn("value", F.col("mean_tp") - F.col("mean_tn"))
    point = F.col("rep") == B.POINT
    tail = (1 - level) / 2
    boot = F.when(~point, F.col("value"))
    return stats.groupBy("feature").agg(
        F.max(F.when(point, F.col("mean_tp"))).alias("mean_tp"), F.max(F.when(point, F.col("mean_tn"))).alias("mean_tn"),
        F.max(F.when(point, F.col("value"))).alias("difference"),
        F.percentile(boot, F.lit(tail)).alias("ci_low"), F.percentile(boot, F.lit(1 - tail)).alias("ci_high"),
    )


def baseline_sensitivity(pairs: DataFrame, m: int, reps: int, seed: object, level: float = 0.95) -> DataFrame:
    """Spearman correlation of the two baselines' importances, with an interval over resampled rows."""
    B.check_bootstrap(reps, level)
    drawn = B.bootstrap_draws(pairs.select("row_id"), [], reps, seed)
    weighted = B.with_draws(pairs, drawn)
    packed = _importances(weighted, m, ["rep"], F.col("c"))
    values = packed.select("rep", F.lit("spearman").alias("metric"), A.pearson(A.average_ranks(F.col("ia")), A.average_ranks(F.col("ib"))).alias("value"))
    return B.point_and_interval(values, ["metric"], level)


def importance_views(attr: DataFrame, reps: int, seed: object, method: str = "set_id", level: float = 0.95) -> DataFrame:
    """Importance, share, rank and interval per method and feature, for serving."""
    drawn = B.bootstrap_draws(attr.select("row_id").distinct(), [], reps, seed)
    weighted = B.with_draws(attr.select(method, "row_id", "feature", "value"), drawn)
    values = weighted.groupBy("rep", method, "feature").agg((F.sum(F.col("c") * F.abs("value")) / F.sum("c")).alias("value"))
    intervals = B.point_and_interval(values, [method, "feature"], level)
    shares = importance_share(mean_abs_importance(attr, [method]), [method])
    return intervals.join(shares.select(method, "feature", "share"), [method, "feature"])


def ablation_shapley_gap(shapley: DataFrame, ablation: DataFrame, interactions: DataFrame) -> DataFrame:
    """How well pairwise interactions explain ablation minus Shapley at the same reference point."""
    gap = ablation.select("row_id", "feature", F.col("value").alias("__ab")).join(
        shapley.select("row_id", "feature", F.col("value").alias("__sh")), ["row_id", "feature"]
    ).select("row_id", "feature", (F.col("__ab") - F.col("__sh")).alias("gap"), "__sh")
    sums = interactions.where("feature_i <> feature_j").groupBy("row_id", F.col("feature_i").alias("feature")).agg(F.sum("value").alias("pair_sum"))
    cells = cut(gap.join(sums, ["row_id", "feature"]))
    big = F.abs("gap") > 1e-6
    fit = 1 - F.sum(F.pow(F.col("gap") - F.col("pair_sum"), F.lit(2))) / (F.var_pop("gap") * F.count(F.lit(1)))
    moments = cells.agg(
        F.countDistinct("row_id").alias("n"), F.avg(F.abs("gap")).alias("mean_abs_gap"), F.avg(F.abs("__sh")).alias("mean_abs_shapley"),
        F.when(F.var_pop("gap") > 0, fit).alias("r2"),
        F.avg(F.when(big, (F.signum("gap") == F.signum("pair_sum")).cast("double"))).alias("same_sign_share"),
    )
    ranked = cells.select(F.round("gap", 9).alias("gap"), F.round("pair_sum", 9).alias("pair_sum"))
    rho = B.spearman(ranked, "gap", "pair_sum").select("rho")
    return moments.withColumn("spearman", rho.scalar())


def association_vs_disagreement(
    df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], disagreement: DataFrame
) -> DataFrame:
    """Largest Cramer's V of each feature beside its disagreement (``feature, disagreement``)."""
    v = association_matrix(df, categorical, numeric)
    sides = v.select(F.col("a").alias("feature"), F.col("b").alias("partner"), "v").unionByName(v.select(F.col("b").alias("feature"), F.col("a").alias("partner"), "v"))
    top = sides.groupBy("feature").agg(F.max("v").alias("max_v"), F.max_by("partner", F.struct("v", "partner")).alias("partner"))
    return top.join(disagreement, "feature")
