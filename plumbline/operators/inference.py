"""Paired bootstrap, multiple-testing control and rank correlation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import exp

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import arrays as A
from plumbline.functions.hashing import hash_int, hash_key
from plumbline.functions.ordering import hash_rank, null_safe_join, running_totals
from plumbline.functions.scalars import safe_ratio
from plumbline.functions.session import cut
from plumbline.operators import metrics as M
from plumbline.roles import require

POINT = -1  # replicate number of the point estimate


def bootstrap_draws(
    df: DataFrame, strata: Sequence[str], reps: int, seed: object, row_id: str = "row_id", keep: Sequence[str] = ()
) -> DataFrame:
    """``(rep, row_id, c)``: how often each row is drawn, resampling inside each stratum.

    ``keep`` names strata columns to return too, for row ids that repeat across strata.

    Every row is also a draw slot, so each replicate draws exactly the stratum's
    size. The draws are partitioned by (stratum, drawn rank), which a large
    stratum spreads over all tasks.
    """
    require(reps >= 1, "reps must be positive")
    keyed = df.select(row_id, *strata)
    ranked = hash_rank(keyed, f"{seed}-slot", row_id, strata, rank="__rank", size="__n")
    label = F.concat_ws("_", *[F.col(s).cast("string") for s in strata]) if strata else F.lit("")
    slots = ranked.select(*strata, "__rank", "__n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draws = slots.select(
        *strata, "rep", (hash_int(seed, "rep", label, "__rank") % F.col("__n") + 1).alias("__hit")
    )
    counted = draws.repartition(*strata, "__hit").groupBy(*strata, "__hit", "rep").agg(F.count(F.lit(1)).alias("c"))
    rows = ranked.select(*strata, F.col("__rank").alias("__hit"), row_id)
    return null_safe_join(counted, rows, [*strata, "__hit"]).select(*keep, "rep", row_id, "c")


#: Poisson replicates: hex digits of one draw, and draws taken from one md5.
POISSON_DIGITS, POISSON_PER_HASH = 4, 8


def poisson_limits() -> list[int]:
    """The draws from which a count is at least 1, 2, ...: the Poisson(1) distribution function in units of a draw."""
    units, limits, term, below = 16**POISSON_DIGITS, [], exp(-1.0), 0.0
    for k in range(1, 10):
        below += term
        if round(units * below) < units:
            limits.append(round(units * below))
        term /= k
    return limits


def poisson_draws(df: DataFrame, reps: int, seed: object, row_id: str = "row_id") -> DataFrame:
    """The rows with ``rep`` and their Poisson(1) count ``c``, if it isn't 0; every row once as replicate -1.

    The large-scale form of :func:`bootstrap_draws`: counts come from hashes of the
    row's id, in the row, so nothing is ranked, joined or shuffled, and aggregates
    over (replicate, cell) combine in the map stage. Replicates have the sample's size
    on average only, so results are approximate; a count is exact to 16^-4.
    """
    require(reps >= 1, "reps must be positive")
    blocks = -(-reps // POISSON_PER_HASH)
    hashed = df.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("__h", hash_key(f"{seed}-poisson", row_id, "__b"))

    # a hash gives words, a word two draws; each is a column of its own, computed once however often it is compared
    pairs, width = POISSON_PER_HASH // 2, 2 * POISSON_DIGITS
    words = F.array(*[
        F.struct(F.lit(i).alias("__i"), F.conv(F.substring("__h", width * i + 1, width), 16, 10).cast("bigint").alias("__v")) for i in range(pairs)
    ])
    worded = hashed.select(*df.columns, "__b", F.inline(words))
    limits, units = poisson_limits(), 16**POISSON_DIGITS
    rep, first = F.col("__b") * POISSON_PER_HASH + 2 * F.col("__i"), (F.col("__b") == 0) & (F.col("__i") == 0)

    def drawn(number: Column, unit: Column) -> Column:
        return F.struct(number.alias("rep"), unit.cast("int").alias("__u"))

    draws = F.array(
        drawn(rep, F.shiftright("__v", 4 * POISSON_DIGITS)), drawn(rep + 1, F.col("__v").bitwiseAND(F.lit(units - 1).cast("bigint"))),
        drawn(F.lit(POINT), F.when(first, limits[0]).otherwise(0)),  # a draw that counts once
    )
    count = sum(((F.col("__u") >= limit).cast("bigint") for limit in limits), F.lit(0).cast("bigint"))
    spread = worded.select(*df.columns, F.inline(draws)).where((F.col("__u") >= limits[0]) & (F.col("rep") < reps))
    return spread.withColumn("c", count).drop("__u")


def check_bootstrap(reps: int, level: float) -> None:
    require(reps >= 2, "need at least 2 replicates")
    require(0 < level < 1, f"level must be in (0, 1), got {level}")


def percentile_interval(values: DataFrame, by: Sequence[str], level: float = 0.95, value: str = "value") -> DataFrame:
    """Percentile interval over replicates; NULL replicates are skipped.

    A group holds one value per replicate, so its size is the ``reps`` parameter.
    """
    require(0 < level < 1, f"level must be in (0, 1), got {level}")
    tail = (1 - level) / 2
    return values.groupBy(*by).agg(
        F.percentile(value, F.lit(tail)).alias("ci_low"), F.percentile(value, F.lit(1 - tail)).alias("ci_high"),
        F.count(value).alias("reps"),
    )


def point_and_interval(values: DataFrame, by: Sequence[str], level: float = 0.95) -> DataFrame:
    """Estimate (replicate -1) and percentile interval (the others) in one aggregation."""
    tail = (1 - level) / 2
    boot = F.when(F.col("rep") != POINT, F.col("value"))
    return values.groupBy(*by).agg(
        F.max(F.when(F.col("rep") == POINT, F.col("value"))).alias("estimate"),
        F.percentile(boot, F.lit(tail)).alias("ci_low"), F.percentile(boot, F.lit(1 - tail)).alias("ci_high"),
        F.count(boot).alias("reps"),
    )


def with_draws(df: DataFrame, draws: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows with replicate weights ``c``: the drawn rows, and every row once as replicate -1."""
    point = df.withColumn("rep", F.lit(POINT)).withColumn("c", F.lit(1).cast("bigint"))
    drawn = df.join(draws, row_id)
    return drawn.unionByName(point)


def bootstrap_ci(
    df: DataFrame, statistic: Callable[[DataFrame, list[str]], DataFrame], by: Sequence[str], reps: int, seed: object,
    level: float = 0.95, strata: Sequence[str] = (), row_id: str = "row_id", poisson: bool = False,
) -> DataFrame:
    """Estimate and percentile interval of ``statistic(weighted rows, ["rep"]) -> rep, by, value``.

    ``poisson`` takes Poisson counts for draws inside strata and marks the result ``approximate``.
    """
    check_bootstrap(reps, level)
    if poisson:
        require(not strata, "Poisson replicates have no strata")
        values = statistic(poisson_draws(df, reps, seed, row_id), ["rep"])
        return point_and_interval(values, by, level).withColumn("approximate", F.lit(True))
    ids = df.select(row_id, *strata).distinct()
    draws = bootstrap_draws(ids, strata, reps, seed, row_id)
    values = statistic(with_draws(df, draws, row_id), ["rep"])
    return point_and_interval(values, by, level)


def importance_ci(attr: DataFrame, reps: int, seed: object, level: float = 0.95) -> DataFrame:
    """Mean absolute attribution per feature with its interval over resampled rows."""
    def statistic(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by, "feature").agg((F.sum(F.col("c") * F.abs("value")) / F.sum("c")).alias("value"))

    return bootstrap_ci(attr.select("row_id", "feature", "value"), statistic, ["feature"], reps, seed, level)


def bootstrap_scope_ap(df: DataFrame, draws: DataFrame, by: Sequence[str], group: str = "grp", row_id: str = "row_id") -> DataFrame:
    """``by, rep, scope, ap`` for replicates and the point (rep -1); all arms share the draws."""
    weighted = with_draws(df, draws, row_id)
    return M.scope_ap(weighted, [*by, "rep"], group, weight=F.col("c"))


def poisson_scope_ap(df: DataFrame, reps: int, seed: object, by: Sequence[str], group: str = "grp", row_id: str = "row_id") -> DataFrame:
    """:func:`bootstrap_scope_ap` with Poisson counts: replicates are summed into (replicate, group, score) cells where the rows are."""
    return M.scope_ap(poisson_draws(df, reps, seed, row_id), [*by, "rep"], group, weight=F.col("c"))


def metric_replicates(
    df: DataFrame, reps: int, seed: object, group: str = "grp", poisson: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(seed-mean replicates, per-seed points) of every derived metric, per arm.

    ``df`` has ``arm, seed, row_id, grp, y, score``. The first table has
    ``arm, rep, metric, value`` with rep -1 for the point. Arms and seeds share a
    row's draws; ``poisson`` takes Poisson counts for them (approximate, see there).
    """
    rows = df.select("row_id", group, "y").distinct()
    if poisson:
        values = poisson_scope_ap(df, reps, seed, ["arm", "seed"], group)
    else:
        values = bootstrap_scope_ap(df, bootstrap_draws(rows, [group, "y"], reps, seed), ["arm", "seed"], group)
    # arms x seeds x replicates x scopes rows: small, and read several times below
    scoped = cut(values)
    prev = M.prevalence(rows, group)

    def named(derived: DataFrame, by: list[str]) -> DataFrame:
        per_group = F.col("metric").isin("P_c", "Ex_c", "L_c")
        name = F.when(per_group, F.concat(F.regexp_replace("metric", "c$", ""), F.col("scope"))).otherwise(F.col("metric"))
        return derived.select(*by, name.alias("metric"), "value")

    means = scoped.groupBy("arm", "rep", "scope").agg(F.avg("ap").alias("ap"))
    replicates = named(M.derived_metrics(means, prev, ["arm", "rep"]), ["arm", "rep"])
    points = scoped.where(F.col("rep") == POINT).drop("rep")
    per_seed = named(M.derived_metrics(points, prev, ["arm", "seed"]), ["arm", "seed"])
    return replicates, per_seed


def spec_table(spark: SparkSession, specs: Sequence[tuple[str, str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """``(family, a, others, metric, b)`` rows from registered comparisons ``(family, a, [b...], [metric...])``."""
    rows = [(f, a, " or ".join(bs), m, b) for f, a, bs, ms in specs for m in ms for b in bs]
    return spark.createDataFrame(rows, "family string, a string, b_label string, metric string, b string")


def paired(replicates: DataFrame, per_seed: DataFrame, specs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """a minus b, or minus the better of several b inside each replicate and seed.

    Adds the 95% interval, the sample SD over seeds and one- and two-sided
    p-values. ``extra`` are further key columns both tables share.
    """
    keys = [*extra, "family", "a", "b_label", "metric"]

    def differences(values: DataFrame, index: str) -> DataFrame:
        left = values.select(*extra, F.col("arm").alias("a"), "metric", index, F.col("value").alias("__a"))
        right = values.select(*extra, F.col("arm").alias("b"), "metric", index, F.col("value").alias("__b"))
        joined = specs.join(left, [*extra, "a", "metric"]).join(right, [*extra, "b", "metric", index])
        best = joined.groupBy(*keys, index).agg(F.first("__a").alias("__a"), F.max("__b").alias("__b"))
        return best.select(*keys, index, (F.col("__a") - F.col("__b")).alias("d"))

    boot = differences(replicates, "rep")
    d = F.when(F.col("rep") != POINT, F.col("d"))
    below, above = F.avg((d <= 0).cast("double")), F.avg((d >= 0).cast("double"))
    summary = boot.groupBy(*keys).agg(
        F.max(F.when(F.col("rep") == POINT, F.col("d"))).alias("difference"),
        F.percentile(d, F.lit(0.025)).alias("ci_low"), F.percentile(d, F.lit(0.975)).alias("ci_high"),
        F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p_two_sided"), below.alias("p_greater"),
    )
    spread = differences(per_seed, "seed").groupBy(*keys).agg(F.stddev_samp("d").alias("seed_sd"))
    return null_safe_join(summary, spread, keys, "left").withColumnRenamed("b_label", "b")


def holm(df: DataFrame, p: str, family: Sequence[str], out: str = "p_holm", tie: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values inside a family of comparisons."""
    ordered = Window.partitionBy(*family).orderBy(p, *tie)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (size - F.row_number().over(ordered) + 1) * F.col(p))
    running = F.max("__step").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__step", step).withColumn(out, running).drop("__step")


def comparison_table(replicates: DataFrame, per_seed: DataFrame, specs: DataFrame) -> DataFrame:
    """All comparisons whose arms exist, Holm-adjusted (two-sided) per family; the rest are listed as missing."""
    arms = replicates.select("arm").distinct()
    needed = specs.select("family", "a", "b_label", F.col("a").alias("arm")).union(specs.select("family", "a", "b_label", "b"))
    lacking = needed.distinct().join(arms, "arm", "left_anti").groupBy("family", "a", "b_label").agg(
        F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("missing_arms")
    )
    complete = specs.join(lacking, ["family", "a", "b_label"], "left_anti")
    done = holm(paired(replicates, per_seed, complete), "p_two_sided", ["family"], tie=["a", "b", "metric"])
    absent = specs.join(lacking, ["family", "a", "b_label"]).select(
        "family", "a", F.col("b_label").alias("b"), "metric", "missing_arms"
    ).distinct()
    return done.withColumn("missing_arms", F.lit(None).cast("string")).unionByName(absent, allowMissingColumns=True)


def transfer_pairs(replicates: DataFrame, per_seed: DataFrame) -> DataFrame:
    """All method pairs per held-out group with Holm inside the group.

    Inputs have ``held_out, arm, rep|seed, metric, value``; pairs run over the
    arms (a handful), never over rows.
    """
    arms = replicates.select("held_out", "arm").distinct()
    right = arms.withColumnRenamed("arm", "b")
    pairs = arms.withColumnRenamed("arm", "a").join(right, "held_out").where("a < b")
    specs = pairs.select("held_out", F.lit("transfer").alias("family"), "a", F.col("b").alias("b_label"), F.lit("P").alias("metric"), "b")
    compared = paired(replicates, per_seed, specs, extra=["held_out"])
    return holm(compared, "p_two_sided", ["held_out"], tie=["a", "b"])


def consistency(pairs: DataFrame, points: DataFrame, wins_needed: int = 3, alpha: float = 0.05) -> DataFrame:
    """Methods that clearly win in enough held-out groups and are never clearly beaten.

    ``points`` has ``held_out, arm, value``. A clear win: best point value and
    every comparison significantly positive.
    """
    both = pairs.select("held_out", F.col("a").alias("arm"), F.col("difference").alias("signed"), "p_holm").unionByName(
        pairs.select("held_out", F.col("b").alias("arm"), (-F.col("difference")).alias("signed"), "p_holm")
    )
    significant = F.col("p_holm") < alpha
    per_group = both.groupBy("held_out", "arm").agg(
        F.bool_and(significant & (F.col("signed") > 0)).alias("beats_all"),
        F.bool_or(significant & (F.col("signed") < 0)).alias("beaten"),
    )
    best = points.groupBy("held_out").agg(F.max_by("arm", F.struct("value", F.col("arm"))).alias("best"))
    joined = points.select("held_out", "arm").join(best, "held_out").join(per_group, ["held_out", "arm"], "left")
    win = (F.col("best") == F.col("arm")) & F.coalesce("beats_all", F.lit(False))
    out = joined.groupBy("arm").agg(
        F.count(F.lit(1)).alias("held_out_groups"), F.count_if(win).alias("clear_wins"),
        F.coalesce(F.bool_or("beaten"), F.lit(False)).alias("ever_clearly_beaten"),
    )
    return out.withColumn("consistently_better", (F.col("clear_wins") >= wins_needed) & ~F.col("ever_clearly_beaten"))


def transfer_drop(within: DataFrame, held_out: DataFrame) -> DataFrame:
    """Drop from within-group to held-out AP per group and arm, with its interval.

    Both inputs have ``held_out, arm, rep, value`` with rep -1 for the point.
    """
    keys = ["held_out", "arm"]
    joined = within.select(*keys, "rep", F.col("value").alias("__w")).join(
        held_out.select(*keys, "rep", F.col("value").alias("__h")), [*keys, "rep"]
    )
    d = F.col("__w") - F.col("__h")
    point, boot = F.col("rep") == POINT, F.when(F.col("rep") != POINT, d)
    return joined.groupBy(*keys).agg(
        F.max(F.when(point, F.col("__w"))).alias("within"), F.max(F.when(point, F.col("__h"))).alias("held_out_ap"),
        F.max(F.when(point, d)).alias("drop"),
        F.percentile(boot, F.lit(0.025)).alias("ci_low"), F.percentile(boot, F.lit(0.975)).alias("ci_high"),
    )


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t for an integer number of degrees of freedom.

    Finite trigonometric series of the distribution function (public handbooks
    of mathematical functions list it).
    """
    theta = F.atan(F.abs(t) / F.sqrt(dof))
    cos2 = F.cos(theta) * F.cos(theta)
    odd = dof % 2 == 1
    terms = F.when(odd, (dof - 1) / 2).otherwise(dof / 2).cast("int")
    # term_i / term_{i-1} is cos^2 * 2i/(2i+1) (odd) or cos^2 * (2i-1)/(2i) (even)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        ratio = F.when(odd, 2 * i / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i)) * cos2
        return F.struct((acc["term"] * ratio).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    series = F.when(terms >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step)["sum"]).otherwise(0.0)
    inside = F.when(odd, 2 / F.lit(3.141592653589793) * (theta + F.sin(theta) * F.cos(theta) * series)).otherwise(F.sin(theta) * series)
    return F.greatest(F.lit(0.0), 1 - inside)


def paired_tests(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paired t and Wilcoxon signed-rank over aligned fold scores (``keys``, ``value``).

    The Wilcoxon p-value is exact for any number of pairs, ties included: a
    recurrence counts the sign patterns by their rank sum.
    """
    joined = a.select(*keys, F.col("value").alias("__a")).join(b.select(*keys, F.col("value").alias("__b")), list(keys))
    diffs = joined.select((F.col("__a") - F.col("__b")).alias("d"))
    packed = diffs.agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"),
        F.array_sort(F.collect_list(F.when(F.col("d") != 0, F.col("d")))).alias("ds"),
    )
    ranks = A.average_ranks(F.transform("ds", lambda x: F.round(F.abs(x), 12)))
    table = packed.withColumn("t_statistic", safe_ratio(F.col("m"), F.col("s") / F.sqrt("n"))).withColumn("ranks", ranks)
    table = table.withColumn("t_p_value", t_two_sided_p(F.col("t_statistic"), F.col("n") - 1))
    plus = F.aggregate(F.zip_with("ds", "ranks", lambda x, r: F.when(x > 0, r).otherwise(F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
    total = F.aggregate("ranks", F.lit(0.0), lambda acc, x: acc + x)
    table = table.withColumn("w_plus", plus).withColumn("w_total", total).withColumn("k", F.size("ds"))
    table = table.withColumn("wilcoxon_statistic", F.least(F.col("w_plus"), F.col("w_total") - F.col("w_plus")))
    # Of the 2^k sign patterns, how many have each sum of (doubled, so whole) ranks: a rank r adds the counts r places down.
    doubled = F.transform("ranks", lambda r: F.round(2 * r).cast("int"))
    size = F.round(2 * F.col("w_total")).cast("int")
    none = F.transform(F.sequence(F.lit(0), size), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(doubled, none, lambda acc, r: F.transform(acc, lambda x, i: x + F.when(i >= r, F.get(acc, i - r)).otherwise(0.0)))
    low = F.slice(counts, F.lit(1), F.round(2 * F.col("wilcoxon_statistic")).cast("int") + 1)
    extreme = F.aggregate(low, F.lit(0.0), lambda acc, x: acc + x)
    table = table.withColumn("wilcoxon_p_value", F.least(F.lit(1.0), 2 * extreme / F.pow(F.lit(2.0), F.col("k"))))
    return table.select("n", "t_statistic", "t_p_value", "wilcoxon_statistic", "wilcoxon_p_value")


def disagreement(a: Column, b: Column) -> dict[str, Column]:
    """1 - Spearman, 1 - Kendall and 1 - top-3 overlap of two importance arrays."""
    return {
        "spearman": 1 - A.pearson(A.average_ranks(a), A.average_ranks(b)),
        "kendall": 1 - A.kendall_tau_b(a, b),
        "top3": 1 - A.top_k_overlap(a, b, 3),
    }


def _importance_arrays(drawn: DataFrame, by: Sequence[str]) -> DataFrame:
    means = drawn.groupBy(*by, "feature").agg(F.avg(F.abs("value")).alias("v"))
    packed = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("feature", "v"))).alias("fs"))
    return packed.select(*by, F.transform("fs", lambda f: f["v"]).alias("imp"))


def _halves(rows: DataFrame, by: Sequence[str], size: int, reps: int, seed: object) -> DataFrame:
    spread = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    ranked = hash_rank(spread, seed, "row_id", ["rep", *by], rank="__r", size=None, salt=["rep"])
    return ranked.where(F.col("__r") <= 2 * size).withColumn("half", (F.col("__r") > size).cast("int")).drop("__r")


def _measures(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    ms = disagreement(F.col(a), F.col(b))
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("d")) for n, c in ms.items()])))


def _net_interval(cross: DataFrame, noise: DataFrame) -> DataFrame:
    c = cross.groupBy("rep", "measure").agg(F.avg("d").alias("c"))
    n = noise.groupBy("rep", "measure").agg(F.avg("d").alias("n"))
    net = c.join(n, ["rep", "measure"]).select("measure", (F.col("c") - F.col("n")).alias("v"))
    return net.groupBy("measure").agg(
        F.avg("v").alias("mean"), F.percentile("v", F.lit(0.025)).alias("ci_low"), F.percentile("v", F.lit(0.975)).alias("ci_high")
    )


def group_disagreement_beyond_noise(attr: DataFrame, size: int, reps: int, seed: object, group: str = "grp") -> DataFrame:
    """Cross-group ranking disagreement minus split-half noise, size-matched, over repeated draws."""
    rows = attr.select("row_id", group).distinct()
    halves = _halves(rows, [group], size, reps, seed)
    drawn = halves.join(attr.select("row_id", "feature", "value"), "row_id")
    imp = _importance_arrays(drawn, ["rep", group, "half"])
    first, second = imp.where("half = 0"), imp.where("half = 1")
    a = first.select("rep", F.col(group).alias("ga"), F.col("imp").alias("a"))
    b = first.select("rep", F.col(group).alias("gb"), F.col("imp").alias("b"))
    cross = _measures(a.join(b, "rep").where("ga < gb"), ["rep"], "a", "b")
    split = first.select("rep", group, F.col("imp").alias("a")).join(second.select("rep", group, F.col("imp").alias("b")), ["rep", group])
    return _net_interval(cross, _measures(split, ["rep"], "a", "b"))


def model_disagreement_beyond_noise(a: DataFrame, b: DataFrame, size: int, reps: int, seed: object) -> DataFrame:
    """Two models' ranking disagreement on the same rows minus each model's split-half noise."""
    common = a.select("row_id").distinct().join(b.select("row_id").distinct(), "row_id", "left_semi")
    halves = _halves(common, [], size, reps, seed)
    both = a.select(F.lit("a").alias("model"), "row_id", "feature", "value").unionByName(
        b.select(F.lit("b").alias("model"), "row_id", "feature", "value")
    )
    imp = _importance_arrays(halves.join(both, "row_id"), ["rep", "model", "half"])

    def side(model: str, half: int, name: str) -> DataFrame:
        return imp.where((F.col("model") == model) & (F.col("half") == half)).select("rep", F.col("imp").alias(name))

    between = _measures(side("a", 0, "a").join(side("b", 0, "b"), "rep"), ["rep"], "a", "b")
    noise = _measures(side("a", 0, "a").join(side("a", 1, "b"), "rep"), ["rep"], "a", "b").unionByName(
        _measures(side("b", 0, "a").join(side("b", 1, "b"), "rep"), ["rep"], "a", "b")
    )
    return _net_interval(between, noise)


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation with average ranks over any number of rows.

    Rows are reduced to distinct (a, b) pairs with counts; ranks come from
    prefix sums over distinct values.
    """
    by = list(by)
    present = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = present.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("__c"))

    def rank_of(column: str, name: str) -> DataFrame:
        cells = running_totals(pairs, column, {"__w": F.col("__c")}, by=by)
        return cells.select(*by, column, (F.col("__w_cum") - F.col("__w") + (F.col("__w") + 1) / 2).alias(name))

    joined = null_safe_join(null_safe_join(pairs, rank_of(a, "__ra"), [*by, a]), rank_of(b, "__rb"), [*by, b])
    c, x, y = F.col("__c"), F.col("__ra"), F.col("__rb")
    n = F.sum(c)
    mean = (n + 1) / 2  # average ranks always have this mean
    moments = joined.groupBy(*by).agg(
        n.alias("n"),
        F.sum(c * x * y).alias("sxy"), F.sum(c * x * x).alias("sxx"), F.sum(c * y * y).alias("syy"), mean.alias("m"),
    )
    n_, m = F.col("n"), F.col("m")
    cov = F.col("sxy") - n_ * m * m
    vx, vy = F.col("sxx") - n_ * m * m, F.col("syy") - n_ * m * m
    return moments.select(*by, "n", F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("rho"))


def kendall(df: DataFrame, item: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Kendall's tau-b over a short list of items per group (features, methods)."""
    packed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(item, a, b))).alias("z"))
    return packed.select(*by, A.kendall_tau_b(F.transform("z", lambda s: s[a]), F.transform("z", lambda s: s[b])).alias("tau"))
