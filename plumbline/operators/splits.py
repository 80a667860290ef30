"""Folds, holdouts and samples drawn by seeded hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import hash_int, hash_key
from plumbline.functions.ordering import exact_quantiles, first_n, hash_rank, null_safe_join
from plumbline.operators.encode import stratify_key
from plumbline.roles import require


SAMPLE_DIGITS = 4  # hex digits of a hash key that are counted: 16^4 buckets


def stratified_folds(
    df: DataFrame, strata: Sequence[str], k: int, seed: object, row_id: str = "row_id", fold: str = "fold"
) -> DataFrame:
    """Every row in one of ``k`` folds; each stratum is spread to within one row."""
    require(k >= 2, "k must be at least 2")
    ranked = hash_rank(df, seed, row_id, strata, rank="__rank", size=None)
    return ranked.withColumn(fold, ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


def nested_folds(
    df: DataFrame, strata: Sequence[str], outer: int, inner: int, seed: object, row_id: str = "row_id"
) -> DataFrame:
    """One row per (row, outer fold it trains in) with its ``inner_fold`` there."""
    folded = stratified_folds(df, strata, outer, seed, row_id, "own_fold")
    spread = folded.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    training = spread.where(F.col("outer_fold") != F.col("own_fold"))
    ranked = hash_rank(training, f"{seed}-inner", row_id, ["outer_fold", *strata], rank="__rank", size=None, salt=["outer_fold"])
    return ranked.withColumn("inner_fold", ((F.col("__rank") - 1) % inner).cast("int")).drop("__rank", "own_fold")


def leave_one_group_out(df: DataFrame, group: str, out: str = "held_out") -> DataFrame:
    """Each row once, with the one split that validates it: its group. It trains in all others.

    A split is a filter on this column (:func:`held_out_split`), so rows aren't copied per group.
    """
    return df.withColumn(out, F.col(group))


def held_out_split(df: DataFrame, held_out: object, column: str = "held_out") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of one group's split; rows without a group train in every split."""
    own = F.col(column).eqNullSafe(F.lit(held_out))
    return df.where(~own), df.where(own)


def split_sizes(df: DataFrame, column: str = "held_out") -> DataFrame:
    """``(held_out, train_rows, val_rows)`` of every group's split."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("val_rows"))
    total = sizes.agg(F.sum("val_rows").alias("n")).scalar()
    return sizes.where(F.col(column).isNotNull()).select(column, (total - F.col("val_rows")).alias("train_rows"), "val_rows")


def stratified_holdout(
    df: DataFrame, fraction: float, strata: Sequence[str], seed: object, row_id: str = "row_id"
) -> DataFrame:
    """Mark ``is_holdout`` for ``round(fraction * n)`` rows of each stratum."""
    require(0 < fraction < 1, "fraction must be in (0, 1)")
    ranked = hash_rank(df, seed, row_id, strata, rank="__rank", size="__n")
    quota = F.floor(F.col("__n") * F.lit(fraction) + 0.5)
    return ranked.withColumn("is_holdout", F.col("__rank") <= quota).drop("__rank", "__n")


def quotas(counts: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Largest-remainder shares of ``n`` over strata; ties go to the first key.

    ``counts`` has one row per stratum (column ``n``); raises unless 0 < n < pool.
    """
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    exact = F.col("n") * F.lit(int(n)) / F.col("__total")
    checked = counts.withColumn("__total", total).withColumn(
        "__total",
        F.when((F.lit(int(n)) > 0) & (F.lit(int(n)) < F.col("__total")), F.col("__total")).otherwise(
            F.raise_error(F.concat(F.lit(f"cannot draw {n} rows from a pool of "), F.col("__total").cast("string"))).cast("bigint")
        ),
    )
    floored = checked.withColumn("__floor", F.floor(exact)).withColumn("__rest", F.round(exact - F.floor(exact), 9))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__rest"), *keys))
    spare = F.lit(int(n)) - F.sum("__floor").over(Window.partitionBy(F.lit(0)))
    out = floored.withColumn("__rk", rank).withColumn("__spare", spare)
    return out.select(*keys, (F.col("__floor") + (F.col("__rk") <= F.col("__spare")).cast("bigint")).cast("bigint").alias("quota"))


def stratified_sample(
    df: DataFrame, n: int, strata: Sequence[str], seed: object, exclude: DataFrame | None = None, row_id: str = "row_id"
) -> DataFrame:
    """Exactly ``n`` rows, proportional per stratum, after removing the excluded rows."""
    pool = df if exclude is None else df.join(exclude.select(row_id), row_id, "left_anti")
    counts = pool.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    shares = quotas(counts, list(strata), n)
    ranked = hash_rank(pool, seed, row_id, strata, rank="__rank", size=None)
    joined = null_safe_join(ranked, shares, list(strata))
    return joined.where(F.col("__rank") <= F.col("quota")).drop("__rank", "quota")


def build_sample_sets(
    df: DataFrame, background: int, explanation: int, focus: str, seed: object,
    group: str = "grp", target: str = "y", row_id: str = "row_id",
) -> DataFrame:
    """Long ``(set_name, row_id)``: background, pooled (disjoint from it), focus and explanation = pooled or focus."""
    strata = [group, target]
    rows = df.select(row_id, *strata)
    back = stratified_sample(rows, background, strata, f"{seed}-background", row_id=row_id)
    pooled = stratified_sample(rows, explanation, strata, f"{seed}-pooled", exclude=back, row_id=row_id)
    focused = rows.where(F.col(group) == focus)
    explained = pooled.select(row_id).union(focused.select(row_id)).distinct()

    def named(part: DataFrame, name: str) -> DataFrame:
        return part.select(F.lit(name).alias("set_name"), row_id)

    return (
        named(back, "background")
        .unionByName(named(pooled, "pooled"))
        .unionByName(named(focused, "focus"))
        .unionByName(named(explained, "explanation"))
    )


def fraction_per_stratum(df: DataFrame, fraction: float, strata: Sequence[str], seed: object, row_id: str = "row_id") -> DataFrame:
    """``round(fraction * n)`` rows of every stratum."""
    require(0 < fraction <= 1, "fraction must be in (0, 1]")
    ranked = hash_rank(df, seed, row_id, strata, rank="__rank", size="__n")
    return ranked.where(F.col("__rank") <= F.floor(F.col("__n") * F.lit(fraction) + 0.5)).drop("__rank", "__n")


def sample_n(df: DataFrame, n: int, seed: object, row_id: str = "row_id", digits: int = SAMPLE_DIGITS) -> DataFrame:
    """Uniform sample without replacement: the ``n`` smallest hash keys, found by a threshold from counted key prefixes."""
    keyed = df.withColumn("__h", hash_key(seed, row_id))
    return first_n(keyed, n, F.substring("__h", 1, digits), ["__h", row_id]).drop("__h")


def sample_with_replacement(df: DataFrame, n: int, seed: object, row_id: str = "row_id") -> DataFrame:
    """``n`` draws (column ``draw``, 0..n-1) from the pool; a row may appear several times."""
    require(n > 0, "n must be positive")
    ranked = hash_rank(df, f"{seed}-pool", row_id, (), rank="__rank", size=None)
    size = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = df.sparkSession.range(n).withColumn("__n", size)
    hits = draws.select(F.col("id").alias("draw"), (hash_int(seed, "id") % F.col("__n") + 1).alias("__rank"))
    return hits.join(ranked, "__rank").drop("__rank")


def fold_size_audit(
    df: DataFrame, seeds: Sequence[int], outer: int, inner: int, group: str = "grp", target: str = "y", row_id: str = "row_id"
) -> DataFrame:
    """Sizes and positives of every outer, inner and held-out-group validation part."""
    rows = df.select(row_id, group, target)
    n_rows = F.col("n_rows")
    parts: list[DataFrame] = []
    for seed in seeds:
        folded = stratified_folds(rows, [group, target], outer, f"audit-{seed}", row_id)
        per_fold = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("test_rows"), F.sum(target).alias("test_positives"))
        total = F.sum("test_rows").over(Window.partitionBy(F.lit(0)))
        parts.append(per_fold.select(
            F.lit("nested_cv_outer").alias("design"), F.lit(str(seed)).alias("seed"), F.col("fold").cast("string").alias("fold"),
            (total - F.col("test_rows")).alias("train_rows"), "test_rows", F.col("test_positives").cast("bigint").alias("test_positives"),
        ))
        nested = nested_folds(rows, [group, target], outer, inner, f"audit-{seed}", row_id)
        per_inner = nested.groupBy("outer_fold", "inner_fold").agg(F.count(F.lit(1)).alias("test_rows"), F.sum(target).alias("test_positives"))
        inner_total = F.sum("test_rows").over(Window.partitionBy("outer_fold"))
        parts.append(per_inner.select(
            F.lit("nested_cv_inner").alias("design"), F.lit(str(seed)).alias("seed"),
            F.concat_ws(".", F.col("outer_fold").cast("string"), F.col("inner_fold").cast("string")).alias("fold"),
            (inner_total - F.col("test_rows")).alias("train_rows"), "test_rows", F.col("test_positives").cast("bigint").alias("test_positives"),
        ))
    per_group = rows.groupBy(group).agg(F.count(F.lit(1)).alias("test_rows"), F.sum(target).alias("test_positives"))
    everything = F.sum("test_rows").over(Window.partitionBy(F.lit(0)))
    parts.append(per_group.select(
        F.lit("leave_one_group_out").alias("design"), F.lit("n/a").alias("seed"), F.col(group).cast("string").alias("fold"),
        (everything - F.col("test_rows")).alias("train_rows"), "test_rows", F.col("test_positives").cast("bigint").alias("test_positives"),
    ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_size_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("design").agg(
        F.count(F.lit(1)).alias("folds"),
        F.min("train_rows").alias("min_train_rows"),
        F.max("train_rows").alias("max_train_rows"),
        F.min("test_positives").alias("min_test_positives"),
    )


def composition(df: DataFrame, selection: DataFrame, group: str = "grp", target: str = "y", row_id: str = "row_id") -> DataFrame:
    """Row counts per group x target level of a selection; absent cells are 0."""
    chosen = df.join(selection.select(row_id).distinct(), row_id, "left_semi")
    counts = chosen.groupBy(group, target).agg(F.count(F.lit(1)).alias("n"))
    targets = counts.agg(F.collect_set(target).alias("t")).scalar()
    cells = counts.select(group).distinct().withColumn("__t", targets).withColumn(target, F.explode("__t")).drop("__t")
    return cells.join(counts, [group, target], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def random_rankings(rows: DataFrame, features: Sequence[str], permutations: int, seed: object, row_id: str = "row_id") -> DataFrame:
    """Random feature order per row and permutation: ``(perm, row_id, feature, rank)``.

    Each row sorts its own short feature list, so nothing is shuffled.
    """
    names = F.array(*[F.lit(f) for f in features])
    spread = rows.select(row_id, F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"))
    keyed = F.array_sort(F.transform(names, lambda f: F.struct(hash_key(seed, F.col("perm"), F.col(row_id), f).alias("h"), f.alias("f"))))
    ordered = spread.select("perm", row_id, F.posexplode(keyed).alias("p", "s"))
    return ordered.select("perm", row_id, F.col("s.f").alias("feature"), (F.col("p") + 1).alias("rank"))


def pick_examples(
    candidates: DataFrame, focus: DataFrame, threshold: float, score: str = "score", target: str = "y", row_id: str = "row_id"
) -> DataFrame:
    """Five rule-chosen rows: the extreme of each confusion cell, and the focus row nearest the focus median.

    Ties go to the lowest row id; a rule without any row raises.
    """
    actual, predicted = F.col(target) == 1, F.col(score) >= F.lit(threshold)
    s, rid = F.col(score), F.col(row_id)

    def extreme(mask: Column, highest: bool) -> Column:
        return F.min_by(F.when(mask, rid), F.when(mask, F.struct((-s if highest else s).alias("s"), rid.alias("i"))))

    rules = {
        "confident_tp": extreme(actual & predicted, True),
        "confident_tn": extreme(~actual & ~predicted, False),
        "false_negative": extreme(actual & ~predicted, False),
        "false_positive": extreme(~actual & predicted, True),
    }
    chosen = candidates.agg(*[c.alias(n) for n, c in rules.items()])
    median = exact_quantiles(focus, score, {"m": 0.5}).select("m").scalar()
    typical = focus.withColumn("__m", median).agg(F.min_by(rid, F.struct(F.abs(s - F.col("__m")).alias("d"), rid.alias("i"))).alias("row_id"))

    def present(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"no row satisfies the rule {name}")).cast("bigint"))

    listed = F.array(*[F.struct(F.lit(n).alias("rule"), present(n).alias("row_id")) for n in rules])
    four = chosen.select(F.inline(listed))
    return four.unionByName(typical.select(F.lit("focus_typical").alias("rule"), "row_id"))
