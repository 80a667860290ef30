"""Exact Shapley values, interactions, ablation and removal curves.

A model is a function of a list of columns, ``predict([x0, ..., xM-1])``. A row's
coalitions are means over a reference distribution: rows meet the reference in
blocks of points, and the outputs are summed by row in generated code, a block of
coalitions as columns of one aggregate. The hybrid rows exist only inside a task,
what is shuffled are partial sums; neither rows nor reference have a size limit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.contracts import ContractError
from plumbline.roles import require

Predict = Callable[[list[Column]], Column]

MAX_PLAYERS = 16
REFERENCE_BLOCK = 500  # distinct reference points a row meets at once
WIDE_BITS = 4  # 2^4 coalitions are columns of one aggregate, the other bits are rows


def single_point(point: DataFrame, features: Sequence[str]) -> Column:
    """The only row's features as one struct x0, x1, ...; more or fewer rows raise."""
    packed = F.struct(*[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)])
    size = F.count(F.lit(1))
    only = F.when(size == 1, F.max(packed)).otherwise(F.raise_error(F.concat(F.lit("needs exactly one reference row, got "), size.cast("string"))))
    return point.agg(only.alias("p")).scalar()


def _against_reference(df: DataFrame, row_id: str, features: Sequence[str], reference: DataFrame) -> tuple[DataFrame, list[Column], Column]:
    """Each row with every distinct reference point; the point's columns, and its share of the reference.

    Points form blocks by hash. Rows are sent to all blocks by an equi-join, salted by
    row: the keys spread the rows over as many tasks as a shuffle has partitions.
    """
    m = len(features)
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = reference.groupBy(*[F.col(f).cast("double").alias(f"__b{j}") for j, f in enumerate(features)]).agg(F.count(F.lit(1)).alias("__w"))
    size = F.count(F.lit(1))
    known = F.struct(F.ceil(size / REFERENCE_BLOCK).cast("int").alias("blocks"), F.sum("__w").cast("double").alias("total"))
    shape = points.agg(F.when(size >= 1, known).otherwise(F.raise_error(F.lit("a reference needs at least one point"))).alias("s")).scalar()
    numbered = points.withColumn("__block", F.pmod(F.xxhash64(*[f"__b{j}" for j in range(m)]), shape["blocks"]).cast("int"))
    packed = numbered.groupBy("__block").agg(
        F.collect_list(F.struct(*[f"__b{j}" for j in range(m)], (F.col("__w") / shape["total"]).alias("__w"))).alias("__points")
    ).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sent = df.withColumn("__salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")).withColumn(
        "__block", F.explode(F.sequence(F.lit(0), shape["blocks"] - 1))
    )
    met = sent.join(packed, ["__block", "__salt"], "left")  # outer, so that an empty reference raises above
    return met.select(*df.columns, F.inline_outer("__points")), [F.col(f"__b{j}") for j in range(m)], F.col("__w")


def _means(
    met: DataFrame, keys: Sequence[str], xs: Sequence[Column], bs: Sequence[Column], w: Column, predict: Predict, kept: Mapping[str, Sequence[Column | bool]]
) -> DataFrame:
    """``keys`` and for each name the mean output when feature j stays own where ``kept[name][j]``; NULL where any output is."""
    def mixed(x: Column, b: Column, keep: Column | bool) -> Column:
        return F.when(keep, x).otherwise(b) if isinstance(keep, Column) else x if keep else b

    def mean(keep: Sequence[Column | bool]) -> Column:
        output = predict([mixed(x, b, k) for x, b, k in zip(xs, bs, keep)])
        total = F.sum(w * F.coalesce(output.cast("double"), F.lit(float("nan"))))
        return F.when(~F.isnan(total), total)

    return met.groupBy(*keys).agg(*[mean(keep).alias(name) for name, keep in kept.items()])


def _bit(mask: Column, j: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << j)) != 0


def coalition_rows(df: DataFrame, features: Sequence[str], reference: DataFrame, predict: Predict, row_id: str = "row_id") -> DataFrame:
    """``(row_id, mask, v)``: the value of every coalition of every row, bit j of the mask for feature j. Row ids are unique."""
    m = len(features)
    require(1 <= m <= MAX_PLAYERS, f"exact coalitions need 1 to {MAX_PLAYERS} features, got {m}")
    low = min(m, WIDE_BITS)
    narrow = df.select(row_id, *[F.col(f).cast("double").alias(f"__x{j}") for j, f in enumerate(features)])
    met, bs, w = _against_reference(narrow, row_id, [*[f"__x{j}" for j in range(m)]], reference.select(*[F.col(f).alias(f"__x{j}") for j, f in enumerate(features)]))
    xs = [F.col(f"__x{j}") for j in range(m)]
    keys = [row_id]
    if m > low:
        met = met.withColumn("__high", F.explode(F.sequence(F.lit(0), F.lit((1 << (m - low)) - 1))))
        keys.append("__high")
    kept = {f"v{mask}": [bool(mask >> j & 1) if j < low else _bit(F.col("__high"), j - low) for j in range(m)] for mask in range(1 << low)}
    wide = _means(met, keys, xs, bs, w, predict, kept)
    high = F.col("__high") * (1 << low) if m > low else F.lit(0)
    cells = F.array(*[F.struct((high + mask).alias("mask"), F.col(f"v{mask}").alias("v")) for mask in range(1 << low)])
    return wide.select(row_id, F.inline(cells))


def coalition_values(df: DataFrame, features: Sequence[str], reference: DataFrame, predict: Predict, row_id: str = "row_id") -> DataFrame:
    """``(row_id, v)``: the value of every coalition, ``v[mask]`` with bit j for feature j."""
    rows = coalition_rows(df, features, reference, predict, row_id).groupBy(row_id)
    return rows.agg(F.array_sort(F.collect_list(F.struct("mask", "v"))).alias("v")).select(row_id, F.col("v.v").alias("v"))


def _literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _signed_sum(coefficient: Column) -> Column:
    """Sum over a row's coalitions; NULL when any value is."""
    return F.when(F.count("v") == F.count(F.lit(1)), F.sum(F.col("v") * coefficient))


def shapley_columns(m: int) -> list[Column]:
    """One aggregate per feature over a row's ``(mask, v)``: the weighted marginal sums."""
    mask, size = F.col("mask"), F.bit_count("mask")
    weights = _literal([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    return [_signed_sum(F.when(_bit(mask, j), F.get(weights, size - 1)).otherwise(-F.get(weights, size))) for j in range(m)]


def interaction_columns(m: int) -> dict[tuple[int, int], Column]:
    """Pairwise Shapley interaction index for i < j, each pair's effect split in halves."""
    mask = F.col("mask")
    weights = _literal([factorial(s) * factorial(m - s - 2) / (2 * factorial(m - 1)) for s in range(m - 1)])

    def phi(i: int, j: int) -> Column:
        inside = _bit(mask, i).cast("int") + _bit(mask, j).cast("int")
        weight = F.get(weights, F.bit_count(mask) - inside)
        return _signed_sum(F.when(inside == 1, -weight).otherwise(weight))

    return {(i, j): phi(i, j) for i in range(m) for j in range(i + 1, m)}


def _long(df: DataFrame, ids: Sequence[str], features: Sequence[str], columns: Sequence[Column], value: str = "value") -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), c.alias(value)) for f, c in zip(features, columns)])
    return df.select(*ids, F.inline(cells))


def exact_shapley(
    df: DataFrame, features: Sequence[str], reference: DataFrame, predict: Predict, row_id: str = "row_id"
) -> DataFrame:
    """``(row_id, base_value, feature, value)`` against a reference distribution."""
    m = len(features)
    valued = coalition_rows(df, features, reference, predict, row_id).groupBy(row_id).agg(
        F.max(F.when(F.col("mask") == 0, F.col("v"))).alias("base_value"), *[c.alias(f"s{j}") for j, c in enumerate(shapley_columns(m))]
    )
    return _long(valued, [row_id, "base_value"], features, [F.col(f"s{j}") for j in range(m)])


def point_shapley(df: DataFrame, features: Sequence[str], point: DataFrame, predict: Predict, row_id: str = "row_id") -> DataFrame:
    """Shapley values against one reference point; more than one row raises."""
    single = df.sparkSession.range(1).select(single_point(point, features).alias("p")).select(*[F.col(f"p.x{j}").alias(f) for j, f in enumerate(features)])
    return exact_shapley(df, features, single, predict, row_id)


def point_frame(baseline: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row of features from a ``(feature, value)`` baseline."""
    return baseline.groupBy().pivot("feature", list(features)).agg(F.first("value"))


def shapley_interactions(
    df: DataFrame, features: Sequence[str], reference: DataFrame, predict: Predict, row_id: str = "row_id"
) -> DataFrame:
    """``(row_id, feature_i, feature_j, value)``; the diagonal completes each row to its Shapley value."""
    m = len(features)
    named = coalition_rows(df, features, reference, predict, row_id).groupBy(row_id).agg(
        *[c.alias(f"p{i}_{j}") for (i, j), c in interaction_columns(m).items()], *[c.alias(f"s{j}") for j, c in enumerate(shapley_columns(m))]
    )

    def off(i: int, j: int) -> Column:
        return F.col(f"p{min(i, j)}_{max(i, j)}")

    cells = []
    for i in range(m):
        for j in range(m):
            value = off(i, j)
            if i == j:
                value = F.col(f"s{i}")
                for other in range(m):
                    if other != i:
                        value = value - off(i, other)
            cells.append(F.struct(F.lit(features[i]).alias("feature_i"), F.lit(features[j]).alias("feature_j"), value.alias("value")))
    return named.select(row_id, F.inline(F.array(*cells)))


def interaction_summary(interactions: DataFrame, shapley: DataFrame) -> DataFrame:
    """One row: off-diagonal share of absolute attribution and the largest row-sum error against Shapley values."""
    diagonal = F.col("feature_i") == F.col("feature_j")
    share = interactions.agg(
        (F.sum(F.when(~diagonal, F.abs("value"))) / F.sum(F.abs("value"))).alias("interaction_share"), F.countDistinct("row_id").alias("n")
    )
    sums = interactions.groupBy("row_id", F.col("feature_i").alias("feature")).agg(F.sum("value").alias("__sum"))
    error = sums.join(shapley.select("row_id", "feature", "value"), ["row_id", "feature"]).agg(
        F.max(F.abs(F.col("__sum") - F.col("value"))).alias("max_row_sum_error")
    )
    return share.withColumn("max_row_sum_error", error.scalar())


def top_pairs(interactions: DataFrame, k: int) -> DataFrame:
    """The ``k`` feature pairs with the largest mean absolute interaction."""
    pairs = interactions.where("feature_i < feature_j").groupBy("feature_i", "feature_j").agg(F.avg(F.abs("value")).alias("mean_abs"))
    return pairs.orderBy(F.desc("mean_abs"), "feature_i", "feature_j").limit(k)


def feature_ablation(df: DataFrame, features: Sequence[str], point: DataFrame, predict: Predict, row_id: str = "row_id") -> DataFrame:
    """f(x) minus f(x with one feature at the baseline), per feature."""
    xs = [F.col(f).cast("double") for f in features]
    with_ref = df.withColumn("__ref", single_point(point, features))
    base = F.col("__ref")
    full = predict(xs)

    def without(j: int) -> Column:
        return predict([base[f"x{i}"] if i == j else x for i, x in enumerate(xs)])

    changed = with_ref.select(
        row_id, predict([base[f"x{i}"] for i in range(len(xs))]).alias("base_value"),
        *[(full - without(j)).alias(f"__a{j}") for j in range(len(xs))],
    )
    return _long(changed, [row_id, "base_value"], features, [F.col(f"__a{j}") for j in range(len(xs))])


def efficiency_rows(attr: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per row: sum of attributions plus base value minus model output (``row_id, output``)."""
    sums = attr.groupBy("row_id").agg(F.sum("value").alias("__sum"), F.max("base_value").alias("__base"))
    return sums.join(outputs.select("row_id", "output"), "row_id").select(
        "row_id", "output", F.col("__base").alias("base_value"), (F.col("__sum") + F.col("__base") - F.col("output")).alias("residual")
    )


def non_additivity(attr: DataFrame, outputs: DataFrame) -> DataFrame:
    """Mean and largest gap between attributions plus base and the output."""
    return efficiency_rows(attr, outputs).agg(
        F.avg(F.abs("residual")).alias("mean_abs"), F.max(F.abs("residual")).alias("max_abs"),
        F.avg(F.abs(F.col("output") - F.col("base_value"))).alias("mean_abs_output_minus_base"),
    )


def check_efficiency(attr: DataFrame, outputs: DataFrame, atol: float, must_pass: bool = False) -> DataFrame:
    """Residual summary at an explicit tolerance; ``must_pass`` raises on a violation."""
    require(atol > 0, f"atol must be positive, got {atol}")
    r = F.abs("residual")
    report = efficiency_rows(attr, outputs).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(r), F.lit(0.0)).alias("max_abs_error"),
        F.coalesce(F.avg(r), F.lit(0.0)).alias("mean_abs_error"), F.count_if(r > atol).alias("n_violations"),
    )
    report = report.withColumn("passed", F.col("n_violations") == 0)
    if must_pass:
        row = report.first()
        if not row["passed"]:
            raise ContractError(f"attributions violate efficiency: {row.asDict()}")
    return report


def raw_feature(encoded: Column, categorical: Sequence[str], numeric: Sequence[str], derived: Mapping[str, str]) -> Column:
    """Raw feature of an encoded column; the longest matching prefix wins, an unmapped column fails the job."""
    expr = F.when(encoded.isin(list(numeric)), encoded) if numeric else F.when(F.lit(False), encoded)
    for name, parent in derived.items():
        expr = expr.when(encoded == name, F.lit(parent))
    for name in sorted(categorical, key=len, reverse=True):
        expr = expr.when(encoded.startswith(f"{name}_"), F.lit(name))
    return expr.otherwise(F.raise_error(F.concat(F.lit("encoded column belongs to no raw feature: "), encoded)).cast("string"))


def group_columns(
    attr: DataFrame, categorical: Sequence[str], numeric: Sequence[str], derived: Mapping[str, str] | None = None,
    keys: Sequence[str] = ("row_id",),
) -> DataFrame:
    """Sum encoded-column attributions to raw features. A raw feature without any column raises."""
    derived = dict(derived or {})
    unknown = sorted(set(derived.values()) - {*categorical, *numeric})
    if unknown:
        raise ContractError(f"derived columns have parents that are no features: {unknown}")
    named = attr.withColumn("feature", raw_feature(F.col("feature"), categorical, numeric, derived))
    wanted = sorted({*categorical, *numeric})
    lacking = F.array_except(F.array(*[F.lit(w) for w in wanted]), F.collect_set("feature"))
    checked = named.agg(
        F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("no encoded column maps to "), F.array_join(lacking, ", ")))).otherwise(F.lit(True)).alias("ok")
    ).scalar()
    return named.groupBy(*keys, "feature").agg(F.sum("value").alias("value")).where(checked)


def mean_abs_importance(attr: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return attr.groupBy(*by, "feature").agg(F.avg(F.abs("value")).alias("importance"))


def importance_share(importance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Importances as shares of their total; negative values or a zero total fail the job."""
    total = F.sum("importance").over(Window.partitionBy(*(by or [F.lit(0)])))
    low = F.min("importance").over(Window.partitionBy(*(by or [F.lit(0)])))
    share = F.when((total > 0) & (low >= 0), F.col("importance") / total).otherwise(
        F.raise_error(F.lit("importances must be non-negative with a positive total")).cast("double")
    )
    return importance.withColumn("share", share)


def rank_table(attr: DataFrame, method: str = "set_id", by: Sequence[str] = ()) -> DataFrame:
    """Rank (ties share the lowest) and share per method, mean rank over methods and top-3-everywhere flag."""
    shares = importance_share(mean_abs_importance(attr, [*by, method]), [*by, method])
    ranked = shares.withColumn("rank", F.rank().over(Window.partitionBy(*by, method).orderBy(F.desc("share"))))
    over = Window.partitionBy(*by, "feature")
    return ranked.withColumn("mean_rank", F.avg("rank").over(over)).withColumn("top3_everywhere", F.max("rank").over(over) <= 3)


def feature_ranks(attr: DataFrame, position: str | None = None, row_id: str = "row_id") -> DataFrame:
    """Rank 1..M of features per row by absolute value; ties go to the lower position.

    A window over one row's features: the group size is the feature count.
    """
    order = Window.partitionBy(row_id).orderBy(F.desc(F.abs("value")), position or "feature")
    return attr.withColumn("rank", F.row_number().over(order))


def removal_curves(
    df: DataFrame, features: Sequence[str], order: DataFrame, reference: DataFrame, predict: Predict,
    row_id: str = "row_id", keys: Sequence[str] = (),
) -> DataFrame:
    """``(keys, row_id, output, k, deletion, insertion)`` for k = 0..M.

    ``order`` is ``(keys, row_id, feature, rank)``. deletion[k] removes the top-k
    features, insertion[k] keeps only them.
    """
    m = len(features)
    ids = [*keys, row_id]
    ranks = order.groupBy(*ids).pivot("feature", list(features)).agg(F.max("rank"))
    narrow = df.select(row_id, *[F.col(f).cast("double").alias(f"__x{j}") for j, f in enumerate(features)]).join(
        ranks.select(*ids, *[F.col(f).alias(f"__r{j}") for j, f in enumerate(features)]), row_id
    )
    met, bs, w = _against_reference(
        narrow, row_id, [f"__x{j}" for j in range(m)], reference.select(*[F.col(f).alias(f"__x{j}") for j, f in enumerate(features)])
    )
    xs = [F.col(f"__x{j}") for j in range(m)]
    kept = {f"d{k}": [F.col(f"__r{j}") > k for j in range(m)] for k in range(m + 1)}
    kept |= {f"i{k}": [F.col(f"__r{j}") <= k for j in range(m)] for k in range(m + 1)}
    kept["output"] = [True] * m
    wide = _means(met, ids, xs, bs, w, predict, kept)
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"d{k}").alias("deletion"), F.col(f"i{k}").alias("insertion")) for k in range(m + 1)])
    return wide.select(*ids, "output", F.inline(cells))


def faithfulness_rows(curves: DataFrame, ks: Sequence[int] = (1, 3, 5), keys: Sequence[str] = (), row_id: str = "row_id") -> DataFrame:
    """Per row: deletion area, insertion gap, comprehensiveness and sufficiency at each k below M + 1.

    Long ``(keys, row_id, metric, value)``; NULL where k exceeds the features.
    """
    removed, kept = F.abs(F.col("output") - F.col("deletion")), F.abs(F.col("output") - F.col("insertion"))
    metrics = {"deletion_area": F.avg(removed), "insertion_gap": F.avg(kept)}
    for k in ks:
        metrics[f"comprehensiveness@{k}"] = F.max(F.when(F.col("k") == k, removed))
        metrics[f"sufficiency@{k}"] = F.max(F.when(F.col("k") == k, kept))
    wide = curves.groupBy(*keys, row_id).agg(*[c.alias(f"m{i}") for i, c in enumerate(metrics.values())])
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, n in enumerate(metrics)])
    return wide.select(*keys, row_id, F.inline(cells)).where(F.col("value").isNotNull())


def relative_changes(original: DataFrame, perturbed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per perturbed row: L1 change of the attribution relative to its own size; NULL for an all-zero row."""
    before = original.select("row_id", "feature", F.col("value").alias("__o"))
    joined = perturbed.join(before, ["row_id", "feature"])
    out = joined.groupBy("row_id", *keys).agg(
        F.sum(F.abs(F.col("value") - F.col("__o"))).alias("moved"), F.sum(F.abs("__o")).alias("size")
    )
    return out.select("row_id", *keys, F.when(F.col("size") > 0, F.col("moved") / F.col("size")).alias("change"))


def error_stats(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean and max absolute error, error relative to the mean absolute truth, and sign agreement, by feature and overall."""
    joined = estimate.select("row_id", "feature", F.col("value").alias("__e")).join(
        truth.select("row_id", "feature", F.col("value").alias("__t")), ["row_id", "feature"]
    )
    error = F.abs(F.col("__e") - F.col("__t"))
    out = joined.rollup("feature").agg(
        F.grouping("feature").alias("__g"), F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_abs_error"), F.max(error).alias("max_abs_error"),
        F.when(F.avg(F.abs("__t")) > 0, F.avg(error) / F.avg(F.abs("__t"))).alias("relative_error"),
        F.avg((F.signum("__e") == F.signum("__t")).cast("double")).alias("same_sign_share"),
    )
    return out.withColumn("feature", F.when(F.col("__g") == 1, "ALL").otherwise(F.col("feature"))).drop("__g")


def local_table(df: DataFrame, attr: DataFrame, features: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Field, value and contribution per row, ordered by absolute contribution (``rank``)."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("field_value")) for f in features])
    values = df.select(row_id, F.inline(cells))
    return feature_ranks(attr.join(values, [row_id, "feature"]), row_id=row_id)


def what_if(df: DataFrame, changes: Mapping[str, object], features: Sequence[str], reference: DataFrame, predict: Predict, row_id: str = "row_id") -> DataFrame:
    """Output and contributions before and after setting columns, for every row."""
    changed = df.withColumns({c: F.lit(v).cast("double") for c, v in changes.items()})

    def explained(part: DataFrame, tag: str) -> DataFrame:
        phi = exact_shapley(part, features, reference, predict, row_id)
        out = part.select(row_id, predict([F.col(f).cast("double") for f in features]).alias(f"output_{tag}"))
        return phi.select(row_id, "feature", F.col("value").alias(f"contribution_{tag}")).join(out, row_id)

    return explained(df, "before").join(explained(changed, "after"), [row_id, "feature"])


def compare_methods(attr: DataFrame, methods: Sequence[str], method: str = "set_id", row_id: str = "row_id") -> DataFrame:
    """One row per (row, feature) with the methods side by side."""
    return attr.groupBy(row_id, "feature").pivot(method, list(methods)).agg(F.first("value"))


def dependence_means(df: DataFrame, attr: DataFrame, feature: str, partner: str | None = None, row_id: str = "row_id") -> DataFrame:
    """Mean attribution of a feature per level, optionally inside each level of a partner."""
    keys = [feature, *([] if partner is None else [partner])]
    joined = attr.where(F.col("feature") == feature).select(row_id, "value").join(df.select(row_id, *keys), row_id)
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def vector_projection(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Centroid of each label on the first two principal components, with the share of variance explained."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    features = vectors.select(label, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(features)
    share = float(sum(model.explainedVariance.toArray()[:2]))
    points = model.transform(features).select(label, vector_to_array("pc").alias("pc"))
    return points.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.get("pc", 0)).alias("pc1"), F.avg(F.get("pc", 1)).alias("pc2"),
    ).withColumn("variance_share", F.lit(share))


def unit_concentration(vectors: DataFrame, vector: str = "embedding", top: int = 10) -> DataFrame:
    """One row: units, units never active, median active share per unit and the top units' share of mean absolute value."""
    units = vectors.select(F.posexplode(vector).alias("unit", "x")).groupBy("unit").agg(
        F.max(F.abs("x")).alias("peak"), F.avg(F.abs(F.col("x").cast("double"))).alias("size"), F.avg((F.col("x") > 0).cast("double")).alias("active"),
    )
    ranked = units.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "unit")))
    return ranked.agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("peak") == 0).alias("never_active"),
        F.percentile("active", F.lit(0.5)).alias("median_active_share"),
        (F.sum(F.when(F.col("r") <= top, F.col("size"))) / F.sum("size")).alias("top_share"),
    )
