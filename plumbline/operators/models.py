"""Model jobs on Spark ML: fits, cross-validation, tuning, ablation and group DRO.

A fit is a Spark job; the driver only decides which fits to run. Independent
fits overlap through a small thread pool. Prepared tables are checkpointed once
so that every fit reads the same written rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import exact_quantiles
from plumbline.functions.session import cut
from plumbline.operators import inference, metrics, profile, weights
from plumbline.operators.contracts import ContractError, finite_score_gate, reproduction_gate
from plumbline.operators.splits import stratified_folds, stratified_holdout
from plumbline.roles import require
from plumbline.sources import artifacts

Strategy = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame, dict], PipelineModel]

MAX_GROUPS = 10_000
FIT_THREADS = 3


@dataclass(frozen=True)
class FeatureSet:
    """Columns a model reads."""

    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    vector: str | None = None

    def stages(self) -> list:
        """Indexers with an extra slot for unknown levels, one-hot encoders and one assembled vector."""
        if not self.categorical:
            inputs = [*self.numeric, *([self.vector] if self.vector else [])]
            return [VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")]
        indexed = [f"{c}__ix" for c in self.categorical]
        hot = [f"{c}__oh" for c in self.categorical]
        inputs = [*hot, *self.numeric, *([self.vector] if self.vector else [])]
        return [
            StringIndexer(inputCols=list(self.categorical), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=False),
            VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"),
        ]

    def without(self, column: str) -> FeatureSet:
        return replace(self, categorical=tuple(c for c in self.categorical if c != column))


def _weighted(df: DataFrame) -> DataFrame:
    """Rows with a usable weight: a missing or NULL weight counts as 1."""
    if "weight" not in df.columns:
        return df.withColumn("weight", F.lit(1.0))
    return df.withColumn("weight", F.coalesce(F.col("weight"), F.lit(1.0)))


def _fit(estimator, features: FeatureSet, encoder: PipelineModel | None) -> Fit:
    def fit(train: DataFrame, params: dict) -> PipelineModel:
        rows = _weighted(train)
        if encoder is not None:
            fitted = estimator(params).fit(encoder.transform(rows))
            return PipelineModel(stages=[*encoder.stages, fitted])
        return Pipeline(stages=[*features.stages(), estimator(params)]).fit(rows)

    return fit


_COLUMNS = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}


def fit_logistic(features: FeatureSet, encoder: PipelineModel | None = None) -> Fit:
    """Weighted logistic regression; params ``regParam``, ``elasticNetParam``, ``maxIter``."""
    return _fit(lambda p: LogisticRegression(**_COLUMNS, **{"maxIter": 25, **p}), features, encoder)


def fit_boosted_trees(features: FeatureSet, encoder: PipelineModel | None = None, seed: int = 42) -> Fit:
    """Weighted gradient-boosted trees; params ``maxIter``, ``maxDepth``, ``stepSize``, ``subsamplingRate``."""
    return _fit(lambda p: GBTClassifier(**_COLUMNS, seed=seed, **{"maxIter": 20, "maxDepth": 4, **p}), features, encoder)


def fit_factorized(features: FeatureSet, encoder: PipelineModel | None = None, seed: int = 42) -> Fit:
    """A learned vector per category level under a weighted head; params ``factorSize``, ``stepSize``, ``maxIter``.

    Spark's factorization machine takes no row weights, so it only learns the
    interactions; a weighted logistic head on its output and the features carries
    the weights.
    """
    def fit(train: DataFrame, params: dict) -> PipelineModel:
        rows = _weighted(train)
        machine = FMClassifier(
            featuresCol="features", labelCol="y", rawPredictionCol="fm_raw", probabilityCol="fm_probability",
            predictionCol="fm_prediction", seed=seed, **{"factorSize": 6, "maxIter": 30, "stepSize": 0.05, **params},
        )
        joined = VectorAssembler(inputCols=["features", "fm_raw"], outputCol="with_factors")
        head = LogisticRegression(featuresCol="with_factors", labelCol="y", weightCol="weight", regParam=0.001, maxIter=25)
        if encoder is not None:
            fitted = Pipeline(stages=[machine, joined, head]).fit(encoder.transform(rows))
            return PipelineModel(stages=[*encoder.stages, *fitted.stages])
        return Pipeline(stages=[*features.stages(), machine, joined, head]).fit(rows)

    return fit


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with ``score``, the positive-class probability; a non-finite score fails the job."""
    out = model.transform(df).withColumn("score", F.get(vector_to_array("probability"), 1))
    return finite_score_gate(out.select(*df.columns, "score"))


def run_parallel(tasks: Sequence[Callable[[], object]], width: int = FIT_THREADS) -> list:
    """Results of independent driver calls in order; each call submits its own Spark jobs."""
    with ThreadPoolExecutor(max_workers=max(1, width)) as pool:
        return [future.result() for future in [pool.submit(inheritable_thread_target(task)) for task in tasks]]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_validate(
    df: DataFrame, fit: Fit, params: dict | None = None, strategy: Strategy = weights.class_weights, k: int = 5, seed: object = 42,
    strata: Sequence[str] = ("grp", "y"), folded: DataFrame | None = None, fit_for_fold: Callable[[DataFrame], Fit] | None = None,
) -> DataFrame:
    """Out-of-fold scores ``row_id, grp, y, fold, score``, a fresh fit per fold.

    The strategy sees the training part only.
    """
    rows = folded if folded is not None else cut(stratified_folds(df, list(strata), k, seed))

    def one(fold: int) -> DataFrame:
        train, held = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        make = fit if fit_for_fold is None else fit_for_fold(train)
        model = make(strategy(train), params or {})
        return score(model, held).select("row_id", "grp", "y", "fold", "score")

    return _union(run_parallel([lambda f=fold: one(f) for fold in range(k)]))


def fold_metrics(oof: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("fold",)) -> DataFrame:
    """All metrics per fold, pooled and per group, as ``by, scope, metric, value``."""
    wide = metrics.metrics_by_group(oof, threshold, by=by)
    return metrics.to_long(wide, [*by, "scope"], ["ap", "roc_auc", "f1", "precision", "recall", "accuracy"])


def search(
    df: DataFrame, fit: Fit, space: Sequence[dict], folds: int = 3, selection: str = "pooled", seed: object = 42,
    strategy: Strategy = weights.class_weights,
) -> tuple[dict, DataFrame]:
    """Best parameters of a grid by inner out-of-fold selection score, and the score of every candidate.

    Ties go to the earlier candidate. All candidates share the same inner folds.
    """
    require(len(space) >= 1, "the search space is empty")
    folded = cut(stratified_folds(df, ["grp", "y"], folds, f"{seed}-inner"))
    parts = []
    for i, params in enumerate(space):
        oof = cross_validate(folded, fit, params, strategy, folds, folded=folded)
        parts.append(oof.withColumn("candidate", F.lit(i)))
    scored = cut(metrics.selection_score(_union(parts), selection, ["candidate"]))
    best = scored.orderBy(F.desc_nulls_last("selection"), "candidate").first()["candidate"]
    return dict(space[best]), scored


@dataclass(frozen=True)
class NestedResult:
    """Outer scores with each fold's threshold, and the parameters chosen per fold."""

    oof: DataFrame
    params: dict[int, dict] = field(default_factory=dict)
    thresholds: dict[int, float] = field(default_factory=dict)

    def metrics(self) -> DataFrame:
        """``fold, scope, metric, value`` at each fold's own threshold."""
        wide = metrics.metrics_by_group(self.oof, F.col("threshold"))
        return metrics.to_long(wide, ["fold", "scope"], ["ap", "roc_auc", "f1", "precision", "recall", "accuracy"])


def nested_cv(
    df: DataFrame, fit: Fit, space: Sequence[dict], k: int = 5, inner: int = 3, holdout: float = 0.2, selection: str = "pooled",
    seed: object = 42, strategy: Strategy = weights.class_weights,
) -> NestedResult:
    """Tune on each outer training part, pick the threshold on a holdout of it, refit, score the outer fold once."""
    rows = cut(stratified_folds(df, ["grp", "y"], k, seed))

    def one(fold: int):
        train = rows.where(F.col("fold") != fold).drop("fold")
        params = space[0] if len(space) == 1 else search(train, fit, space, inner, selection, f"{seed}-{fold}", strategy)[0]
        split = stratified_holdout(train, holdout, ["y"], f"{seed}-threshold-{fold}")
        threshold_model = fit(strategy(split.where(~F.col("is_holdout")).drop("is_holdout")), params)
        held = score(threshold_model, split.where("is_holdout").drop("is_holdout"))
        threshold = metrics.best_f1_threshold(held.select("y", "score")).first()["threshold"]
        model = fit(strategy(train), params)
        scored = score(model, rows.where(F.col("fold") == fold)).select("row_id", "grp", "y", "fold", "score")
        return scored.withColumn("threshold", F.lit(float(threshold))), params, float(threshold)

    found = run_parallel([lambda f=fold: one(f) for fold in range(k)])
    return NestedResult(_union([f[0] for f in found]), {i: f[1] for i, f in enumerate(found)}, {i: f[2] for i, f in enumerate(found)})


@dataclass(frozen=True)
class Arm:
    """A model, its imbalance strategy and its search space."""

    name: str
    fit: Fit
    strategy: Strategy = weights.class_weights
    space: tuple[dict, ...] = ({},)
    selection: str = "pooled"
    params_from: str | None = None


def ablation_grid(df: DataFrame, arms: Sequence[Arm], k: int = 5, inner: int = 3, seed: object = 42) -> dict[str, DataFrame]:
    """Nested CV of every arm: summary per arm and scope, the best arm, and its paired test against the runner-up."""
    longs = []
    for arm in arms:
        result = nested_cv(df, arm.fit, arm.space, k, inner, selection=arm.selection, seed=seed, strategy=arm.strategy)
        longs.append(cut(result.metrics()).withColumn("arm", F.lit(arm.name)))
    folds = _union(longs)
    summary = metrics.summarize(folds, ["arm", "scope"])
    pooled = folds.where((F.col("scope") == metrics.SCOPE_ALL) & (F.col("metric") == "ap"))
    order = pooled.groupBy("arm").agg(F.avg("value").alias("m")).orderBy(F.desc("m"), "arm").limit(2).collect()
    out = {"folds": folds, "summary": summary, "best": order[0]["arm"]}
    if len(order) > 1:
        a, b = (pooled.where(F.col("arm") == row["arm"]) for row in order)
        out["paired"] = inference.paired_tests(a, b, ["fold"])
    return out


def production_threshold(thresholds: DataFrame) -> float:
    """Median of the fold thresholds (column ``threshold``; one row per fold)."""
    return float(exact_quantiles(thresholds, "threshold", {"t": 0.5}).first()["t"])


def refit_production(df: DataFrame, arms: Mapping[str, Arm], best: str, expected: str, params: dict, thresholds: DataFrame, path: str) -> dict:
    """Refit the winning arm on all rows and save it with its threshold; an unexpected winner raises."""
    if best != expected:
        raise ContractError(f"the best arm is {best!r}, expected {expected!r}")
    model = arms[best].fit(arms[best].strategy(df), params)
    model.write().overwrite().save(f"{path}/model")
    return {"arm": best, "threshold": production_threshold(thresholds), "params": params, "path": path}


def dro_update(state: DataFrame, step: float, adjustment: float = 0.0, group: str = "grp") -> DataFrame:
    """One exponentiated-gradient step on ``group, q, loss, n``, normalised in log space.

    A zero step leaves q as it is. The table has one row per group.
    """
    require(step >= 0, "step must be non-negative")
    if step == 0:
        return state
    everything = Window.partitionBy(F.lit(0))
    moved = F.ln("q") + F.lit(step) * (F.col("loss") + F.lit(adjustment) / F.sqrt("n"))
    shifted = state.withColumn("__l", moved).withColumn("__l", F.col("__l") - F.max("__l").over(everything))
    return shifted.withColumn("q", F.exp("__l") / F.sum(F.exp("__l")).over(everything)).drop("__l")


def dro_objective(state: DataFrame, adjustment: float = 0.0) -> DataFrame:
    """Sum over groups of q times (loss plus adjustment)."""
    return state.agg(F.sum(F.col("q") * (F.col("loss") + F.lit(adjustment) / F.sqrt("n"))).alias("objective"))


def group_dro(
    df: DataFrame, fit: Fit, params: dict, rounds: int, step: float, adjustment: float = 0.0, group: str = "grp",
    class_weighting: Strategy = weights.class_weights,
) -> tuple[PipelineModel, DataFrame]:
    """Alternate weighted fits and q updates; returns the last model and ``round, group, q, loss, objective``.

    Each round refits with row weight class weight x q_g x n / n_g. Only the table
    of groups (checked to be small) passes through the driver.
    """
    require(rounds >= 1, "rounds must be positive")
    spark = df.sparkSession
    base = cut(class_weighting(df).withColumnRenamed("weight", "__cw"))
    sizes = base.groupBy(group).agg(F.count(F.lit(1)).alias("n")).limit(MAX_GROUPS + 1).collect()
    if len(sizes) > MAX_GROUPS:
        raise ContractError(f"more than {MAX_GROUPS} groups")
    n = {row[group]: row["n"] for row in sizes}
    total = sum(n.values())
    q = {g: 1.0 / len(n) for g in n}
    kind = df.schema[group].dataType.simpleString()
    history, model = [], None
    for i in range(rounds):
        factors = spark.createDataFrame([(g, float(q[g] * total / n[g])) for g in n], f"{group} {kind}, __f double")
        rows = base.join(F.broadcast(factors), group).withColumn("weight", F.col("__cw") * F.col("__f"))
        model = fit(rows.drop("__f"), params)
        losses = profile.group_mean_loss(score(model, rows.withColumn("weight", F.col("__cw"))), group, "weight", len(n)).select(group, "loss")
        loss = {row[group]: row["loss"] for row in losses.collect()}
        state = spark.createDataFrame([(g, q[g], float(loss[g]), n[g]) for g in n], f"{group} {kind}, q double, loss double, n bigint")
        updated = dro_update(state, step, adjustment, group)
        q = {row[group]: row["q"] for row in updated.collect()}
        objective = sum(q[g] * (loss[g] + adjustment / n[g] ** 0.5) for g in n)
        history += [(i + 1, g, q[g], float(loss[g]), float(objective)) for g in n]
    return model, spark.createDataFrame(history, f"round int, {group} {kind}, q double, loss double, objective double")


def vector_rows(df: DataFrame, fit_part: DataFrame, vector: str = "embedding", row_id: str = "row_id") -> DataFrame:
    """Rows with ``scaled``, an ML vector standardised by the training part only."""
    from pyspark.ml.functions import array_to_vector

    stats = fit_part.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("p")).scalar()
    with_stats = df.withColumn("__p", packed)
    scaled = F.zip_with(F.col(vector), F.col("__p"), lambda x, p: (x - p["m"]) / (p["s"] + 1e-8))
    return with_stats.withColumn("scaled", array_to_vector(scaled)).drop("__p")


def vector_head(df: DataFrame, train: DataFrame, objective: str, rounds: int = 3, step: float = 0.5, group: str = "grp", params: dict | None = None) -> DataFrame:
    """Score rows with a head on stored vectors trained by ERM, reweighting or group DRO."""
    require(objective in ("erm", "reweighted", "dro"), f"unknown objective {objective!r}")
    fit = fit_logistic(FeatureSet(vector="scaled"))
    fitted_on = cut(vector_rows(train, train))
    if objective == "dro":
        model, _ = group_dro(fitted_on, fit, params or {}, rounds, step, group=group)
    else:
        strategy = weights.class_weights if objective == "erm" else (lambda part: weights.class_by_group_weights(part, group))
        model = fit(strategy(fitted_on), params or {})
    return score(model, vector_rows(df, train)).drop("scaled")


def run_arms(
    df: DataFrame, arms: Sequence[Arm], designs: Sequence[str], seeds: Sequence[int], path: str, k: int = 5, inner: int = 3,
    group_feature: str | None = None,
) -> DataFrame:
    """Run every (design, arm, seed, fold) that has no commit mark yet; returns the manifest.

    Designs: ``nested`` (stratified folds) and ``held_out`` (one fold per group).
    An arm with ``params_from`` reuses its parent's tuned parameters of the fold.
    """
    spark = df.sparkSession
    rows = cut(df)
    tuned: dict[tuple, dict] = {}
    for design in designs:
        for seed in seeds:
            if design == "nested":
                folded = cut(stratified_folds(rows, ["grp", "y"], k, seed))
                n_folds = k
            else:
                # one row per group; each is a fold, and so a model fit of its own
                numbered = cut(rows.select(F.col("grp").alias("__g")).distinct().withColumn("fold", F.row_number().over(Window.orderBy("__g")) - 1))
                folded = cut(rows.join(numbered, F.col("grp").eqNullSafe(F.col("__g"))).drop("__g"))
                n_folds = numbered.count()
            for arm in arms:
                plan = spark.createDataFrame([(design, arm.name, seed, f) for f in range(n_folds)], "design string, arm string, seed int, fold int")
                todo = [row["fold"] for row in artifacts.pending(plan, artifacts.manifest(spark, path)).collect()]
                for fold in sorted(todo):
                    started = time.time()
                    train = folded.where(F.col("fold") != fold)
                    key = (design, arm.params_from or arm.name, seed, fold)
                    if key not in tuned:
                        space = list(arm.space)
                        tuned[key] = space[0] if len(space) == 1 else search(train.drop("fold"), arm.fit, space, inner, arm.selection, f"{seed}-{fold}", arm.strategy)[0]
                    model = arm.fit(arm.strategy(train.drop("fold")), tuned[key])
                    held = score(model, folded.where(F.col("fold") == fold))
                    artifacts.write_oof(held.select(
                        F.lit(design).alias("design"), F.lit(arm.name).alias("arm"), F.lit(seed).alias("seed"), F.col("fold"), "row_id", "grp", "y", "score"
                    ), path, time.time() - started)
    return artifacts.manifest(spark, path)


def preprocessing_leak(df: DataFrame, features: FeatureSet, make_fit: Callable[..., Fit], params: dict, k: int = 5, seed: object = 42, tol: float = 0.01) -> DataFrame:
    """Metric differences between encoders fitted on all rows and inside each fold, over the same folds."""
    folded = cut(stratified_folds(df, ["grp", "y"], k, seed))
    shared = Pipeline(stages=features.stages()).fit(folded)
    leaky = cross_validate(folded, make_fit(features, shared), params, k=k, folded=folded)
    clean = cross_validate(folded, make_fit(features), params, k=k, folded=folded)
    sides = []
    for oof in (leaky, clean):
        long = fold_metrics(oof).where(F.col("scope") == metrics.SCOPE_ALL)
        sides.append(long.select(F.lit("model").alias("arm"), "fold", "metric", "value"))
    return reproduction_gate(sides[0], sides[1], tol)
