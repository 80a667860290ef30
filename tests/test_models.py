"""Leakage guards and bookkeeping of the model jobs on small frames."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics
from plumbline.operators import models as L
from plumbline.operators import weights as W
from plumbline.operators.contexts import balanced_batches
from plumbline.operators.contracts import ContractError
from plumbline.operators.dro import batched_group_dro


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=240)
    data = [(i, "AB"[i % 2], int(x[i] + 0.3 * rng.normal() > 0.4), float(x[i]), "uv"[i % 3 % 2]) for i in range(240)]
    return spark.createDataFrame(data, "row_id long, grp string, y int, x double, c string")


FEATURES = L.FeatureSet(("grp", "c"), ("x",))
FAST = {"maxIter": 5}


def test_oof_covers_every_row_once_and_training_never_sees_its_fold(rows):
    seen = []

    def strategy(train):
        seen.append({r["fold"] for r in train.select("fold").distinct().collect()})
        return W.class_weights(train)

    oof = L.cross_validate(rows, L.fit_logistic(FEATURES), FAST, strategy, k=3).cache()
    assert oof.count() == 240 and oof.select("row_id").distinct().count() == 240
    assert sorted(map(sorted, seen)) == [[0, 1], [0, 2], [1, 2]]
    ap = L.fold_metrics(oof).where("scope = 'pooled' AND metric = 'ap'").agg(F.min("value")).first()[0]
    assert ap > 0.7


def test_nested_cv_tunes_inside_the_training_part(rows):
    result = L.nested_cv(rows, L.fit_logistic(FEATURES), [FAST], k=2)
    assert result.oof.select("row_id").distinct().count() == 240
    assert set(result.thresholds) == {0, 1} and all(0 < t < 1 for t in result.thresholds.values())


def test_nested_cv_metrics_use_each_folds_own_threshold(rows):
    result = L.nested_cv(rows, L.fit_logistic(FEATURES), [FAST, {"maxIter": 2}], k=2, inner=2)
    got = {(r["fold"], r["scope"], r["metric"]): r["value"] for r in result.metrics().collect()}
    scored = result.oof.collect()
    for fold, t in result.thresholds.items():
        for scope in ("pooled", "A", "B"):
            part = [r for r in scored if r["fold"] == fold and scope in ("pooled", r["grp"])]
            assert got[fold, scope, "accuracy"] == pytest.approx(np.mean([(r["score"] >= t) == r["y"] for r in part]))
            said = [r["y"] for r in part if r["score"] >= t]
            assert got[fold, scope, "precision"] == pytest.approx(np.mean(said))


def test_metrics_by_group_with_a_threshold_column(spark):
    data = [(0, "A", 1, 0.4, 0.3), (0, "A", 0, 0.4, 0.5), (0, "B", 1, 0.2, 0.3), (1, "B", 0, 0.9, 0.5), (1, "B", None, 0.9, 0.5), (1, "B", 1, None, 0.5)]
    df = spark.createDataFrame(data, "fold int, grp string, y int, score double, threshold double")
    got = {(r["fold"], r["scope"]): (r["precision"], r["recall"], r["accuracy"]) for r in metrics.metrics_by_group(df, F.col("threshold")).collect()}
    assert got[0, "A"] == (1.0, 1.0, 1.0) and got[0, "B"][1:] == (0.0, 0.0)
    assert got[0, "pooled"] == pytest.approx((1.0, 0.5, 2 / 3)) and got[1, "pooled"][0] == got[1, "pooled"][2] == 0.0


def test_unseen_level_at_scoring_time(rows):
    model = L.fit_logistic(FEATURES)(rows, FAST)
    out = L.score(model, rows.withColumn("c", F.lit("new level")))
    assert out.where("score BETWEEN 0 AND 1").count() == 240


def test_unexpected_winner_is_refused(rows):
    arm = L.Arm("a", L.fit_logistic(FEATURES))
    with pytest.raises(ContractError):
        L.refit_production(rows, {"a": arm}, "a", "b", {}, rows, "/tmp/never-written")


def test_ablation_grid_summarises_every_arm_and_scope(rows):
    arms = [L.Arm("long", L.fit_logistic(FEATURES), space=(FAST,)), L.Arm("short", L.fit_logistic(FEATURES), W.no_resampling, ({"maxIter": 1},))]
    out = L.ablation_grid(rows, arms, k=2)
    assert {(r["arm"], r["scope"]) for r in out["summary"].collect()} == {(a, s) for a in ("long", "short") for s in ("pooled", "A", "B")}
    assert out["folds"].count() == 2 * 2 * 3 * 6 and out["best"] in ("long", "short") and "paired" in out


def test_dro_without_a_step_keeps_q_uniform(rows):
    _, history = L.group_dro(rows, L.fit_logistic(FEATURES), FAST, rounds=2, step=0.0)
    assert all(r["q"] == 0.5 for r in history.collect())


@pytest.mark.parametrize("step", [0.0, 0.7])
def test_batched_dro_is_that_of_numpy(spark, step):
    rng = np.random.default_rng(2)
    rows = [(i, "a" if i % 4 else "b", int(rng.random() < 0.4), *map(float, rng.normal(size=2))) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, grp string, y int, x0 double, x1 double")
    model, history = batched_group_dro(df, ["x0", "x1"], 20, 7, step, 0.3, adjustment=2.0, seed="s")
    plan = balanced_batches(df, "grp", 20, 2, "s").toPandas()
    plan["number"] = plan.epoch * 5 + plan.step
    by_id = {r[0]: r for r in rows}
    sizes = {"a": sum(r[1] == "a" for r in rows), "b": sum(r[1] == "b" for r in rows)}
    w, q = np.zeros(3), {"a": 0.5, "b": 0.5}
    got = {(r.step, r.grp): r for r in history.collect()}
    for i in range(7):
        loss, slope = {}, {}
        for g in "ab":
            part = [by_id[r] for r in plan[(plan.number == i) & (plan.grp == g)].row_id]
            assert len(part) == 10
            x, y = np.array([[1.0, *r[3:]] for r in part]), np.array([r[2] for r in part])
            p = 1 / (1 + np.exp(-x @ w))
            loss[g], slope[g] = np.mean(-(y * np.log(p) + (1 - y) * np.log(1 - p))), ((p - y)[:, None] * x).mean(0)
        moved = {g: q[g] * np.exp(step * (loss[g] + 2 / np.sqrt(sizes[g]))) for g in q}
        q = {g: m / sum(moved.values()) for g, m in moved.items()}
        w = w - 0.3 * sum(q[g] * slope[g] for g in q)
        for g in "ab":
            assert got[i, g].q == pytest.approx(q[g]) and got[i, g].loss == pytest.approx(loss[g])
    assert [model.intercept, *model.weights] == pytest.approx(w.tolist())
