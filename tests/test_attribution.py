"""Identities of Shapley values, ablation, curves and agreement."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import agreement as G
from plumbline.operators import attribution as E
from plumbline.operators.contracts import ContractError

FEATURES = ["x0", "x1", "x2"]


def additive(x):
    return 2.0 * x[0] - 1.0 * x[1] + 0.5 * x[2]


def pairwise(x):
    return additive(x) + 3.0 * x[0] * x[1] - 2.0 * x[1] * x[2]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(25, 3)), 3)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, x0 double, x1 double, x2 double")
    reference = spark.createDataFrame([tuple(map(float, r)) for r in np.round(rng.normal(size=(6, 3)), 3)], "x0 double, x1 double, x2 double")
    return df, reference


def outputs(df, predict):
    return df.select("row_id", predict([F.col(f) for f in FEATURES]).alias("output"))


def wide(attr, value="value"):
    return attr.toPandas().pivot(index="row_id", columns="feature", values=value)[FEATURES].to_numpy()


def test_shapley_of_an_additive_model(rows):
    df, ref = rows
    phi = wide(E.exact_shapley(df, FEATURES, ref, additive))
    x, b = df.orderBy("row_id").toPandas()[FEATURES].to_numpy(), ref.toPandas().to_numpy()
    assert np.allclose(phi, np.array([2.0, -1.0, 0.5]) * (x - b.mean(0)))


def test_efficiency_and_its_failure(rows):
    df, ref = rows
    phi = E.exact_shapley(df, FEATURES, ref, pairwise)
    assert E.check_efficiency(phi, outputs(df, pairwise), 1e-9).first()["passed"]
    with pytest.raises(ContractError):
        E.check_efficiency(phi, outputs(df, additive), 1e-9, must_pass=True)
    with pytest.raises(ValueError):
        E.check_efficiency(phi, outputs(df, pairwise), 0.0)


def test_repeated_reference_points_count_as_weights(rows):
    df, ref = rows
    twice = ref.unionByName(ref)
    assert np.allclose(wide(E.exact_shapley(df, FEATURES, ref, pairwise)), wide(E.exact_shapley(df, FEATURES, twice, pairwise)))


def test_interactions_sum_to_shapley_values(rows):
    df, ref = rows
    inter, phi = E.shapley_interactions(df, FEATURES, ref, pairwise), E.exact_shapley(df, FEATURES, ref, pairwise)
    row = E.interaction_summary(inter, phi).first()
    assert row["max_row_sum_error"] < 1e-9
    none = E.shapley_interactions(df, FEATURES, ref, additive).where("feature_i <> feature_j").agg(F.max(F.abs("value"))).first()[0]
    assert none < 1e-9
    x0x2 = inter.where("feature_i = 'x0' AND feature_j = 'x2'").agg(F.max(F.abs("value"))).first()[0]
    assert x0x2 < 1e-9


def test_ablation_equals_shapley_without_interactions_and_the_gap_is_the_pair_sum(rows):
    df, ref = rows
    point = ref.limit(1)
    point = df.sparkSession.createDataFrame(point.collect(), point.schema)
    assert np.allclose(wide(E.feature_ablation(df, FEATURES, point, additive)), wide(E.point_shapley(df, FEATURES, point, additive)))
    gap = G.ablation_shapley_gap(
        E.point_shapley(df, FEATURES, point, pairwise), E.feature_ablation(df, FEATURES, point, pairwise), E.shapley_interactions(df, FEATURES, point, pairwise)
    ).first()
    assert gap["r2"] == pytest.approx(1.0)
    assert gap["same_sign_share"] == pytest.approx(1.0)
    with pytest.raises(Exception, match="exactly one reference row"):
        E.point_shapley(df, FEATURES, ref, pairwise).collect()


def test_curve_end_points(rows):
    df, ref = rows
    order = E.feature_ranks(E.exact_shapley(df, FEATURES, ref, pairwise)).select("row_id", "feature", "rank")
    curves = E.removal_curves(df, FEATURES, order, ref, pairwise).toPandas()
    base = ref.select(pairwise([F.col(f) for f in FEATURES]).alias("o")).agg(F.avg("o")).first()[0]
    first, last = curves[curves.k == 0], curves[curves.k == 3]
    assert np.allclose(first.deletion, first.output) and np.allclose(last.insertion, last.output)
    assert np.allclose(last.deletion, base) and np.allclose(first.insertion, base)
    metrics = {r["metric"] for r in E.faithfulness_rows(E.removal_curves(df, FEATURES, order, ref, pairwise)).select("metric").distinct().collect()}
    assert "comprehensiveness@3" in metrics and "comprehensiveness@5" not in metrics


def brute_coalitions(x, reference, predict):
    m = x.shape[1]
    out = np.zeros((len(x), 1 << m))
    for mask in range(1 << m):
        keep = [j for j in range(m) if mask >> j & 1]
        for i, row in enumerate(x):
            mixed = reference.copy()
            mixed[:, keep] = row[keep]
            out[i, mask] = np.mean(predict(mixed.T))
    return out


@pytest.mark.parametrize("block", [E.REFERENCE_BLOCK, 4])
def test_coalitions_beyond_one_aggregate_and_one_block(spark, monkeypatch, block):
    monkeypatch.setattr(E, "REFERENCE_BLOCK", block)
    rng = np.random.default_rng(1)
    names = [f"x{j}" for j in range(6)]
    x, b = np.round(rng.normal(size=(9, 6)), 2), np.round(rng.normal(size=(37, 6)), 1)

    def predict(v):
        return v[0] * v[1] - 2 * v[2] * v[3] * v[5] + v[4] + 0.5 * v[1] * v[5]

    schema = ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], f"row_id long, {schema}")
    ref = spark.createDataFrame([tuple(map(float, r)) for r in b], schema)
    got = {r.row_id: r.v for r in E.coalition_values(df, names, ref, predict).collect()}
    assert np.allclose([got[i] for i in range(9)], brute_coalitions(x, b, predict))
    phi = E.exact_shapley(df, names, ref, predict)
    out = df.select("row_id", predict([F.col(n) for n in names]).alias("output"))
    assert E.check_efficiency(phi, out, 1e-9).first()["passed"]
    assert E.interaction_summary(E.shapley_interactions(df, names, ref, predict), phi).first()["max_row_sum_error"] < 1e-9


def test_missing_values_make_their_rows_null(spark, rows):
    df, ref = rows
    odd = df.unionByName(spark.createDataFrame([(100, None, 1.0, 2.0)], df.schema))
    got = E.exact_shapley(odd, FEATURES, ref, additive).where("row_id = 100").collect()
    assert [r.value for r in got] == [None] * 3 and got[0].base_value is not None
    assert E.exact_shapley(df.limit(0), FEATURES, ref, additive).count() == 0
    with pytest.raises(Exception, match="at least one point"):
        E.exact_shapley(df, FEATURES, ref.limit(0), additive).collect()


def test_too_many_players(rows):
    df, ref = rows
    with pytest.raises(ValueError):
        E.coalition_values(df, [f"x{i}" for i in range(17)], ref, additive)


def attr(spark, values, names):
    return spark.createDataFrame([(i, n, float(v)) for i, r in enumerate(values) for n, v in zip(names, r)], "row_id long, feature string, value double")


def test_grouping_longest_prefix_and_failures(spark):
    names = ["job_Kenya", "job_type_Self employed", "job_type_unknown", "size", "size_outlier"]
    a = attr(spark, [[1, 2, 3, 4, 5]], names)
    got = {r["feature"]: r["value"] for r in E.group_columns(a, ["job", "job_type"], ["size"], {"size_outlier": "size"}).collect()}
    assert got == {"job": 1.0, "job_type": 5.0, "size": 9.0}
    with pytest.raises(Exception, match="no encoded column maps to age"):
        E.group_columns(a, ["job", "job_type"], ["size", "age"], {"size_outlier": "size"}).collect()
    with pytest.raises(Exception, match="belongs to no raw feature"):
        E.group_columns(attr(spark, [[1.0]], ["other"]), ["job"], []).collect()


def test_zero_total_has_no_share(spark):
    with pytest.raises(Exception, match="positive total"):
        E.importance_share(E.mean_abs_importance(attr(spark, [[0, 0]], ["a", "b"]))).collect()


NAMES = ["f1", "f2", "f3", "f4", "f5", "f6"]


def brute_spearman(a, b):
    return np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]


def test_row_agreement_against_pandas(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(size=(40, 6)), 1), np.round(rng.normal(size=(40, 6)), 1)
    a[:, 0] = b[:, 0] = 0.0
    a[3] = 1.0  # constant row
    pairs = G.pair(attr(spark, a, NAMES), attr(spark, b, NAMES))
    got = {r["row_id"]: r["rho"] for r in G.instance_rank_corr_no_shared_zeros(pairs).collect()}
    plain = {r["row_id"]: r["rho"] for r in G.instance_rank_corr(pairs).collect()}
    for i in range(40):
        keep = ~((a[i] == 0) & (b[i] == 0))
        x, y = np.abs(a[i][keep]), np.abs(b[i][keep])
        if keep.sum() < 3 or np.ptp(x) == 0 or np.ptp(y) == 0:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(brute_spearman(x, y))
    assert plain[3] is None
    summary = G.summarize_agreement(pairs, 6).first()
    nz = (a != 0) & (b != 0)
    assert summary["sign_agreement_share"] == pytest.approx((np.sign(a[nz]) == np.sign(b[nz])).mean())
    assert summary["mean_abs_difference"] == pytest.approx(np.abs(a - b).mean())
    assert summary["same_top_feature_share"] == pytest.approx((np.abs(a).argmax(1) == np.abs(b).argmax(1)).mean())


def test_identical_attributions_agree_fully(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(30, 6))
    pairs = G.pair(attr(spark, a, NAMES), attr(spark, a, NAMES))
    row = G.global_agreement(pairs, 6).first()
    assert all(row[c] == pytest.approx(1.0) for c in ("global_spearman", "global_kendall", "top3_overlap", "top5_overlap"))
    opposite = G.per_feature_disagreement(attr(spark, a, NAMES), attr(spark, -a, NAMES)).collect()
    assert all(r["disagreement"] == pytest.approx(2.0) for r in opposite)
