"""Hand values, identities and loud failures of the batch operators."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import contracts as C
from plumbline.operators import drift as R
from plumbline.operators import encode as P
from plumbline.operators import inference as B
from plumbline.operators import metrics as M
from plumbline.operators import models as L
from plumbline.operators import profile as A
from plumbline.operators import resample
from plumbline.operators import splits as D
from plumbline.operators import weights as W
from plumbline.operators import contexts as X


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- drift ------------------------------------------------------------------

def shares(spark, values):
    return frame(spark, [("f", i, float(v)) for i, v in enumerate(values)], "feature string, bin int, share double")


def test_psi_by_hand(spark):
    got = R.psi(shares(spark, [0.5, 0.5]), shares(spark, [0.8, 0.2]), ["feature"]).first()["psi"]
    assert got == pytest.approx(0.3 * math.log(0.8 / 0.5) - 0.3 * math.log(0.2 / 0.5))


def test_psi_of_an_empty_bin_is_finite_and_bins_must_match(spark):
    got = R.psi(shares(spark, [0.0, 1.0]), shares(spark, [0.5, 0.5]), ["feature"]).first()["psi"]
    assert math.isfinite(got)
    with pytest.raises(Exception, match="bin count mismatch"):
        R.psi(shares(spark, [0.5, 0.5]), shares(spark, [0.3, 0.3, 0.4]), ["feature"]).collect()


def test_status_boundaries(spark):
    values = [(0.0, "stable"), (0.0999, "stable"), (0.10, "moderate"), (0.25, "moderate"), (0.2501, "significant")]
    df = frame(spark, [(v, s) for v, s in values], "v double, s string")
    assert all(r["got"] == r["s"] for r in df.withColumn("got", R.psi_status(F.col("v"))).collect())


def test_numeric_bins_are_right_closed(spark):
    long = frame(spark, [("f", float(v)) for v in (5, 10, 11, 20, 21, 1000)], "feature string, value double")
    edges = frame(spark, [("f", [10.0, 20.0])], "feature string, edges array<double>")
    got = [r["share"] for r in R.numeric_shares(long, edges, ["feature"]).orderBy("bin").collect()]
    assert got == pytest.approx([2 / 6] * 3)


def test_decile_edges_are_observed_and_unique(spark):
    df = frame(spark, [(float(v),) for v in [1] * 50 + [2] * 50], "v double")
    assert R.decile_edges(df, "v").first()["edges"] == [1.0, 2.0]


def test_unseen_level_gets_its_own_bin(spark):
    long = frame(spark, [("f", v) for v in ("a", "a", "b", "zzz")], "feature string, level string")
    levels = frame(spark, [("f", "a"), ("f", "b")], "feature string, level string")
    got = {r["label"]: r["share"] for r in R.categorical_shares(long, levels, ["feature"]).collect()}
    assert got == {"a": 0.5, "b": 0.25, "(unseen)": 0.25}


def test_empty_sample_has_no_shares(spark):
    long = frame(spark, [], "feature string, value double")
    edges = frame(spark, [("f", [1.0])], "feature string, edges array<double>")
    with pytest.raises(Exception, match="empty sample"):
        R.numeric_shares(long, edges, ["feature"]).collect()


def test_same_population_has_no_drift_and_a_shift_is_found(spark):
    rows = [(i, float(18 + i * 7 % 53), ("None", "Own", "Shared")[i * i % 3], (i * 13 % 100) / 100) for i in range(1200)]
    schema = "row_id long, age double, phone string, p double"
    base = frame(spark, rows, schema)
    profile = R.build_profile(base, ["phone"], ["age"], "p")
    same = R.feature_drift(profile, base, ["phone"], ["age"], "p").collect()
    assert {r["feature"] for r in same} == {"phone", "age", R.SCORE_FEATURE}
    assert all(r["psi"] == pytest.approx(0.0) and r["status"] == "stable" for r in same)
    moved = base.withColumn("phone", F.lit("Shared"))
    drift = R.feature_drift(profile, moved, ["phone"], ["age"], "p")
    top = drift.first()
    assert (top["feature"], top["status"]) == ("phone", "significant")
    rates = R.segment_rates(base, F.col("p") >= 0.5, None)
    assert R.drift_verdict(drift, rates, rates).first()["code"] == 20
    few = R.segment_rates(base.limit(100), F.col("p") >= 0.5, None)
    assert R.drift_verdict(drift, rates, few).first()["status"] == "insufficient_data"
    with pytest.raises(C.ContractError):
        R.require_segment(profile, "nowhere")


# --- metrics ----------------------------------------------------------------

def brute_ap(y, s, w):
    """From the definition: at each threshold, what it adds to the recall times the precision there."""
    positives = sum(b for a, b in zip(y, w) if a == 1)
    total, recall = 0.0, 0.0
    for threshold in sorted(set(s.tolist()), reverse=True):
        chosen = [(a, b) for a, c, b in zip(y, s, w) if c >= threshold]
        hit, all_ = sum(b for a, b in chosen if a == 1), sum(b for _, b in chosen)
        if all_:
            total += (hit / positives - recall) * hit / all_
            recall = hit / positives
    return float(total)


@pytest.fixture(scope="module")
def tied(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"row_id": np.arange(500), "y": rng.integers(0, 2, 500), "score": np.round(rng.random(500), 2), "w": rng.integers(0, 4, 500)})
    return pdf, frame(spark, pdf.to_numpy().tolist(), "row_id double, y double, score double, w double").withColumns({"y": F.col("y").cast("int"), "w": F.col("w").cast("int")})


def test_average_precision_with_ties_and_weights(tied):
    pdf, df = tied
    one = np.ones(len(pdf))
    assert M.average_precision(df).first()["ap"] == pytest.approx(brute_ap(pdf.y.to_numpy(), pdf.score.to_numpy(), one))
    got = M.average_precision(df, weight=F.col("w")).first()["ap"]
    assert got == pytest.approx(brute_ap(pdf.y.to_numpy(), pdf.score.to_numpy(), pdf.w.to_numpy()))


def test_auc_counts_ties_as_half(tied):
    pdf, df = tied
    pos, neg = pdf.score[pdf.y == 1].to_numpy(), pdf.score[pdf.y == 0].to_numpy()
    wins = (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()
    assert M.roc_auc(df).first()["roc_auc"] == pytest.approx(wins)


def test_best_threshold_prefers_the_lowest_and_empty_is_half(spark):
    df = frame(spark, [(1, 0.9), (1, 0.9), (0, 0.2), (0, 0.1)], "y int, score double")
    assert M.best_f1_threshold(df).first()["threshold"] == 0.9
    empty = M.best_f1_threshold(frame(spark, [], "y int, score double")).first()
    assert (empty["threshold"], empty["f1"]) == (0.5, 0.0)


def test_group_without_positives_is_skipped(spark):
    df = frame(spark, [("a", 1, 0.9), ("a", 0, 0.1), ("b", 0, 0.5)], "grp string, y int, score double")
    assert M.selection_score(df, "worst_group").first()["selection"] == 1.0


# --- inference ----------------------------------------------------------------

def test_holm_by_hand(spark):
    df = frame(spark, [("f", "x", 0.01), ("f", "y", 0.04), ("f", "z", 0.03)], "family string, item string, p double")
    got = {r["item"]: r["p_holm"] for r in B.holm(df, "p", ["family"], tie=["item"]).collect()}
    assert got == pytest.approx({"x": 0.03, "y": 0.06, "z": 0.06})


def test_bootstrap_keeps_stratum_sizes(spark):
    rows = [(i, "a" if i < 30 else "b") for i in range(100)]
    df = frame(spark, rows, "row_id long, s string")
    draws = B.bootstrap_draws(df, ["s"], 50, "t").join(df, "row_id")
    sizes = {(r["rep"], r["s"]): r["n"] for r in draws.groupBy("rep", "s").agg(F.sum("c").alias("n")).collect()}
    assert sizes == {(rep, s): n for rep in range(50) for s, n in (("a", 30), ("b", 70))}


def test_poisson_counts_are_poisson_and_need_no_shuffle(spark):
    rows = spark.range(4000).withColumnRenamed("id", "row_id").withColumn("y", (F.col("row_id") % 5 == 0).cast("int"))
    drawn = B.poisson_draws(rows, 20, "s")
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    counts = drawn.toPandas()
    points = counts[counts.rep == B.POINT]
    assert sorted(points.row_id) == list(range(4000)) and (points.c == 1).all()
    c = np.zeros((20, 4000), int)
    for r in counts[counts.rep != B.POINT].itertuples():
        c[r.rep, r.row_id] = r.c
    assert abs(c.mean() - 1) < 0.015 and abs(c.var() - 1) < 0.04
    for k, share in enumerate([0.3679, 0.3679, 0.1839, 0.0613, 0.0153]):
        assert abs((c == k).mean() - share) < 0.006
    assert abs(np.corrcoef(c[0], c[1])[0, 1]) < 0.06 and abs(np.corrcoef(c[:10].ravel(), c[10:].ravel())[0, 1]) < 0.02
    again = B.poisson_draws(rows.repartition(7), 20, "s").toPandas()
    key = ["rep", "row_id"]
    assert counts.sort_values(key).c.tolist() == again.sort_values(key).c.tolist()


def test_poisson_interval_agrees_with_exact_draws(spark):
    rows = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("y"), F.lit("a").alias("grp"))

    def rate(weighted, by):
        return weighted.groupBy(*by, "grp").agg((F.sum(F.col("c") * F.col("y")) / F.sum("c")).alias("value"))

    exact, poisson = (B.bootstrap_ci(rows, rate, ["grp"], 300, "s", poisson=p).first() for p in (False, True))
    assert poisson["estimate"] == exact["estimate"] == 0.25 and poisson["approximate"] and poisson["reps"] == 300
    assert abs(poisson["ci_low"] - exact["ci_low"]) < 0.01 and abs(poisson["ci_high"] - exact["ci_high"]) < 0.01
    with pytest.raises(ValueError):
        B.bootstrap_ci(rows, rate, ["grp"], 10, "s", strata=["y"], poisson=True)


def test_prevalence_comes_from_all_arms(spark):
    rows = [("a", 0, i, "x" if i % 2 else "y", int(i % 3 == 0), i / 40) for i in range(40)]
    rows += [("b", 0, i, "x", int(i % 3 == 0), 1 - i / 40) for i in range(40) if i % 2]
    df = spark.createDataFrame(rows, "arm string, seed int, row_id long, grp string, y int, score double")
    got = {(r.arm, r.metric, r.scope): r.value for r in M.fairness_metrics(df).collect()}
    for g in "xy":
        labels = [r[4] for r in rows[:40] if r[3] == g]
        assert got["a", "P_c", g] - got["a", "Ex_c", g] == pytest.approx(np.mean(labels))
    assert ("b", "P_c", "y") not in got and ("b", "P", "pooled") in got


def test_paired_tests_on_known_folds(spark):
    a = frame(spark, [(i, v) for i, v in enumerate([0.60, 0.58, 0.61, 0.59, 0.57])], "fold int, value double")
    b = frame(spark, [(i, v) for i, v in enumerate([0.58, 0.57, 0.58, 0.55, 0.52])], "fold int, value double")
    row = B.paired_tests(a, b, ["fold"]).first()
    d = np.array([0.02, 0.01, 0.03, 0.04, 0.05])
    assert row["t_statistic"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(5)))
    # two-sided p of t = 4.2426 with 4 degrees of freedom, from tables
    assert row["t_p_value"] == pytest.approx(0.01324, abs=2e-4)
    assert (row["wilcoxon_statistic"], row["wilcoxon_p_value"]) == (0.0, pytest.approx(0.0625))


def test_bad_bootstrap_parameters(spark):
    df = frame(spark, [(1, "f", 0.5), (2, "f", 0.1)], "row_id long, feature string, value double")
    with pytest.raises(ValueError):
        B.importance_ci(df, 10, "s", level=1.0)
    with pytest.raises(ValueError):
        B.importance_ci(df, 1, "s")


# --- splits, weights, contexts ---------------------------------------------------

@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, "ABC"[i % 3] if i % 5 else "A", int(i % 4 == 0)) for i in range(400)]
    return frame(spark, rows, "row_id long, grp string, y int")


def test_folds_cover_once_and_balance(people):
    folded = D.stratified_folds(people, ["grp", "y"], 5, "s")
    assert folded.count() == people.count()
    sizes = folded.groupBy("grp", "y", "fold").count().groupBy("grp", "y").agg((F.max("count") - F.min("count")).alias("d"), F.count("fold").alias("k"))
    assert all(r["d"] <= 1 and r["k"] == 5 for r in sizes.collect())


def test_nested_folds_never_hold_the_outer_rows(people):
    nested = D.nested_folds(people, ["grp", "y"], 4, 3, "s")
    own = D.stratified_folds(people, ["grp", "y"], 4, "s").select("row_id", F.col("fold").alias("own"))
    assert nested.join(own, "row_id").where("own = outer_fold").count() == 0
    assert nested.count() == 3 * people.count()


def test_sample_sizes_and_exclusion(people):
    back = D.stratified_sample(people, 60, ["grp", "y"], "b")
    pooled = D.stratified_sample(people, 100, ["grp", "y"], "p", exclude=back)
    assert (back.count(), pooled.count()) == (60, 100)
    assert back.join(pooled, "row_id").count() == 0
    with pytest.raises(Exception, match="cannot draw"):
        D.stratified_sample(people, 400, ["grp", "y"], "b").collect()


def test_contexts_use_every_row_when_capacity_allows(people):
    lists = X.stratified_contexts(people, ["grp", "y"], 8, 200, "c").collect()
    assert {r["row_id"] for r in lists} == set(range(400))
    sizes = pd.Series([r["list_id"] for r in lists]).value_counts()
    assert (sizes <= 200).all() and len(set(sizes)) == 1


def test_balanced_contexts_are_balanced(people):
    counts = X.balanced_contexts(people, "grp", "y", 2, 150, "c").groupBy("list_id", "grp").count().collect()
    assert max(r["count"] for r in counts) - min(r["count"] for r in counts) <= 1


def test_lists_are_dealt_without_rows_that_no_list_holds(people):
    lists = X.stratified_contexts(people, ["grp", "y"], 8, 200, "c")
    lists.collect()
    sizes = people.groupBy("grp", "y").count().collect()
    total = sum(r["count"] for r in sizes)
    got = {(r.grp, r.y, r.list_id): r["count"] for r in lists.groupBy("grp", "y", "list_id").count().collect()}
    for r in sizes:
        take = math.floor(r["count"] * min(1.0, 200 / total))
        assert all(got.get((r.grp, r.y, i), 0) == take for i in range(8))
    assert "Generate explode" in (text := lists._jdf.queryExecution().optimizedPlan().toString())
    assert not [line for line in text.split("Generate explode")[0].splitlines() if "Filter" in line]


def test_held_out_splits_are_filters(people):
    marked = D.leave_one_group_out(people, "grp")
    for r in D.split_sizes(marked).collect():
        train, held = D.held_out_split(marked, r.held_out)
        assert (train.count(), held.count()) == (r.train_rows, r.val_rows)
        assert train.where(F.col("grp") == r.held_out).count() == 0


def test_batches_have_equal_groups_and_no_early_repeats(people):
    plan = X.balanced_batches(people, "grp", 30, 2, "b").toPandas()
    steps = math.ceil(400 / 30)
    per = plan.groupby(["epoch", "step", "grp"]).size()
    assert (per == 10).all() and len(per) == 2 * steps * 3
    for grp, part in plan.groupby("grp"):
        order = part.sort_values(["epoch", "step", "slot"]).row_id.to_numpy()
        n = (people.where(F.col("grp") == grp)).count()
        for start in range(0, len(order), n):
            served = order[start:start + n]
            assert len(set(served)) == len(served)


def test_weight_totals(people):
    n = people.count()
    assert W.class_weights(people).agg(F.sum("weight")).first()[0] == pytest.approx(n)
    inside = W.within_group_class_weights(people).groupBy("grp").agg(F.sum("weight").alias("w"), F.count("y").alias("n")).collect()
    assert all(r["w"] == pytest.approx(r["n"]) for r in inside)
    per_group = W.group_weights(people).groupBy("grp").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(n / 3) for r in per_group)


# --- resampling -------------------------------------------------------------------

def brute_neighbours(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("pivots", [2, 9, 60])
def test_neighbours_match_brute_force(spark, pivots):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(8, 0.05, (120, 3)), [[50.0, 50.0, 50.0]]])
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = resample.exact_neighbours(df, 4, pivots).toPandas()
    expected = brute_neighbours(x, 4)
    assert len(got) == 4 * len(x)
    for i, part in got.groupby("id"):
        assert np.allclose(np.sort(part.dist), expected[i])


def by_distance_and_id(rows, k):
    """(id, neighbour, position) by brute force: NaN is the greatest distance, points of one id share their neighbours."""
    usable = [(i, np.array(x, float)) for i, x in rows if i is not None and None not in x]
    out = []
    for i in {i for i, _ in usable}:
        with np.errstate(all="ignore"):
            met = [(float(np.sqrt(((x - y) ** 2).sum())), j) for own, x in usable if own == i for j, y in usable if j != i]
        met.sort(key=lambda p: (math.isnan(p[0]), 0.0 if math.isnan(p[0]) else p[0], p[1]))
        out += [(i, j, pos) for pos, (_, j) in enumerate(met[:k], 1)]
    return sorted(out)


def neighbour_rows(df):
    return sorted((r["id"], r["nbr"], r["pos"]) for r in df.collect())


@pytest.mark.parametrize("pivots", [None, 1, 7, 40])
def test_equal_distances_go_by_id(spark, pivots):
    rows = [((i * 37) % 200, [float(i % 20), float(i // 20)]) for i in range(200)]  # a lattice
    df = frame(spark, rows, "id long, x array<double>")
    assert neighbour_rows(resample.exact_neighbours(df, 5, pivots)) == by_distance_and_id(rows, 5)


@pytest.mark.parametrize("pivots", [None, 4, 30])
def test_neighbours_of_odd_points(spark, pivots):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, 2).round(2).tolist()) for i in range(90)]
    rows += [(100, [math.nan, 0.0]), (101, [0.1, math.nan]), (102, [math.inf, 0.0]), (103, [-math.inf, 0.0]), (104, [1e200, 1e200])]
    rows += [(None, [0.0, 0.0]), (None, [0.1, 0.1]), (105, [None, 0.0]), (106, [None, None])]
    df = frame(spark, rows, "id long, x array<double>")
    assert neighbour_rows(resample.exact_neighbours(df, 4, pivots)) == by_distance_and_id(rows, 4)


def test_neighbours_of_few_points_and_of_none(spark):
    rows = [(1, [0.0]), (2, [1.0]), (3, [5.0])]
    df = frame(spark, rows, "id long, x array<double>")
    for pivots in (None, 3):
        assert neighbour_rows(resample.exact_neighbours(df, 5, pivots)) == by_distance_and_id(rows, 5)
    assert resample.exact_neighbours(df.where("id > 9"), 5).count() == 0


def test_points_that_share_an_id_share_their_neighbours(spark):
    rng = np.random.default_rng(8)
    rows = [(i // 2 if i < 60 else i, rng.normal(0, 1, 2).tolist()) for i in range(150)]
    df = frame(spark, rows, "id long, x array<double>")
    assert neighbour_rows(resample.exact_neighbours(df, 3, 5)) == by_distance_and_id(rows, 3)


def test_carried_columns_are_those_of_the_neighbours(spark):
    rng = np.random.default_rng(9)
    points = {i: rng.normal(0, 1, 2).tolist() for i in range(120)}
    df = frame(spark, [(i, x, f"n{i}") for i, x in points.items()], "id long, x array<double>, name string")
    plain = {}
    for r in resample.exact_neighbours(df.select("id", "x"), 3, 6).orderBy("id", "pos").collect():
        plain.setdefault(r["id"], []).append((r["nbr"], r["dist"]))
    lists = resample.exact_neighbours(df, 3, 6, carry=["name", "x"]).collect()
    assert len(lists) == len(points)
    for r in lists:
        assert [*zip(r["nbr"], r["dist"])] == plain[r["id"]]
        assert r["nbr_name"] == [f"n{j}" for j in r["nbr"]] and r["nbr_x"] == [points[j] for j in r["nbr"]]


def test_neighbours_of_many_points(spark):
    rng = np.random.default_rng(10)
    x = np.vstack([rng.random((60_000, 2)) * [1e5, 1e6], rng.normal(2e5, 1, (20_000, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]})).select("id", F.array("a", "b").alias("x"))
    started = time.time()
    got = resample.exact_neighbours(df, 5).where("pos = 5").toPandas().set_index("id")["dist"]
    assert time.time() - started < 60  # each point meets a few hundred others, not hundreds of thousands
    assert len(got) == len(x)
    for i in range(0, len(x), 400):
        assert got[i] == np.partition(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 5)[5]


def test_smote_fails_with_too_few_neighbours(spark):
    df = frame(spark, [(i, int(i < 2), float(i), 1.0) for i in range(20)], "row_id long, y int, a double, b double")
    with pytest.raises(Exception, match="fewer than 5 minority neighbours"):
        resample.smote(df, ["a", "b"], 5, "s").collect()


def test_unknown_segment_stays_in_the_report(spark):
    base = frame(spark, [(i, "a", float(i % 7), "x") for i in range(200)], "row_id long, g string, v double, t string")
    profile = R.build_profile(base, ["t"], ["v"], group="g")
    recent = base.withColumn("g", F.when(F.col("row_id") < 100, "a").otherwise("new"))
    got = {(r["segment"], r["feature"]): r["status"] for r in R.feature_drift(profile, recent, ["t"], ["v"], group="g").collect()}
    assert got[("new", "v")] == got[("new", "t")] == "no_reference" and got[("a", "v")] != "no_reference"
    rates = [R.segment_rates(d, F.col("v") > 3, "g") for d in (base, recent)]
    verdict = {r["segment"]: r["status"] for r in R.drift_verdict(R.feature_drift(profile, recent, ["t"], ["v"], group="g"), *rates, min_samples=10).collect()}
    assert verdict["new"] == "no_reference"


def test_fingerprint_tells_nulls_and_separators_apart(spark):
    def mark(*rows):
        return tuple(C.fingerprint(frame(spark, list(rows), "a string, b string"), ["a", "b"]).first())

    assert len({mark((None, "x")), mark(("", "x")), mark(("p|q", "r")), mark(("p", "q|r")), mark(("1:p", "r"))}) == 5
    assert mark(("a", "b"), ("c", "d")) == mark(("c", "d"), ("a", "b"))


@pytest.mark.parametrize("n", [5, 20, 50])
def test_wilcoxon_is_exact_at_any_size(spark, n):
    values = [((-1) ** (i % 3)) * (i + 1 + (i % 4 == 0)) for i in range(n)]
    a = frame(spark, [(i, float(v)) for i, v in enumerate(values)], "fold int, value double")
    got = B.paired_tests(a, a.withColumn("value", F.lit(0.0)), ["fold"]).first()
    size = np.abs(values)
    ranks = [float(np.mean([i + 1 for i, v in enumerate(sorted(size)) if v == x])) for x in size]
    statistic = min(sum(r for r, v in zip(ranks, values) if v > 0), sum(r for r, v in zip(ranks, values) if v < 0))
    ways = {0.0: 1}
    for r in ranks:
        more = dict(ways)
        for total, c in ways.items():
            more[total + r] = more.get(total + r, 0) + c
        ways = more
    exact = min(1.0, 2 * sum(c for total, c in ways.items() if total <= statistic) / 2**n)
    assert got["wilcoxon_statistic"] == pytest.approx(statistic) and got["wilcoxon_p_value"] == pytest.approx(exact)


def test_smote_balances_and_keeps_the_originals(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i < 30), float(rng.normal()), float(i % 2)) for i in range(120)]
    rows += [(200 + i, 1, 5.0, 1.0) for i in range(20)]  # copies of one point
    df = frame(spark, rows, "row_id long, y int, a double, b double")
    out = resample.smote(df, ["a", "b"], 5, "s").cache()
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 90
    assert out.where("NOT is_synthetic").count() == len(rows)
    made = out.where("is_synthetic").toPandas()
    assert made.b.between(0, 1).all() and made.a.notna().all()
    again = resample.smote(df.repartition(5), ["a", "b"], 5, "s").where("is_synthetic").toPandas()
    assert np.allclose(np.sort(made.a), np.sort(again.a))


# --- encoders and contracts -----------------------------------------------------------

def test_schema_and_key_failures(spark):
    df = frame(spark, [("a", 1), ("a", 1)], "k string, v int")
    with pytest.raises(C.ContractError, match="missing"):
        C.check_schema(df, {"other": T.StringType()})
    with pytest.raises(C.ContractError, match="types differ"):
        C.check_schema(df, {"v": T.LongType()})
    with pytest.raises(C.ContractError, match="repeat"):
        C.check_unique_key(df, ["k"])


def test_record_contract(spark):
    good = '{"country": "Uganda", "size": 5}'
    bad = {
        '{"country": "uganda", "size": 5}': "country", '{"country": "Nigeria", "size": 5}': "country",
        '{"country": "Uganda", "size": 3.5}': "size", '{"country": "Uganda", "size": "5"}': "size", '{"country": "Uganda", "size": true}': "size",
        '{"country": "Uganda", "size": 0}': "size", '{"country": "Uganda", "size": 31}': "size", '{"country": "Uganda"}': "size",
        '{"country": "Uganda", "size": 5, "extra": 1}': "extra", '{"country": 3, "size": 5}': "country", "not json": "record",
    }
    df = frame(spark, [(good,), *[(b,) for b in bad]], "r string")
    checked = C.validate_records(df, "r", {"country": ["Kenya", "Uganda"]}, {"size": (1, 30)})
    valid, quarantined = C.split_valid(checked)
    assert [r["r"] for r in valid.collect()] == [good]
    rows = quarantined.collect()
    assert len(rows) == len(bad)
    for row in rows:
        assert len(row["errors"]) == 1 and row["errors"][0].startswith(bad[row["r"]])


def test_unknown_levels(spark):
    df = frame(spark, [("a", 1.0), ("b", 2.0)], "c string, x double")
    hot = P.one_hot(df, {"c": ["a"]}).orderBy("x").collect()
    assert [r["c_a"] for r in hot] == [1, 0]
    with pytest.raises(Exception, match="unknown level in c: b"):
        P.encode_strict(df, {"c": ["a"]}, ["x"]).collect()
    with pytest.raises(Exception, match="unseen level in c: b"):
        P.to_codes(df, {"c": ["a"]}, ["x"]).collect()
    with pytest.raises(Exception, match="non-finite score"):
        C.finite_score_gate(frame(spark, [(float("nan"),)], "score double")).collect()


def test_a_hundred_thousand_levels(spark):
    rows = spark.range(130_000).select(F.col("id").alias("row_id"), (F.col("id") % 100_000).cast("string").alias("c"), (F.col("id") % 3).cast("string").alias("d"), F.lit(1.5).alias("x"))
    vocab = P.vocabulary(rows, ["d", "c"])
    odd = rows.limit(50).unionByName(frame(spark, [(-1, "none", "1", 1.5), (-2, None, None, 1.5)], "row_id long, c string, d string, x double"))
    got = {r.row_id: r.hot for r in P.one_hot_sparse(odd, vocab, ["d", "c"]).collect()}
    place = {level: i for i, level in enumerate(sorted(str(i) for i in range(100_000)))}
    assert got[-1].indices == [1] and got[-2].indices == [] and got[-1].size == 100_003
    assert all(h.indices == [i % 3, 3 + place[str(i)]] for i, h in got.items() if i >= 0)
    coded = P.codes_from_table(rows, vocab, ["d", "c"], ["x"])
    back = P.levels_from_table(coded.drop("c", "d"), vocab, ["d", "c"])
    assert back.select("row_id", "c", "d").exceptAll(rows.select("row_id", "c", "d")).count() == 0 and back.count() == 130_000
    with pytest.raises(Exception, match="unseen level in c"):
        P.codes_from_table(odd, vocab, ["c"], []).collect()


def test_constant_column_scales_by_one(spark):
    df = frame(spark, [(3.0,), (3.0,)], "x double")
    assert [r["x"] for r in P.standardize(df, df, ["x"]).collect()] == [0.0, 0.0]


def test_flag_is_strict_and_drops_nothing(spark):
    df = frame(spark, [(15,), (16,)], "size int")
    assert [r["o"] for r in P.flag_above(df, "size", 15, "o").orderBy("size").collect()] == [False, True]


def test_cramers_v_of_independent_identical_and_constant_columns(spark):
    rows = [(a, b, a, "k") for a in "xyz" for b in "pq" for _ in range(10)]
    df = frame(spark, rows, "a string, b string, c string, d string")
    got = {(r["a"], r["b"]): r["v"] for r in A.association_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert got[("a", "b")] == pytest.approx(0.0, abs=1e-7)
    assert got[("a", "c")] == pytest.approx(1.0)
    assert got[("a", "d")] == 0.0


# --- group DRO ---------------------------------------------------------------------------

def dro_state(spark, losses, q=None):
    g = len(losses)
    return frame(spark, [(i, (q or [1 / g] * g)[i], float(l), 100) for i, l in enumerate(losses)], "grp int, q double, loss double, n long")


def test_dro_update(spark):
    q = {r["grp"]: r["q"] for r in L.dro_update(dro_state(spark, [0.2, 0.9, 0.4]), 0.5).collect()}
    assert sum(q.values()) == pytest.approx(1.0)
    assert q[1] > q[2] > q[0]
    raw = {i: math.exp(0.5 * l) for i, l in enumerate([0.2, 0.9, 0.4])}
    assert q[1] == pytest.approx(raw[1] / sum(raw.values()))
    same = [r["q"] for r in L.dro_update(dro_state(spark, [0.2, 0.9]), 0.0).collect()]
    assert same == [0.5, 0.5]
    huge = [r["q"] for r in L.dro_update(dro_state(spark, [1.0, 900.0]), 100.0).collect()]
    assert all(math.isfinite(v) for v in huge) and sum(huge) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        L.dro_update(dro_state(spark, [1.0]), -1.0)


def test_missing_group_raises(spark):
    df = frame(spark, [("a", 1, 0.5, 1.0)], "grp string, y int, score double, weight double")
    with pytest.raises(Exception, match="expected 2 groups"):
        A.group_mean_loss(df, n_groups=2).collect()
