"""Queries that fit Spark ML models on the given tables (survey section 2.11).

Most results depend on the optimiser and have no SQL; row counts and coverage do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.session import scratch_path
from plumbline.operators import metrics as M
from plumbline.operators import models as L
from plumbline.operators import profile as A
from plumbline.operators import weights as W
from plumbline.operators.dro import batched_group_dro
from plumbline.plans.bindings import DOCS, SALES, arm_score, docs, rounded, sales, sql_arm_score, table, with_cte
from plumbline.plans.profile import LOSS
from plumbline.plans.registry import query
from plumbline.plans.splits import rank_sql

FAST = {"maxIter": 8, "regParam": 0.01}
TREES = {"maxIter": 3, "maxDepth": 3}
FEATURES = L.FeatureSet(("grp", "source"), ("n_kchars",))
SALES_FEATURES = L.FeatureSet(("grp", "priority", "segment"), ("price_s", "balance_s"))


def doc_rows(spark, sf):
    return docs(spark, sf).withColumn("n_kchars", F.col("n_chars") / 1000.0)


def sale_rows(spark, sf):
    s = sales(spark, sf)
    return s.select("row_id", "grp", "y", "priority", "segment", (F.col("price") / 1e5).alias("price_s"), (F.col("balance") / 1e3).alias("balance_s"), "order_year")


def scored_summary(df):
    return df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


@query("l1_fit_logistic")
def l1(spark, sf):
    rows = sale_rows(spark, sf)
    model = L.fit_logistic(SALES_FEATURES)(W.class_weights(rows.where("order_year < 1999")), FAST)
    return scored_summary(L.score(model, rows.where("order_year >= 1999")))


@query("l2_fit_boosted_trees")
def l2(spark, sf):
    rows = sale_rows(spark, sf)
    model = L.fit_boosted_trees(SALES_FEATURES)(W.positive_class_weight(rows.where("order_year < 1999")), TREES)
    return scored_summary(L.score(model, rows.where("order_year >= 1999")))


@query("l3_fit_factorized")
def l3(spark, sf):
    rows = sale_rows(spark, sf)
    model = L.fit_factorized(SALES_FEATURES)(W.group_weights(rows.where("order_year < 1999")), {"maxIter": 5, "factorSize": 3})
    return scored_summary(L.score(model, rows.where("order_year >= 1999")))


@query("l4_score", with_cte(SALES) + "SELECT grp, count(*) AS n, count(*) AS n_probabilities FROM sales GROUP BY grp")
def l4(spark, sf):
    rows = sale_rows(spark, sf)
    model = L.fit_logistic(SALES_FEATURES)(rows, FAST)
    return L.score(model, rows).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score").between(0, 1)).alias("n_probabilities"))


@query("l5_cross_validate")
def l5(spark, sf):
    oof = L.cross_validate(doc_rows(spark, sf), L.fit_logistic(FEATURES), FAST, k=3)
    return M.summarize(L.fold_metrics(oof), ["scope"])


@query("l5_out_of_fold_coverage", with_cte(DOCS) + "SELECT grp, count(*) AS n, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS positives FROM docs GROUP BY grp")
def l5_coverage(spark, sf):
    oof = L.cross_validate(doc_rows(spark, sf), L.fit_logistic(FEATURES), FAST, k=3)
    return oof.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("n_rows"), F.sum("y").alias("positives"))


SPACE = ({"maxIter": 5, "regParam": 0.001}, {"maxIter": 5, "regParam": 0.1})


@query("l6_nested_cv")
def l6(spark, sf):
    result = L.nested_cv(doc_rows(spark, sf), L.fit_logistic(FEATURES), SPACE, k=2, inner=2)
    return M.summarize(result.metrics(), ["scope"])


@query("l7_search")
def l7(spark, sf):
    _, scored = L.search(doc_rows(spark, sf), L.fit_logistic(FEATURES), SPACE, folds=2, selection="worst_group")
    return scored


@query("l8_ablation_grid")
def l8(spark, sf):
    arms = [L.Arm("logistic", L.fit_logistic(FEATURES), space=(FAST,)), L.Arm("trees", L.fit_boosted_trees(FEATURES), W.no_resampling, (TREES,))]
    return L.ablation_grid(doc_rows(spark, sf), arms, k=2)["summary"]


@query("l9_refit_production")
def l9(spark, sf):
    from pyspark.ml import PipelineModel

    rows = doc_rows(spark, sf)
    arm = L.Arm("logistic", L.fit_logistic(FEATURES), space=(FAST,))
    result = L.nested_cv(rows, arm.fit, arm.space, k=2)
    thresholds = result.oof.select("fold", "threshold").distinct()
    saved = L.refit_production(rows, {"logistic": arm}, "logistic", "logistic", FAST, thresholds, scratch_path(spark, "production"))
    model = PipelineModel.load(f"{saved['path']}/model")
    return A.positive_share(L.score(model, rows), saved["threshold"], ["grp"])


@query("l10_dro_update", with_cte(SALES) + f"""
, w AS (SELECT grp, y, {sql_arm_score('a')} AS s FROM sales), g AS (SELECT grp, count(*) AS n, avg({LOSS.format(s='s')}) AS loss FROM w GROUP BY grp),
m AS (SELECT *, (1.0 / count(*) OVER ()) * exp(0.5 * (loss + 2 / sqrt(n))) AS u FROM g)
SELECT grp, round(u / sum(u) OVER (), 6) AS q, round(loss, 6) AS loss FROM m""")
def l10_update(spark, sf):
    rows = W.no_resampling(sales(spark, sf)).withColumns({"score": arm_score("a"), "weight": F.lit(1.0)})
    state = A.group_mean_loss(rows)
    groups = state.agg(F.count(F.lit(1)).alias("g")).scalar()
    uniform = state.withColumn("q", 1 / groups)
    return rounded(L.dro_update(uniform, 0.5, 2.0).select("grp", "q", "loss"), "q", "loss")


@query("l10_group_dro")
def l10(spark, sf):
    _, history = L.group_dro(doc_rows(spark, sf), L.fit_logistic(FEATURES), FAST, rounds=2, step=0.5, adjustment=1.0)
    return history


BATCH, STEP, RATE, ADJUST = 64, 0.5, 0.05, 1.0


def dro_step_sql(name: str, before: str, score: str, model: str, step: int) -> str:
    """Losses, gradients and q of one step: ``before`` gives q by group, ``score`` the probability from ``model``."""
    loss = LOSS.format(s="s")
    return f"""{name}_l AS (SELECT grp, avg({loss}) AS loss, avg(s - y) AS gb, avg((s - y) * x) AS gx FROM (SELECT bt.*, {score} AS s FROM bt{model} WHERE step = {step}) GROUP BY grp),
{name}_u AS (SELECT l.*, g.n, b.q * exp({STEP} * (l.loss + {ADJUST} / sqrt(g.n))) AS u FROM {name}_l l JOIN g USING (grp) JOIN {before} b USING (grp)),
{name} AS (SELECT *, u / sum(u) OVER () AS q FROM {name}_u)"""


@query("l10_batched_dro", with_cte(DOCS) + f"""
, g AS (SELECT grp, count(*) AS n, floor({BATCH} / count(*) OVER ()) AS per, ceil(sum(count(*)) OVER () / {BATCH}) AS steps FROM docs GROUP BY grp),
p AS (SELECT d.row_id, d.y, d.n_chars / 10000.0 AS x, g.*, unnest(range(CAST(ceil(per * steps / n) AS BIGINT))) AS pass FROM docs d JOIN g USING (grp)),
o AS (SELECT *, pass * n + {rank_sql('grp, pass', 'dro', 'pass')} - 1 AS o FROM p),
bt AS (SELECT CAST(floor(o / per) AS INTEGER) AS step, grp, y, x FROM o WHERE floor(o / per) < 2),
q00 AS (SELECT grp, 1.0 / count(*) OVER () AS q FROM g),
{dro_step_sql('q0', 'q00', '0.5::DOUBLE', '', 0)},
w1 AS (SELECT -{RATE} * sum(q * gb) AS b, -{RATE} * sum(q * gx) AS w FROM q0),
{dro_step_sql('q1', 'q0', '1 / (1 + exp(-(w1.b + w1.w * x)))', ', w1', 1)}
SELECT 0 AS step, grp, round(q, 6) AS q, round(loss, 6) AS loss, round(sum(q * (loss + {ADJUST} / sqrt(n))) OVER (), 6) AS objective FROM q0
UNION ALL SELECT 1, grp, round(q, 6), round(loss, 6), round(sum(q * (loss + {ADJUST} / sqrt(n))) OVER (), 6) FROM q1""")
def l10_batched(spark, sf):
    rows = docs(spark, sf).select("row_id", "grp", "y", (F.col("n_chars") / 10000.0).alias("x"))
    _, history = batched_group_dro(rows, ["x"], BATCH, 2, STEP, RATE, ADJUST, seed="dro")
    return rounded(history, "q", "loss", "objective")


@query("l1_saturated_logistic", with_cte(SALES) + "SELECT priority, round(avg(y), 3) AS score FROM sales GROUP BY priority")
def l1_saturated(spark, sf):
    """Without a penalty, a model with one parameter per level gives each level's rate."""
    rows = sales(spark, sf).select("row_id", "grp", "y", "priority")
    model = L.fit_logistic(L.FeatureSet(("priority",)))(rows, {"maxIter": 200, "regParam": 0.0, "tol": 1e-8})
    return L.score(model, rows).groupBy("priority").agg(F.round(F.avg("score"), 3).alias("score"))


@query("l2_single_split", with_cte(SALES) + """
SELECT x, round(1 / (1 + exp(-2 * (2 * avg(y) - 1))), 6) AS score FROM (SELECT y, (order_year < 1996)::INT AS x FROM sales) GROUP BY x""")
def l2_single(spark, sf):
    """One boosting step of depth 1 on a binary feature: each side's mean of the label as -1 or 1."""
    rows = sales(spark, sf).select("row_id", "grp", "y", (F.col("order_year") < 1996).cast("int").alias("x"))
    model = L.fit_boosted_trees(L.FeatureSet(numeric=("x",)))(rows, {"maxIter": 1, "maxDepth": 1})
    return L.score(model, rows).groupBy("x").agg(F.round(F.avg("score"), 6).alias("score"))


@query("l11_vector_head")
def l11(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", (F.col("label") % 3).alias("grp"), (F.col("label") < 5).cast("int").alias("y"))
    parts = [L.vector_head(rows.where("row_id % 2 = 1"), rows.where("row_id % 2 = 0"), o, rounds=2, params=FAST).withColumn("objective", F.lit(o)) for o in ("erm", "dro")]
    scored = parts[0].unionByName(parts[1])
    return M.ranking_metrics(scored, ["objective"])


@query("l12_run_arms", with_cte(DOCS) + """
SELECT 'nested' AS design, 'child' AS arm, 0 AS seed, count(*) AS n FROM docs UNION ALL SELECT 'nested', 'parent', 0, count(*) FROM docs""")
def l12(spark, sf):
    path = scratch_path(spark, "arms")
    parent = L.Arm("parent", L.fit_logistic(FEATURES), space=(FAST,))
    child = L.Arm("child", L.fit_logistic(FEATURES), W.class_by_group_weights, ({"maxIter": 2},), params_from="parent")
    rows = doc_rows(spark, sf)
    L.run_arms(rows, [parent], ["nested"], [0], path, k=2)
    done = L.run_arms(rows, [parent, child], ["nested"], [0], path, k=2)
    return done.groupBy("design", "arm", "seed").agg(F.sum("val_rows").alias("n"))


@query("l13_preprocessing_leak")
def l13(spark, sf):
    return L.preprocessing_leak(doc_rows(spark, sf), FEATURES, L.fit_logistic, FAST, k=2)
