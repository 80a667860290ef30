"""Queries over ranking metrics and thresholds (survey section 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import metrics as M
from plumbline.operators import splits as D
from plumbline.plans.bindings import SALES, arm_score, docs, DOCS, rounded, sales, sql_arm_score, sql_key, with_cte
from plumbline.plans.registry import query

FOLDED = f"""folded AS (
  SELECT *, {sql_arm_score('a')} AS score,
    CAST((row_number() OVER (PARTITION BY grp, y ORDER BY {sql_key('fold', 'row_id')}, row_id) - 1) % 5 AS INTEGER) AS fold FROM sales)"""


def folded(spark, sf):
    return D.stratified_folds(sales(spark, sf).withColumn("score", arm_score("a")), ["grp", "y"], 5, "fold")


def cells_sql(src: str, by: list[str], weight: str = "1", name: str = "cums") -> str:
    """CTE with per-score mass, descending prefix sums and totals."""
    keys = "".join(f"{k}, " for k in by)
    part = ("PARTITION BY " + ", ".join(by)) if by else ""
    return f"""{name} AS (
  SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp,
    sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n
  FROM (SELECT {keys}score, CAST(sum({weight} * y) AS DOUBLE) AS pos, CAST(sum({weight} * (1 - y)) AS DOUBLE) AS neg FROM {src} GROUP BY ALL))"""


AP_EXPR = "sum(CASE WHEN pos > 0 THEN pos * (tp / (tp + fp)) ELSE 0 END) / nullif(sum(pos), 0)"
AUC_EXPR = "sum(neg * (tp - pos / 2)) / nullif(sum(pos) * sum(neg), 0)"


def group_by(by: list[str]) -> str:
    return ("GROUP BY " + ", ".join(by)) if by else ""


@query("m1_confusion", with_cte(SALES, FOLDED) + """
SELECT fold, count(*) FILTER (y = 0 AND score < 0.5) AS tn, count(*) FILTER (y = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (y = 1 AND score < 0.5) AS fn, count(*) FILTER (y = 1 AND score >= 0.5) AS tp FROM folded GROUP BY fold
UNION ALL SELECT -1, count(*) FILTER (y = 0 AND score < 0.5), count(*) FILTER (y = 0 AND score >= 0.5),
  count(*) FILTER (y = 1 AND score < 0.5), count(*) FILTER (y = 1 AND score >= 0.5) FROM folded""")
def m1(spark, sf):
    per_fold = M.confusion(folded(spark, sf), 0.5, ["fold"])
    return per_fold.unionByName(M.sum_confusion(per_fold).withColumn("fold", F.lit(-1)))


THRESHOLD_SQL = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy"""
CONF_SQL = """sum(CASE WHEN y = 0 AND score < {t} THEN 1.0::DOUBLE ELSE 0 END) AS tn, sum(CASE WHEN y = 0 AND score >= {t} THEN 1.0::DOUBLE ELSE 0 END) AS fp,
  sum(CASE WHEN y = 1 AND score < {t} THEN 1.0::DOUBLE ELSE 0 END) AS fn, sum(CASE WHEN y = 1 AND score >= {t} THEN 1.0::DOUBLE ELSE 0 END) AS tp"""


@query("m2_threshold_metrics", with_cte(SALES, FOLDED) + f"""
SELECT fold, {THRESHOLD_SQL} FROM (SELECT fold, {CONF_SQL.format(t=0.9995)} FROM folded GROUP BY fold)""")
def m2(spark, sf):
    return rounded(M.threshold_metrics(folded(spark, sf), 0.9995, ["fold"]), "precision", "recall", "f1", "accuracy")


@query("m3_average_precision", with_cte(SALES, FOLDED, cells_sql("folded", ["fold"])) + f"SELECT fold, round({AP_EXPR}, 6) AS ap FROM cums GROUP BY fold")
def m3(spark, sf):
    return rounded(M.average_precision(folded(spark, sf), ["fold"]), "ap")


@query("m4_roc_auc", with_cte(SALES, FOLDED, cells_sql("folded", ["fold"])) + f"SELECT fold, round({AUC_EXPR}, 6) AS roc_auc FROM cums GROUP BY fold")
def m4(spark, sf):
    return rounded(M.roc_auc(folded(spark, sf), ["fold"]), "roc_auc")


@query("m5_weighted_ap", with_cte(SALES, FOLDED, cells_sql("folded", ["grp"], weight="(row_id % 4)")) + f"SELECT grp, round({AP_EXPR}, 6) AS ap FROM cums GROUP BY grp")
def m5(spark, sf):
    return rounded(M.average_precision(folded(spark, sf), ["grp"], weight=F.col("row_id") % 4), "ap")


@query("m6_pr_curve", with_cte(SALES, FOLDED, cells_sql("folded", ["grp"])) + """
SELECT grp, score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall, round(p / (p + n), 6) AS base_rate FROM cums""")
def m6(spark, sf):
    return rounded(M.pr_curve(folded(spark, sf), ["grp"]), "precision", "recall", "base_rate")


@query("m7_best_f1_threshold", with_cte(SALES, FOLDED, cells_sql("folded", ["fold"])) + """
, f AS (SELECT fold, score AS threshold, round(2 * (tp / (tp + fp)) * (tp / p) / ((tp / (tp + fp)) + (tp / p) + 1e-12), 12) AS f1 FROM cums)
SELECT fold, threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, threshold) AS r FROM f) WHERE r = 1""")
def m7(spark, sf):
    return rounded(M.best_f1_threshold(folded(spark, sf), ["fold"]), "f1")


SCOPED = """scoped AS (SELECT *, 'pooled' AS scope FROM folded UNION ALL SELECT *, grp AS scope FROM folded)"""


@query("m8_metrics_by_group", with_cte(SALES, FOLDED, SCOPED, cells_sql("scoped", ["fold", "scope"])) + f"""
, rk AS (SELECT fold, scope, round({AP_EXPR}, 6) AS ap, round({AUC_EXPR}, 6) AS roc_auc FROM cums GROUP BY ALL),
th AS (SELECT fold, scope, {THRESHOLD_SQL} FROM (SELECT fold, scope, {CONF_SQL.format(t=0.5)} FROM scoped GROUP BY ALL))
SELECT * FROM th JOIN rk USING (fold, scope)""")
def m8(spark, sf):
    out = M.metrics_by_group(folded(spark, sf), 0.5)
    return rounded(out, "precision", "recall", "f1", "accuracy", "ap", "roc_auc")


@query("m9_summarize", with_cte(SALES, FOLDED, SCOPED, cells_sql("scoped", ["fold", "scope"])) + f"""
, rk AS (SELECT fold, scope, {AP_EXPR} AS ap, {AUC_EXPR} AS roc_auc FROM cums GROUP BY ALL),
lg AS (SELECT scope, 'ap' AS metric, ap AS v FROM rk UNION ALL SELECT scope, 'roc_auc', roc_auc FROM rk)
SELECT scope, metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
  printf('%.3f', avg(v)) || ' ± ' || printf('%.3f', stddev_pop(v)) AS text FROM lg GROUP BY ALL""")
def m9(spark, sf):
    ranked = M.ranking_metrics(M.spread_scopes(folded(spark, sf)), ["fold", "scope"])
    return rounded(M.summarize(M.to_long(ranked, ["fold", "scope"], ["ap", "roc_auc"]), ["scope"]), "mean", "std")


def oof_sql(src: str, arms: dict[str, int], seeds: int) -> str:
    """CTE ``oof``: one score per row, arm and seed; an arm leans more or less towards the target."""
    parts = [
        f"SELECT '{arm}' AS arm, CAST(s.seed AS INTEGER) AS seed, row_id, grp, y, {sql_arm_score(arm, lean, 's.seed')} AS score FROM {src}, (SELECT unnest(range({seeds})) AS seed) s"
        for arm, lean in arms.items()
    ]
    return "oof AS (\n" + " UNION ALL\n".join(parts) + ")"


def oof(df, arms: dict[str, int], seeds: int):
    """Out-of-fold scores of several arms and seeds over the same rows."""
    base = df.select("row_id", "grp", "y").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    scores = F.array(*[F.struct(F.lit(a).alias("arm"), arm_score(a, lean, "seed").alias("score")) for a, lean in arms.items()])
    return base.select("row_id", "grp", "y", "seed", F.inline(scores))


ARMS = {"plain": 120, "weighted": 150}
ALL_SCOPES = "scoped AS (SELECT *, 'pooled' AS scope FROM oof UNION ALL SELECT *, grp AS scope FROM oof)"
DERIVED_SQL = """g AS (SELECT m.*, pv.prev FROM means m JOIN pv ON m.scope = pv.scope),
w AS (SELECT {by}, min(ap) AS w, arg_min(scope, ap) AS worst, min(ap - prev) AS w_ex, min(ap / prev) AS w_lift FROM g GROUP BY {by}),
pl AS (SELECT {by}, ap AS p FROM means WHERE scope = 'pooled'),
derived AS (SELECT {by}, 'P_c' AS metric, scope, ap AS value FROM g UNION ALL SELECT {by}, 'Ex_c', scope, ap - prev FROM g
  UNION ALL SELECT {by}, 'L_c', scope, ap / prev FROM g UNION ALL SELECT {by}, 'P', 'pooled', p FROM pl
  UNION ALL SELECT {by}, 'W', worst, w FROM w UNION ALL SELECT {by}, 'W_ex', 'pooled', w_ex FROM w UNION ALL SELECT {by}, 'W_lift', 'pooled', w_lift FROM w
  UNION ALL SELECT {by}, 'G', 'pooled', p - w FROM pl JOIN w USING ({by}))"""


@query("m10_fairness_metrics", with_cte(SALES, oof_sql("sales", ARMS, 2), ALL_SCOPES, cells_sql("scoped", ["arm", "seed", "scope"])) + f"""
, ap AS (SELECT arm, seed, scope, {AP_EXPR} AS ap FROM cums GROUP BY ALL),
means AS (SELECT arm, scope, avg(ap) AS ap FROM ap GROUP BY ALL), pv AS (SELECT grp AS scope, avg(y) AS prev FROM sales GROUP BY grp),
{DERIVED_SQL.format(by='arm')}
SELECT arm, metric, scope, round(value, 6) AS value FROM derived""")
def m10(spark, sf):
    return rounded(M.fairness_metrics(oof(sales(spark, sf), ARMS, 2)), "value")


@query("m11_selection_score", with_cte(SALES, FOLDED, cells_sql("folded", ["fold"], name="c1"), cells_sql("folded", ["fold", "grp"], name="c2")) + f"""
SELECT 'pooled' AS kind, fold, round({AP_EXPR}, 6) AS selection FROM c1 GROUP BY fold
UNION ALL SELECT 'worst_group', fold, round(min(ap), 6) FROM (SELECT fold, grp, {AP_EXPR} AS ap FROM c2 GROUP BY ALL) GROUP BY fold""")
def m11(spark, sf):
    rows = folded(spark, sf)
    parts = [M.selection_score(rows, kind, ["fold"]).withColumn("kind", F.lit(kind)) for kind in ("pooled", "worst_group")]
    return rounded(parts[0].unionByName(parts[1]), "selection")


@query("m12_fold_mean_ap", with_cte(SALES, FOLDED, cells_sql("folded", ["fold"], name="c1"), cells_sql("folded", [], name="c2")) + f"""
SELECT round((SELECT avg(ap) FROM (SELECT {AP_EXPR} AS ap FROM c1 GROUP BY fold)), 6) AS fold_mean_ap,
       round((SELECT {AP_EXPR} FROM c2), 6) AS concatenated_ap""")
def m12(spark, sf):
    return rounded(M.fold_mean_ap(folded(spark, sf)), "fold_mean_ap", "concatenated_ap")


@query("m3_average_precision_docs", with_cte(DOCS, f"scored AS (SELECT *, {sql_arm_score('a')} AS score FROM docs)", cells_sql("scored", ["grp"])) + f"SELECT grp, round({AP_EXPR}, 6) AS ap, round({AUC_EXPR}, 6) AS roc_auc FROM cums GROUP BY grp")
def m3_docs(spark, sf):
    return rounded(M.ranking_metrics(docs(spark, sf).withColumn("score", arm_score("a")), ["grp"]), "ap", "roc_auc")
