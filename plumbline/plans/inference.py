"""Queries over bootstrap inference and rank correlation (survey section 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.session import cut
from plumbline.operators import inference as B
from plumbline.operators import metrics as M
from plumbline.plans.bindings import (
    DOCS, EVENTS, SALES, arm_score, attribution, docs, events, rounded, sales, sql_arm_score, sql_attribution, sql_int,
    sql_key, with_cte,
)
from plumbline.plans.contracts import FOLD_AP, fold_ap
from plumbline.plans.metrics import ALL_SCOPES, AP_EXPR, DERIVED_SQL, cells_sql, oof, oof_sql
from plumbline.plans.registry import query


def draws_sql(src: str, strata: list[str], reps: int, seed: str) -> str:
    """CTE ``draws``: rep, row_id, c."""
    part = ("PARTITION BY " + ", ".join(strata)) if strata else ""
    keys = "".join(f"{s}, " for s in strata)
    same = " AND ".join([f"d.{s} = r.{s}" for s in strata] + ["d.hit = r.rk"])
    label = " || '_' || ".join(strata) if strata else "''"
    return f"""slots AS (SELECT {keys}row_id, {label} AS lab, row_number() OVER ({part} ORDER BY {sql_key(seed + '-slot', 'row_id')}, row_id) AS rk,
    count(*) OVER ({part}) AS n FROM {src}),
hits AS (SELECT {keys}rep, {sql_int(seed, 'rep', 'lab', 'rk')} % n + 1 AS hit FROM slots, (SELECT CAST(unnest(range({reps})) AS INTEGER) AS rep)),
draws AS (SELECT d.rep, r.row_id, count(*) AS c FROM hits d JOIN slots r ON {same} GROUP BY ALL)"""


@query("b1_bootstrap_draws", with_cte(SALES, draws_sql("sales", ["grp", "y"], 4, "boot")) + "SELECT rep, row_id, c FROM draws")
def b1(spark, sf):
    return B.bootstrap_draws(sales(spark, sf), ["grp", "y"], 4, "boot")


@query("b2_bootstrap_ci", with_cte(SALES, draws_sql("sales", [], 30, "ci")) + """
, st AS (SELECT rep, grp, sum(c * y) / sum(c) AS v FROM draws JOIN sales USING (row_id) GROUP BY ALL)
SELECT p.grp, round(p.estimate, 6) AS estimate, round(quantile_cont(v, 0.05), 6) AS ci_low, round(quantile_cont(v, 0.95), 6) AS ci_high, count(v) AS reps
FROM (SELECT grp, avg(y) AS estimate FROM sales GROUP BY grp) p JOIN st USING (grp) GROUP BY p.grp, p.estimate""")
def b2(spark, sf):
    def positive_rate(rows, by):
        return rows.groupBy(*by, "grp").agg((F.sum(F.col("c") * F.col("y")) / F.sum("c")).alias("value"))

    out = B.bootstrap_ci(sales(spark, sf).select("row_id", "grp", "y"), positive_rate, ["grp"], 30, "ci", level=0.9)
    return rounded(out, "estimate", "ci_low", "ci_high")


def poisson_sql(src: str, reps: int, seed: str, name: str = "pois") -> str:
    """CTE of the rows with rep and c > 0, and every row once as replicate -1."""
    n, d = B.POISSON_PER_HASH, B.POISSON_DIGITS
    count = " + ".join(f"(u >= {limit})::BIGINT" for limit in B.poisson_limits())
    return f"""{name} AS (SELECT * FROM (SELECT * EXCLUDE (u), {count} AS c FROM (
    SELECT * EXCLUDE (h, b), b * {n} + i AS rep, CAST('0x' || substr(h, {d} * i + 1, {d}) AS INTEGER) AS u FROM (
      SELECT s.*, b, {sql_key(seed + '-poisson', 'row_id', 'b')} AS h FROM {src} s, (SELECT CAST(unnest(range({-(-reps // n)})) AS INTEGER) AS b)),
    (SELECT CAST(unnest(range({n})) AS INTEGER) AS i))) WHERE c > 0 AND rep < {reps}
  UNION ALL BY NAME SELECT *, -1 AS rep, 1 AS c FROM {src})"""


POISSON_REPS = 200


@query("b2_poisson_ci", with_cte(SALES, "few AS (SELECT row_id, grp, y FROM sales)", poisson_sql("few", POISSON_REPS, "ci")) + """
, st AS (SELECT rep, grp, sum(c * y) / sum(c) AS v FROM pois GROUP BY ALL)
SELECT grp, round(max(v) FILTER (rep = -1), 6) AS estimate, round(quantile_cont(v, 0.05) FILTER (rep >= 0), 6) AS ci_low,
  round(quantile_cont(v, 0.95) FILTER (rep >= 0), 6) AS ci_high, count(v) FILTER (rep >= 0) AS reps, true AS approximate FROM st GROUP BY grp""")
def b2_poisson(spark, sf):
    def positive_rate(rows, by):
        return rows.groupBy(*by, "grp").agg((F.sum(F.col("c") * F.col("y")) / F.sum("c")).alias("value"))

    out = B.bootstrap_ci(sales(spark, sf).select("row_id", "grp", "y"), positive_rate, ["grp"], POISSON_REPS, "ci", level=0.9, poisson=True)
    return rounded(out, "estimate", "ci_low", "ci_high")


ROWS_A = "rws AS (SELECT DISTINCT row_id FROM a)"


@query("b3_importance_ci", with_cte(sql_attribution("a", 1, 32, "a"), ROWS_A, draws_sql("rws", [], 50, "imp")) + """
, st AS (SELECT rep, feature, sum(c * abs(value)) / sum(c) AS v FROM draws JOIN a USING (row_id) GROUP BY ALL)
SELECT p.feature, round(p.estimate, 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high, count(v) AS reps
FROM (SELECT feature, avg(abs(value)) AS estimate FROM a GROUP BY feature) p JOIN st USING (feature) GROUP BY p.feature, p.estimate""")
def b3(spark, sf):
    return rounded(B.importance_ci(attribution(spark, sf, 1, 32, "a"), 50, "imp"), "estimate", "ci_low", "ci_high")


SCORED_A = f"scored AS (SELECT row_id, grp, y, {sql_arm_score('a')} AS score FROM sales)"
WEIGHTED = """wtd AS (SELECT d.rep, d.c, s.* FROM draws d JOIN {src} s USING (row_id) UNION ALL SELECT -1, 1, s.* FROM {src} s),
wscoped AS (SELECT *, 'pooled' AS scope FROM wtd UNION ALL SELECT *, grp AS scope FROM wtd)"""


@query("b4_bootstrap_ap", with_cte(SALES, SCORED_A, draws_sql("sales", ["grp", "y"], 10, "ap"), WEIGHTED.format(src="scored"), cells_sql("wscoped", ["rep", "scope"], "c")) + f"""
SELECT rep, scope, round({AP_EXPR}, 6) AS ap FROM cums GROUP BY ALL""")
def b4(spark, sf):
    s = sales(spark, sf).withColumn("score", arm_score("a")).select("row_id", "grp", "y", "score")
    draws = B.bootstrap_draws(s, ["grp", "y"], 10, "ap")
    return rounded(B.bootstrap_scope_ap(s, draws, []), "ap")


POISSON_SCOPED = "wscoped AS (SELECT * EXCLUDE (grp), 'pooled' AS scope FROM pois UNION ALL SELECT * EXCLUDE (grp), grp AS scope FROM pois)"


@query("b4_poisson_ap", with_cte(SALES, SCORED_A, poisson_sql("scored", POISSON_REPS, "ap"), POISSON_SCOPED, cells_sql("wscoped", ["rep", "scope"], "c")) + f"""
, ap AS (SELECT rep, scope, {AP_EXPR} AS v FROM cums GROUP BY ALL)
SELECT scope, round(max(v) FILTER (rep = -1), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (rep >= 0), 6) AS ci_low,
  round(quantile_cont(v, 0.975) FILTER (rep >= 0), 6) AS ci_high, count(v) FILTER (rep >= 0) AS reps FROM ap GROUP BY scope""")
def b4_poisson(spark, sf):
    s = sales(spark, sf).withColumn("score", arm_score("a")).select("row_id", "grp", "y", "score")
    values = B.poisson_scope_ap(s, POISSON_REPS, "ap", []).withColumnRenamed("ap", "value")
    return rounded(B.point_and_interval(values, ["scope"]), "estimate", "ci_low", "ci_high")


ARMS = {"plain": 100, "weighted": 200, "robust": 300}
REPS = 20
SPECS = [
    ("weighting", "weighted", ["plain"], ["P", "W", "G"]),
    ("best single", "robust", ["plain", "weighted"], ["P", "W"]),
    ("absent", "boosted", ["plain"], ["P"]),
]
REPLICATES = f"""{oof_sql('docs', ARMS, 2)},
{draws_sql('docs', ['grp', 'y'], REPS, 'paired')}, {WEIGHTED.format(src='oof')},
{cells_sql('wscoped', ['arm', 'seed', 'rep', 'scope'], 'c')},
apx AS (SELECT arm, seed, rep, scope, {AP_EXPR} AS ap FROM cums GROUP BY ALL),
pv AS (SELECT grp AS scope, avg(y) AS prev FROM docs GROUP BY grp),
means0 AS (SELECT arm, rep, scope, avg(ap) AS ap FROM apx GROUP BY ALL)"""


def top_sql(src: str, index: str, name: str) -> str:
    """P, W and G per arm and replicate or seed."""
    return f"""{name} AS (SELECT arm, {index}, unnest(['P', 'W', 'G']) AS metric, unnest([p, w, p - w]) AS value FROM (
  SELECT arm, {index}, max(ap) FILTER (scope = 'pooled') AS p, min(ap) FILTER (scope <> 'pooled') AS w FROM {src} GROUP BY ALL))"""


def paired_sql() -> str:
    spec_rows = ", ".join(f"('{f}', '{a}', '{' or '.join(bs)}', '{m}', '{b}')" for f, a, bs, ms in SPECS for m in ms for b in bs)
    return f"""{top_sql('means0', 'rep', 'boot')}, {top_sql("(SELECT arm, seed, scope, ap FROM apx WHERE rep = -1)", 'seed', 'seeds')},
spec(family, a, b_label, metric, b) AS (VALUES {spec_rows}),
bd AS (SELECT s.family, s.a, s.b_label, s.metric, x.rep, any_value(x.value) - max(y.value) AS d
  FROM spec s JOIN boot x ON x.arm = s.a AND x.metric = s.metric JOIN boot y ON y.arm = s.b AND y.metric = s.metric AND y.rep = x.rep GROUP BY ALL),
sd AS (SELECT s.family, s.a, s.b_label, s.metric, x.seed, any_value(x.value) - max(y.value) AS d
  FROM spec s JOIN seeds x ON x.arm = s.a AND x.metric = s.metric JOIN seeds y ON y.arm = s.b AND y.metric = s.metric AND y.seed = x.seed GROUP BY ALL),
pd AS (SELECT family, a, b_label AS b, metric, max(d) FILTER (rep = -1) AS difference,
  quantile_cont(d, 0.025) FILTER (rep <> -1) AS ci_low, quantile_cont(d, 0.975) FILTER (rep <> -1) AS ci_high,
  least(1.0, 2 * least(avg((d <= 0)::INT) FILTER (rep <> -1), avg((d >= 0)::INT) FILTER (rep <> -1))) AS p_two_sided,
  avg((d <= 0)::INT) FILTER (rep <> -1) AS p_greater FROM bd GROUP BY ALL),
ss AS (SELECT family, a, b_label AS b, metric, stddev_samp(d) AS seed_sd FROM sd GROUP BY ALL),
paired AS (SELECT pd.*, ss.seed_sd FROM pd JOIN ss USING (family, a, b, metric))"""


PAIRED_COLUMNS = ["difference", "ci_low", "ci_high", "p_two_sided", "p_greater", "seed_sd"]
ROUND_PAIRED = ", ".join(f"round({c}, 6) AS {c}" for c in PAIRED_COLUMNS)


def replicates(spark, sf):
    return B.metric_replicates(oof(docs(spark, sf), ARMS, 2), REPS, "paired")


@query("b5_paired", with_cte(DOCS, REPLICATES, paired_sql()) + f"SELECT family, a, b, metric, {ROUND_PAIRED} FROM paired")
def b5(spark, sf):
    reps, per_seed = replicates(spark, sf)
    return rounded(B.paired(reps, per_seed, B.spec_table(spark, SPECS)), *PAIRED_COLUMNS)


HOLM_SQL = "max(least(1.0, (m - rk + 1) * p)) OVER (PARTITION BY {f} ORDER BY rk ROWS UNBOUNDED PRECEDING)"


@query("b6_holm", """
WITH t AS (SELECT p_type AS family, p_brand AS item, avg((p_size <= 3)::INT) AS p FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, item) AS rk, count(*) OVER (PARTITION BY family) AS m FROM t)
SELECT family, item, round(p, 6) AS p, round(""" + HOLM_SQL.format(f="family") + ", 6) AS p_holm FROM r")
def b6(spark, sf):
    from plumbline.plans.bindings import table

    rates = table(spark, sf, "part").groupBy(F.col("p_type").alias("family"), F.col("p_brand").alias("item")).agg(
        F.avg((F.col("p_size") <= 3).cast("int")).alias("p")
    )
    return rounded(B.holm(rates, "p", ["family"], tie=["item"]), "p", "p_holm")


@query("b7_comparison_table", with_cte(DOCS, REPLICATES, paired_sql()) + f"""
, r AS (SELECT *, p_two_sided AS p, row_number() OVER (PARTITION BY family ORDER BY p_two_sided, a, b, metric) AS rk, count(*) OVER (PARTITION BY family) AS m FROM paired),
h AS (SELECT *, {HOLM_SQL.format(f='family')} AS p_holm FROM r)
SELECT family, a, b, metric, {ROUND_PAIRED}, round(p_holm, 6) AS p_holm, CAST(NULL AS VARCHAR) AS missing_arms FROM h
UNION ALL SELECT 'absent', 'boosted', 'plain', 'P', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'boosted'""")
def b7(spark, sf):
    reps, per_seed = replicates(spark, sf)
    return rounded(B.comparison_table(reps, per_seed, B.spec_table(spark, SPECS)), *PAIRED_COLUMNS, "p_holm")


LOCO = {"plain": 60, "weighted": 250, "robust": 480}
LOCO_SQL = f"""{oof_sql('docs', LOCO, 2)}, {draws_sql('docs', ['grp', 'y'], REPS, 'loco')}, {WEIGHTED.format(src='oof')},
{cells_sql('wtd', ['grp', 'arm', 'seed', 'rep'], 'c')},
apx AS (SELECT grp AS held_out, arm, seed, rep, {AP_EXPR} AS ap FROM cums GROUP BY ALL),
boot AS (SELECT held_out, arm, rep, avg(ap) AS value FROM apx GROUP BY ALL),
bd AS (SELECT x.held_out, x.arm AS a, y.arm AS b, x.rep, x.value - y.value AS d FROM boot x JOIN boot y ON x.held_out = y.held_out AND x.rep = y.rep AND x.arm < y.arm),
sd AS (SELECT x.held_out, x.arm AS a, y.arm AS b, stddev_samp(x.ap - y.ap) AS seed_sd FROM apx x JOIN apx y ON x.held_out = y.held_out AND x.seed = y.seed AND x.rep = -1 AND y.rep = -1 AND x.arm < y.arm GROUP BY ALL),
pd AS (SELECT held_out, a, b, max(d) FILTER (rep = -1) AS difference, quantile_cont(d, 0.025) FILTER (rep <> -1) AS ci_low, quantile_cont(d, 0.975) FILTER (rep <> -1) AS ci_high,
  least(1.0, 2 * least(avg((d <= 0)::INT) FILTER (rep <> -1), avg((d >= 0)::INT) FILTER (rep <> -1))) AS p, avg((d <= 0)::INT) FILTER (rep <> -1) AS p_greater FROM bd GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY p, a, b) AS rk, count(*) OVER (PARTITION BY held_out) AS m FROM pd),
pairs AS (SELECT *, {HOLM_SQL.format(f='held_out')} AS p_holm FROM rk)"""


def loco(spark, sf):
    rows = oof(docs(spark, sf), LOCO, 2)
    base = rows.select("row_id", "grp", "y").distinct()
    draws = B.bootstrap_draws(base, ["grp", "y"], REPS, "loco")
    weighted = B.with_draws(rows, draws)
    ap = cut(M.average_precision(weighted, ["grp", "arm", "seed", "rep"], F.col("c")))
    ap = ap.withColumnRenamed("grp", "held_out").withColumn("metric", F.lit("P"))
    boot = ap.groupBy("held_out", "arm", "rep", "metric").agg(F.avg("ap").alias("value"))
    per_seed = ap.where(F.col("rep") == B.POINT).select("held_out", "arm", "seed", "metric", F.col("ap").alias("value"))
    return boot, per_seed


@query("b8_transfer_pairs", with_cte(DOCS, LOCO_SQL) + """
SELECT held_out, 'transfer' AS family, a, b, 'P' AS metric, round(difference, 6) AS difference, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high,
  round(p, 6) AS p_two_sided, round(p_greater, 6) AS p_greater, round(seed_sd, 6) AS seed_sd, round(p_holm, 6) AS p_holm FROM pairs JOIN sd USING (held_out, a, b)""")
def b8(spark, sf):
    return rounded(B.transfer_pairs(*loco(spark, sf)), *PAIRED_COLUMNS, "p_holm")


@query("b8_consistency", with_cte(DOCS, LOCO_SQL) + """
, s AS (SELECT held_out, a AS arm, difference AS signed, p_holm FROM pairs UNION ALL SELECT held_out, b, -difference, p_holm FROM pairs),
g AS (SELECT held_out, arm, bool_and(p_holm < 0.05 AND signed > 0) AS beats, bool_or(p_holm < 0.05 AND signed < 0) AS beaten FROM s GROUP BY ALL),
best AS (SELECT held_out, arm AS best FROM (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY value DESC, arm DESC) AS r FROM boot WHERE rep = -1) WHERE r = 1)
SELECT arm, count(*) AS held_out_groups, count(*) FILTER (beats AND best = arm) AS clear_wins, bool_or(beaten) AS ever_clearly_beaten,
  count(*) FILTER (beats AND best = arm) >= 3 AND NOT bool_or(beaten) AS consistently_better FROM g JOIN best USING (held_out) GROUP BY arm""")
def b8_consistency(spark, sf):
    boot, per_seed = loco(spark, sf)
    points = boot.where(F.col("rep") == B.POINT).select("held_out", "arm", "value")
    return B.consistency(B.transfer_pairs(boot, per_seed), points)


@query("b8_transfer_drop", with_cte(DOCS, LOCO_SQL) + """
, d AS (SELECT x.held_out, x.rep, x.value AS w, y.value AS h FROM boot x JOIN boot y ON x.held_out = y.held_out AND x.rep = y.rep AND x.arm = 'robust' AND y.arm = 'plain')
SELECT held_out, 'model' AS arm, round(max(w) FILTER (rep = -1), 6) AS within, round(max(h) FILTER (rep = -1), 6) AS held_out_ap, round(max(w - h) FILTER (rep = -1), 6) AS drop,
  round(quantile_cont(w - h, 0.025) FILTER (rep <> -1), 6) AS ci_low, round(quantile_cont(w - h, 0.975) FILTER (rep <> -1), 6) AS ci_high FROM d GROUP BY held_out""")
def b8_drop(spark, sf):
    boot, _ = loco(spark, sf)
    within = boot.where("arm = 'robust'").withColumn("arm", F.lit("model"))
    held = boot.where("arm = 'plain'").withColumn("arm", F.lit("model"))
    return rounded(B.transfer_drop(within, held), "within", "held_out_ap", "drop", "ci_low", "ci_high")


@query("b9_paired_tests", with_cte(SALES, FOLD_AP) + """
, d AS (SELECT x.ap - y.ap AS d FROM fold_ap x JOIN fold_ap y ON x.fold = y.fold AND x.arm = 'a' AND y.arm = 'b'),
s AS (SELECT count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d),
k AS (SELECT d, row_number() OVER (ORDER BY abs(d)) AS r FROM d),
wp AS (SELECT CAST(least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)) AS DOUBLE) AS w, sum(r) FILTER (d > 0) AS a, sum(r) FILTER (d < 0) AS b FROM k),
wq AS (SELECT CAST(least(coalesce(a, 0), coalesce(b, 0)) AS DOUBLE) AS w FROM wp),
pat AS (SELECT m, (CASE WHEN m & 1 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN m & 2 <> 0 THEN 2 ELSE 0 END) + (CASE WHEN m & 4 <> 0 THEN 3 ELSE 0 END)
  + (CASE WHEN m & 8 <> 0 THEN 4 ELSE 0 END) + (CASE WHEN m & 16 <> 0 THEN 5 ELSE 0 END) AS v FROM (SELECT unnest(range(32)) AS m))
SELECT n, round(t, 6) AS t_statistic, round(1 - sin(atan(abs(t) / 2)) * (1 + 0.5 * cos(atan(abs(t) / 2)) * cos(atan(abs(t) / 2))), 6) AS t_p_value,
  w AS wilcoxon_statistic, round(least(1.0, 2 * (SELECT count(*) FROM pat WHERE v <= w) / 32), 6) AS wilcoxon_p_value FROM s, wq""")
def b9(spark, sf):
    ap = fold_ap(spark, sf).withColumnRenamed("ap", "value")
    out = B.paired_tests(ap.where("arm = 'a'"), ap.where("arm = 'b'"), ["fold"])
    return rounded(out, "t_statistic", "t_p_value", "wilcoxon_p_value")


HALF_SIZE, HALF_REPS = 12, 4


def disagreement_sql(pairs: str, name: str) -> str:
    """Spearman, Kendall and top-3 disagreement of importance rows ``imp(k, feature, v)`` for pairs ``(rep, ka, kb)``."""
    return f"""{name}_x AS (SELECT p.rep, p.ka, p.kb, a.feature, a.v AS va, b.v AS vb FROM {pairs} p JOIN imp a ON a.k = p.ka JOIN imp b ON b.k = p.kb AND a.feature = b.feature),
{name}_r AS (SELECT *, rank() OVER (PARTITION BY ka, kb ORDER BY va) AS ra, rank() OVER (PARTITION BY ka, kb ORDER BY vb) AS rb,
   row_number() OVER (PARTITION BY ka, kb ORDER BY va DESC, feature) AS ta, row_number() OVER (PARTITION BY ka, kb ORDER BY vb DESC, feature) AS tb FROM {name}_x),
{name}_s AS (SELECT rep, ka, kb, 1 - corr(ra, rb) AS spearman, 1 - count(*) FILTER (ta <= 3 AND tb <= 3) / 3.0 AS top3 FROM {name}_r GROUP BY ALL),
{name}_k AS (SELECT x.rep, x.ka, x.kb, 1 - sum(sign(x.va - y.va) * sign(x.vb - y.vb)) / sqrt(sum(abs(sign(x.va - y.va))) * sum(abs(sign(x.vb - y.vb)))) AS kendall
  FROM {name}_x x JOIN {name}_x y ON x.ka = y.ka AND x.kb = y.kb AND x.feature < y.feature GROUP BY ALL),
{name} AS (SELECT rep, 'spearman' AS measure, avg(spearman) AS d FROM {name}_s GROUP BY rep UNION ALL SELECT rep, 'top3', avg(top3) FROM {name}_s GROUP BY rep
  UNION ALL SELECT rep, 'kendall', avg(kendall) FROM {name}_k GROUP BY rep)"""


NET_SQL = """SELECT measure, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high
FROM (SELECT c.measure, c.d - n.d AS v FROM crossed c JOIN noise n ON c.rep = n.rep AND c.measure = n.measure) GROUP BY measure"""


@query("b10_group_disagreement", with_cte(sql_attribution("a", 1, 32, "a"), f"""
rws AS (SELECT DISTINCT row_id, grp FROM a), reps AS (SELECT CAST(unnest(range({HALF_REPS})) AS INTEGER) AS rep),
rk AS (SELECT rep, grp, row_id, row_number() OVER (PARTITION BY rep, grp ORDER BY {sql_key('half', 'rep', 'row_id')}, row_id) AS r FROM rws, reps),
hv AS (SELECT rep, grp, row_id, CASE WHEN r > {HALF_SIZE} THEN 1 ELSE 0 END AS half FROM rk WHERE r <= {2 * HALF_SIZE}),
imp AS (SELECT rep || '-' || grp || '-' || half AS k, rep, grp, half, feature, avg(abs(value)) AS v FROM hv JOIN a USING (row_id, grp) GROUP BY ALL),
ks AS (SELECT DISTINCT rep, grp, half, k FROM imp),
cp AS (SELECT x.rep, x.k AS ka, y.k AS kb FROM ks x JOIN ks y ON x.rep = y.rep AND x.half = 0 AND y.half = 0 AND x.grp < y.grp),
np AS (SELECT x.rep, x.k AS ka, y.k AS kb FROM ks x JOIN ks y ON x.rep = y.rep AND x.half = 0 AND y.half = 1 AND x.grp = y.grp)""",
    disagreement_sql("cp", "crossed"), disagreement_sql("np", "noise")) + NET_SQL)
def b10(spark, sf):
    out = B.group_disagreement_beyond_noise(attribution(spark, sf, 1, 32, "a"), HALF_SIZE, HALF_REPS, "half")
    return rounded(out, "mean", "ci_low", "ci_high")


MODEL_SIZE = 60


@query("b10_model_disagreement", with_cte(sql_attribution("a", 1, 32, "a"), sql_attribution("b", 33, 64, "b"), f"""
rws AS (SELECT DISTINCT row_id FROM a), reps AS (SELECT CAST(unnest(range({HALF_REPS})) AS INTEGER) AS rep),
rk AS (SELECT rep, row_id, row_number() OVER (PARTITION BY rep ORDER BY {sql_key('half', 'rep', 'row_id')}, row_id) AS r FROM rws, reps),
hv AS (SELECT rep, row_id, CASE WHEN r > {MODEL_SIZE} THEN 1 ELSE 0 END AS half FROM rk WHERE r <= {2 * MODEL_SIZE}),
ab AS (SELECT 'a' AS model, row_id, feature, value FROM a UNION ALL SELECT 'b', row_id, feature, value FROM b),
imp AS (SELECT rep || '-' || model || '-' || half AS k, rep, model, half, feature, avg(abs(value)) AS v FROM hv JOIN ab USING (row_id) GROUP BY ALL),
cp AS (SELECT rep, rep || '-a-0' AS ka, rep || '-b-0' AS kb FROM reps),
np AS (SELECT rep, rep || '-a-0' AS ka, rep || '-a-1' AS kb FROM reps UNION ALL SELECT rep, rep || '-b-0', rep || '-b-1' FROM reps)""",
    disagreement_sql("cp", "crossed"), disagreement_sql("np", "noise")) + NET_SQL)
def b10_models(spark, sf):
    out = B.model_disagreement_beyond_noise(attribution(spark, sf, 1, 32, "a"), attribution(spark, sf, 33, 64, "b"), MODEL_SIZE, HALF_REPS, "half")
    return rounded(out, "mean", "ci_low", "ci_high")


@query("b11_spearman", with_cte(EVENTS) + """
, r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rb FROM ev)
SELECT event_type, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY event_type""")
def b11(spark, sf):
    return rounded(B.spearman(events(spark, sf), "k", "value", ["event_type"]), "rho")


@query("b11_kendall", """
WITH f AS (SELECT o_orderpriority AS grp, month(o_orderdate) AS item, count(*) % 7 AS a, count(DISTINCT o_custkey) % 5 AS b FROM orders GROUP BY ALL)
SELECT x.grp, round(sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(sum(abs(sign(x.a - y.a))) * sum(abs(sign(x.b - y.b)))), 6) AS tau
FROM f x JOIN f y ON x.grp = y.grp AND x.item < y.item GROUP BY x.grp""")
def b11_kendall(spark, sf):
    from plumbline.plans.bindings import table

    f = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.month("o_orderdate").alias("item")).agg(
        (F.count(F.lit(1)) % 7).alias("a"), (F.countDistinct("o_custkey") % 5).alias("b")
    )
    return rounded(B.kendall(f, "item", "a", "b", ["grp"]), "tau")
