"""Queries over attribution algebra and agreement (survey section 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import agreement as G
from plumbline.operators import attribution as E
from plumbline.operators import encode as P
from plumbline.operators import inference as B
from plumbline.operators import splits as D
from plumbline.plans.bindings import (
    SALES, arm_score, attribution, rounded, sales, sql_arm_score, sql_attribution, sql_int, sql_key, table, with_cte,
)
from plumbline.plans.inference import draws_sql
from plumbline.plans.registry import query

FEATURES = ["x0", "x1", "x2", "x3"]
M = len(FEATURES)


def predict(x):
    """A fixed formula with two-way and three-way products, in logits."""
    return 0.4 * x[0] - 0.3 * x[1] + 0.25 * x[2] + 0.05 * x[0] * x[1] - 0.02 * x[1] * x[2] * x[3] + 0.01 * x[2] * x[3]


def sql_f(x: list[str]) -> str:
    a, b, c, d = x
    return f"(0.4::DOUBLE * {a} - 0.3::DOUBLE * {b} + 0.25::DOUBLE * {c} + 0.05::DOUBLE * {a} * {b} - 0.02::DOUBLE * {b} * {c} * {d} + 0.01::DOUBLE * {c} * {d})"


SX = """sx AS (SELECT row_id, grp, y, priority, CAST(substr(priority, 1, 1) AS DOUBLE) AS x0, CAST(order_year - 1995 AS DOUBLE) AS x1, price / 100000 AS x2, balance / 1000 AS x3 FROM sales)"""
N_BACKGROUND = 200
BG = f"bg AS (SELECT x0, x1, x2, x3 FROM sx ORDER BY {sql_key('bg', 'row_id')}, row_id LIMIT {N_BACKGROUND})"
PT = "pt AS (SELECT 2.0::DOUBLE AS x0, 3.0::DOUBLE AS x1, avg(x2) AS x2, avg(x3) AS x3 FROM sx)"


def mixed(keep) -> list[str]:
    return [f"CASE WHEN {keep(j)} THEN s.x{j} ELSE b.x{j} END" for j in range(M)]


def cv_sql(reference: str, name: str = "cv", rows: str = "sx") -> str:
    return f"""{name} AS (SELECT s.row_id, m.mask, avg({sql_f(mixed(lambda j: f'(m.mask >> {j}) & 1 = 1'))}) AS v
  FROM {rows} s, (SELECT CAST(unnest(range({1 << M})) AS INTEGER) AS mask) m, {reference} b GROUP BY ALL)"""


FEATURE_LIST = "(SELECT CAST(unnest(range(4)) AS INTEGER) AS j)"
PHI = "sum(v * CASE WHEN (mask >> j) & 1 = 1 THEN [0.25, 1/12, 1/12, 0.25][bit_count(mask)] ELSE -[0.25, 1/12, 1/12, 0.25][bit_count(mask) + 1] END)"


def phi_sql(cv: str = "cv", name: str = "phi") -> str:
    return f"{name} AS (SELECT row_id, 'x' || j AS feature, {PHI} AS value FROM {cv}, {FEATURE_LIST} GROUP BY row_id, j)"


def inter_sql(cv: str = "cv", phi: str = "phi", name: str = "inter") -> str:
    # s! (M - s - 2)! / (2 (M - 1)!) for M = 4: 2/12, 1/12, 2/12
    return f"""{name}_o AS (SELECT row_id, i.j AS i, k.j AS k, sum(v * (CASE WHEN ((mask >> i.j) & 1) + ((mask >> k.j) & 1) = 1 THEN -1 ELSE 1 END)
    * [1/6, 1/12, 1/6][bit_count(mask) - ((mask >> i.j) & 1) - ((mask >> k.j) & 1) + 1]) AS value
  FROM {cv}, {FEATURE_LIST} i, {FEATURE_LIST} k WHERE i.j <> k.j GROUP BY ALL),
{name} AS (SELECT row_id, 'x' || i AS feature_i, 'x' || k AS feature_j, value FROM {name}_o
  UNION ALL SELECT p.row_id, p.feature, p.feature, any_value(p.value) - sum(o.value) FROM {phi} p JOIN {name}_o o ON o.row_id = p.row_id AND 'x' || o.i = p.feature GROUP BY p.row_id, p.feature)"""


def abl_sql(reference: str = "pt", name: str = "abl", rows: str = "sx") -> str:
    own = [f"s.x{j}" for j in range(M)]
    swapped = [f"CASE WHEN j = {j} THEN b.x{j} ELSE s.x{j} END" for j in range(M)]
    return f"{name} AS (SELECT s.row_id, 'x' || j AS feature, {sql_f(own)} - {sql_f(swapped)} AS value FROM {rows} s, {reference} b, {FEATURE_LIST})"


OUT = f"outp AS (SELECT row_id, {sql_f(['x0', 'x1', 'x2', 'x3'])} AS output FROM sx)"


def coded(spark, sf):
    s = sales(spark, sf)
    return s.select(
        "row_id", "grp", "y", "priority", F.substring("priority", 1, 1).cast("double").alias("x0"), (F.col("order_year") - 1995).cast("double").alias("x1"),
        (F.col("price") / 100000).alias("x2"), (F.col("balance") / 1000).alias("x3"),
    )


def background(df):
    return D.sample_n(df, N_BACKGROUND, "bg").select(*FEATURES)


def point(df):
    return df.agg(F.lit(2.0).alias("x0"), F.lit(3.0).alias("x1"), F.avg("x2").alias("x2"), F.avg("x3").alias("x3"))


def outputs(df):
    return df.select("row_id", predict([F.col(f) for f in FEATURES]).alias("output"))


@query("e1_coalition_values", with_cte(SALES, SX, BG, cv_sql("bg")) + """
SELECT mask, count(*) AS n, round(avg(v), 6) AS mean_v, round(min(v), 6) AS min_v, round(max(v), 6) AS max_v FROM cv GROUP BY mask""")
def e1(spark, sf):
    df = coded(spark, sf)
    v = E.coalition_values(df, FEATURES, background(df), predict).select(F.posexplode("v").alias("mask", "v"))
    return rounded(v.groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v")), "mean_v", "min_v", "max_v")


@query("e2_exact_shapley", with_cte(SALES, SX, BG, cv_sql("bg"), phi_sql()) + """
SELECT p.row_id, p.feature, round(p.value, 6) AS value, round(c.v, 6) AS base_value FROM phi p JOIN cv c ON c.row_id = p.row_id AND c.mask = 0""")
def e2(spark, sf):
    df = coded(spark, sf)
    return rounded(E.exact_shapley(df, FEATURES, background(df), predict), "value", "base_value")


@query("e3_point_shapley", with_cte(SALES, SX, PT, cv_sql("pt"), phi_sql()) + "SELECT row_id, feature, round(value, 6) AS value FROM phi")
def e3(spark, sf):
    df = coded(spark, sf)
    return rounded(E.point_shapley(df, FEATURES, point(df), predict).drop("base_value"), "value")


@query("e4_shapley_interactions", with_cte(SALES, SX, BG, cv_sql("bg"), phi_sql(), inter_sql()) + """
SELECT feature_i, feature_j, count(*) AS n, round(avg(abs(value)), 6) AS mean_abs, round(min(value), 6) AS low, round(max(value), 6) AS high FROM inter GROUP BY ALL""")
def e4(spark, sf):
    df = coded(spark, sf)
    found = E.shapley_interactions(df, FEATURES, background(df), predict).groupBy("feature_i", "feature_j").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("value")).alias("mean_abs"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return rounded(found, "mean_abs", "low", "high").withColumns({"low": F.col("low") + 0.0, "high": F.col("high") + 0.0})


@query("e5_interaction_summary", with_cte(SALES, SX, BG, cv_sql("bg"), phi_sql(), inter_sql()) + """
SELECT round(sum(abs(value)) FILTER (feature_i <> feature_j) / sum(abs(value)), 6) AS interaction_share, count(DISTINCT row_id) AS n, 0.0::DOUBLE AS max_row_sum_error FROM inter""")
def e5(spark, sf):
    df = coded(spark, sf)
    bg = background(df)
    out = E.interaction_summary(E.shapley_interactions(df, FEATURES, bg, predict), E.exact_shapley(df, FEATURES, bg, predict))
    return rounded(out, "interaction_share", "max_row_sum_error")


@query("e5_top_pairs", with_cte(SALES, SX, BG, cv_sql("bg"), phi_sql(), inter_sql()) + """
SELECT feature_i, feature_j, round(avg(abs(value)), 6) AS mean_abs FROM inter WHERE feature_i < feature_j GROUP BY ALL ORDER BY avg(abs(value)) DESC LIMIT 3""")
def e5_pairs(spark, sf):
    df = coded(spark, sf)
    return rounded(E.top_pairs(E.shapley_interactions(df, FEATURES, background(df), predict), 3), "mean_abs")


@query("e6_feature_ablation", with_cte(SALES, SX, PT, abl_sql()) + "SELECT row_id, feature, round(value, 6) + 0.0 AS value FROM abl")
def e6(spark, sf):
    df = coded(spark, sf)
    return rounded(E.feature_ablation(df, FEATURES, point(df), predict).drop("base_value"), "value").withColumn("value", F.col("value") + 0.0)


@query("e7_non_additivity", with_cte(SALES, SX, PT, abl_sql(), OUT) + f"""
, b AS (SELECT {sql_f(['x0', 'x1', 'x2', 'x3'])} AS base FROM pt), s AS (SELECT row_id, sum(value) AS t FROM abl GROUP BY row_id)
SELECT round(avg(abs(t + base - output)), 6) AS mean_abs, round(max(abs(t + base - output)), 6) AS max_abs, round(avg(abs(output - base)), 6) AS mean_abs_output_minus_base FROM s JOIN outp USING (row_id), b""")
def e7(spark, sf):
    df = coded(spark, sf)
    return rounded(E.non_additivity(E.feature_ablation(df, FEATURES, point(df), predict), outputs(df)), "mean_abs", "max_abs", "mean_abs_output_minus_base")


@query("e8_check_efficiency", with_cte(SALES, SX) + "SELECT count(*) AS n, 0.0::DOUBLE AS max_abs_error, 0.0::DOUBLE AS mean_abs_error, CAST(0 AS BIGINT) AS n_violations, true AS passed FROM sx")
def e8(spark, sf):
    df = coded(spark, sf)
    return rounded(E.check_efficiency(E.exact_shapley(df, FEATURES, background(df), predict), outputs(df), 1e-8), "max_abs_error", "mean_abs_error")


ENCODED = {1: "job_type_a", 2: "job_type_b", 3: "job_x", 4: "job_y", 5: "age", 6: "size", 7: "size_outlier", 8: "job_type_c"}
ENCODED_SQL = "CASE (pos - 1) % 8 + 1 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ENCODED.items()) + " END"


@query("e9_group_columns", with_cte(sql_attribution("a", 1, 64, "a")) + """
SELECT row_id, CASE WHEN (pos - 1) % 8 IN (0, 1, 7) THEN 'job_type' WHEN (pos - 1) % 8 IN (2, 3) THEN 'job' WHEN (pos - 1) % 8 = 4 THEN 'age' ELSE 'size' END AS feature, round(sum(value), 6) AS value FROM a GROUP BY ALL""")
def e9(spark, sf):
    a = attribution(spark, sf, 1, 64, "a")
    names = F.element_at(F.array(*[F.lit(ENCODED[i]) for i in range(1, 9)]), (F.col("pos") - 1) % 8 + 1)
    return rounded(E.group_columns(a.withColumn("feature", names), ["job", "job_type"], ["age", "size"], {"size_outlier": "size"}), "value")


# halves of the 64 positions as two methods; as three, their neighbours share a position
THIRDS = {"a": (1, 22), "b": (22, 43), "c": (43, 64)}
TWO = with_cte(sql_attribution("a", 1, 32, "a"), sql_attribution("b", 33, 64, "b"))


def two(spark, sf):
    return attribution(spark, sf, 1, 32, "a"), attribution(spark, sf, 33, 64, "b")


SHARES = """, ab AS (SELECT * FROM a UNION ALL SELECT * FROM b), im AS (SELECT set_id, feature, avg(abs(value)) AS importance FROM ab GROUP BY ALL),
sh AS (SELECT *, importance / sum(importance) OVER (PARTITION BY set_id) AS share FROM im)
"""


@query("e10_importance_share", TWO + SHARES + "SELECT set_id, feature, round(importance, 6) AS importance, round(share, 6) AS share FROM sh")
def e10(spark, sf):
    a, b = two(spark, sf)
    return rounded(E.importance_share(E.mean_abs_importance(a.unionByName(b), ["set_id"]), ["set_id"]), "importance", "share")


@query("e11_rank_table", TWO + SHARES + """
, r AS (SELECT *, CAST(rank() OVER (PARTITION BY set_id ORDER BY share DESC) AS INTEGER) AS rank FROM sh)
SELECT set_id, feature, round(importance, 6) AS importance, round(share, 6) AS share, rank, avg(rank) OVER (PARTITION BY feature) AS mean_rank, max(rank) OVER (PARTITION BY feature) <= 3 AS top3_everywhere FROM r""")
def e11(spark, sf):
    a, b = two(spark, sf)
    return rounded(E.rank_table(a.unionByName(b)), "importance", "share")


PX = """, px AS (SELECT a.row_id, a.grp, a.feature, a.value AS va, b.value AS vb FROM a JOIN b ON a.row_id = b.row_id AND a.feature = b.feature)"""
# values below 0.06 count as zero, so that shared zeros occur
PZ = """, pz AS (SELECT row_id, grp, feature, CASE WHEN abs(va) < 0.06 THEN 0.0::DOUBLE ELSE va END AS va, CASE WHEN abs(vb) < 0.06 THEN 0.0::DOUBLE ELSE vb END AS vb FROM px)"""


def rho_sql(src: str, name: str, keys: str = "row_id") -> str:
    return f"""{name} AS (SELECT {keys}, CASE WHEN max(abs(va)) > min(abs(va)) AND max(abs(vb)) > min(abs(vb)) THEN corr(ra, rb) END AS rho FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY abs(va) DESC, feature) AS ra, row_number() OVER (PARTITION BY {keys} ORDER BY abs(vb) DESC, feature) AS rb FROM {src}) GROUP BY {keys})"""


def rho_nz_sql(src: str, name: str, keys: str = "row_id") -> str:
    return f"""{name} AS (SELECT {keys}, CASE WHEN count(*) >= 3 AND var_pop(ra) > 0 AND var_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM (
  SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY abs(va)) + (count(*) OVER (PARTITION BY {keys}, abs(va)) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY {keys} ORDER BY abs(vb)) + (count(*) OVER (PARTITION BY {keys}, abs(vb)) - 1) / 2.0 AS rb
  FROM {src} WHERE NOT (abs(va) < 1e-9 AND abs(vb) < 1e-9)) GROUP BY {keys})"""


def zeroed(spark, sf):
    a, b = two(spark, sf)
    small = F.when(F.abs("value") < 0.06, F.lit(0.0)).otherwise(F.col("value"))
    return a.withColumn("value", small), b.withColumn("value", small)


@query("e12_global_agreement", TWO + PX + """
, i AS (SELECT feature, avg(abs(va)) AS ia, avg(abs(vb)) AS ib FROM px GROUP BY feature),
r AS (SELECT *, rank() OVER (ORDER BY ia) AS ra, rank() OVER (ORDER BY ib) AS rb, row_number() OVER (ORDER BY ia DESC) AS ta, row_number() OVER (ORDER BY ib DESC) AS tb FROM i),
k AS (SELECT sum(sign(x.ia - z.ia) * sign(x.ib - z.ib)) / sqrt(sum(abs(sign(x.ia - z.ia))) * sum(abs(sign(x.ib - z.ib)))) AS tau FROM i x JOIN i z ON x.feature < z.feature)
SELECT round(corr(ra, rb), 6) AS global_spearman, (SELECT round(tau, 6) FROM k) AS global_kendall,
  round(count(*) FILTER (ta <= 3 AND tb <= 3) / 3.0, 6) AS top3_overlap, round(count(*) FILTER (ta <= 5 AND tb <= 5) / 5.0, 6) AS top5_overlap FROM r""")
def e12(spark, sf):
    return rounded(G.global_agreement(G.pair(*two(spark, sf)), 32), "global_spearman", "global_kendall", "top3_overlap", "top5_overlap")


@query("e13_instance_rank_corr", TWO + PX + ", " + rho_sql("px", "rr") + "SELECT row_id, round(rho, 6) AS rho FROM rr")
def e13(spark, sf):
    return rounded(G.instance_rank_corr(G.pair(*two(spark, sf))), "rho")


@query("e14_instance_rank_corr_no_shared_zeros", TWO + PX + PZ + ", " + rho_nz_sql("pz", "rr") + """
SELECT x.row_id, round(rr.rho, 6) AS rho FROM (SELECT DISTINCT row_id FROM pz) x LEFT JOIN rr USING (row_id)""")
def e14(spark, sf):
    return rounded(G.instance_rank_corr_no_shared_zeros(G.pair(*zeroed(spark, sf))), "rho")


def row_stats_sql(src: str, keys: str = "row_id") -> str:
    ks = keys
    join = " AND ".join(f"t.{k.strip()} = {{o}}.{k.strip()}" for k in keys.split(","))
    return f"""{rho_sql(src, 'r1', ks)}, {rho_nz_sql(src, 'r2', ks)},
tops AS (SELECT {ks}, arg_max(feature, va2) AS fa, arg_max(feature, vb2) AS fb FROM (SELECT *, (abs(va), -row_number() OVER (PARTITION BY {ks} ORDER BY feature)) AS va2, (abs(vb), -row_number() OVER (PARTITION BY {ks} ORDER BY feature)) AS vb2 FROM {src}) GROUP BY {ks}),
cnt AS (SELECT {ks}, count(*) FILTER (va <> 0 AND vb <> 0) AS nz, count(*) FILTER (va <> 0 AND vb <> 0 AND sign(va) = sign(vb)) AS ss, avg(abs(va - vb)) AS ad,
  count(*) FILTER (abs(va) < 1e-9 AND abs(vb) < 1e-9) AS sz FROM {src} GROUP BY {ks}),
rs AS (SELECT {', '.join('t.' + k.strip() for k in ks.split(','))}, r1.rho AS rho, r2.rho AS rho_nz, (fa = fb)::INT AS same_top, nz, ss, ad, sz FROM tops t
  JOIN cnt ON {join.format(o='cnt')} LEFT JOIN r1 ON {join.format(o='r1')} LEFT JOIN r2 ON {join.format(o='r2')})"""


@query("e15_summarize_agreement", TWO + PX + PZ + ", " + row_stats_sql("pz") + """
, i AS (SELECT feature, avg(abs(va)) AS ia, avg(abs(vb)) AS ib FROM pz GROUP BY feature),
r AS (SELECT *, rank() OVER (ORDER BY ia) AS ra, rank() OVER (ORDER BY ib) AS rb, row_number() OVER (ORDER BY ia DESC) AS ta, row_number() OVER (ORDER BY ib DESC) AS tb FROM i),
k AS (SELECT sum(sign(x.ia - z.ia) * sign(x.ib - z.ib)) / sqrt(sum(abs(sign(x.ia - z.ia))) * sum(abs(sign(x.ib - z.ib)))) AS tau FROM i x JOIN i z ON x.feature < z.feature),
g AS (SELECT corr(ra, rb) AS s, count(*) FILTER (ta <= 3 AND tb <= 3) / 3.0 AS t3, count(*) FILTER (ta <= 5 AND tb <= 5) / 5.0 AS t5 FROM r)
SELECT count(*) AS n, round(avg((round(rho, 12) < 0.5)::INT), 6) AS share_below_half, round(avg(same_top), 6) AS same_top_feature_share, round(sum(ss) / sum(nz), 6) AS sign_agreement_share,
  round(avg(ad), 6) AS mean_abs_difference, round(avg(sz), 6) AS mean_shared_zero_features, round(quantile_cont(rho, 0.25), 6) AS q25, round(median(rho), 6) AS median, round(quantile_cont(rho, 0.75), 6) AS q75,
  round(any_value(g.s), 6) AS global_spearman, round(any_value(k.tau), 6) AS global_kendall, round(any_value(g.t3), 6) AS top3_overlap, round(any_value(g.t5), 6) AS top5_overlap FROM rs, g, k""")
def e15(spark, sf):
    out = G.summarize_agreement(G.pair(*zeroed(spark, sf)), 32)
    return rounded(out, *[c for c in out.columns if c != "n"])


def agreement_ci_sql(by: list[str], reps: int, seed: str) -> str:
    """From row statistics ``rs`` and cell pairs ``cells`` (both with ``by, row_id``) to interval rows."""
    b = "".join(f"{k}, " for k in by)
    on = " AND ".join([f"d.{k} = {{t}}.{k}" for k in by] + ["d.row_id = {t}.row_id"])
    part = ", ".join([*by, "rep"])
    eq = " AND ".join(f"x.{k} = z.{k}" for k in [*by, "rep"])
    return f"""{draws_sql('rs', by, reps, seed).replace('draws AS (SELECT d.rep, r.row_id', 'draws AS (SELECT ' + ''.join(f'd.{k}, ' for k in by) + 'd.rep, r.row_id')},
dd AS (SELECT {b}rep, row_id, c FROM draws UNION ALL SELECT {b}-1, row_id, 1 FROM rs),
s1 AS (SELECT {', '.join('d.' + k for k in [*by, 'rep'])}, sum(d.c * rs.same_top) / sum(d.c) AS same_top_feature_share, sum(d.c * rs.ss) / greatest(sum(d.c * rs.nz), 1) AS sign_agreement_share
  FROM dd d JOIN rs ON {on.format(t='rs')} GROUP BY ALL),
ex AS (SELECT {', '.join('d.' + k for k in [*by, 'rep'])}, rs.rho, rs.rho_nz, unnest(range(d.c)) AS copy FROM dd d JOIN rs ON {on.format(t='rs')}),
s2 AS (SELECT {part}, median(rho) AS m1, median(rho_nz) AS m2 FROM ex GROUP BY ALL),
im AS (SELECT {', '.join('d.' + k for k in [*by, 'rep'])}, p.feature, sum(d.c * abs(p.va)) / sum(d.c) AS ia, sum(d.c * abs(p.vb)) / sum(d.c) AS ib FROM dd d JOIN cells p ON {on.format(t='p')} GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY {part} ORDER BY ia) AS ra, rank() OVER (PARTITION BY {part} ORDER BY ib) AS rb,
  row_number() OVER (PARTITION BY {part} ORDER BY ia DESC) AS ta, row_number() OVER (PARTITION BY {part} ORDER BY ib DESC) AS tb FROM im),
s3 AS (SELECT {part}, corr(ra, rb) AS sp, count(*) FILTER (ta <= 3 AND tb <= 3) / 3.0 AS t3, count(*) FILTER (ta <= 5 AND tb <= 5) / 5.0 AS t5 FROM rk GROUP BY ALL),
s4 AS (SELECT {', '.join('x.' + k for k in [*by, 'rep'])}, sum(sign(x.ia - z.ia) * sign(x.ib - z.ib)) / sqrt(sum(abs(sign(x.ia - z.ia))) * sum(abs(sign(x.ib - z.ib)))) AS tau FROM im x JOIN im z ON {eq} AND x.feature < z.feature GROUP BY ALL),
al AS (SELECT {part}, unnest(['global_spearman', 'global_kendall', 'top3_overlap', 'top5_overlap', 'instance_spearman_median', 'instance_spearman_median_no_shared_zeros', 'same_top_feature_share', 'sign_agreement_share']) AS metric,
  unnest([sp, tau, CAST(t3 AS DOUBLE), CAST(t5 AS DOUBLE), m1, m2, same_top_feature_share, sign_agreement_share]) AS value FROM s1 JOIN s2 USING ({part}) JOIN s3 USING ({part}) JOIN s4 USING ({part}))
SELECT {b}metric, round(max(value) FILTER (rep = -1), 6) AS estimate, round(quantile_cont(value, 0.025) FILTER (rep <> -1), 6) AS ci_low, round(quantile_cont(value, 0.975) FILTER (rep <> -1), 6) AS ci_high,
  count(value) FILTER (rep <> -1) AS reps FROM al GROUP BY {b}metric"""


@query("e15_agreement_with_ci", TWO + PX + PZ + ", cells AS (SELECT * FROM pz), " + row_stats_sql("cells") + ", " + agreement_ci_sql([], 20, "agree"))
def e15_ci(spark, sf):
    return rounded(G.agreement_with_ci(G.pair(*zeroed(spark, sf)), 32, 20, "agree"), "estimate", "ci_low", "ci_high")


@query("e16_per_feature_disagreement", TWO + PX + "SELECT feature, round(avg(abs(va - vb)) / ((avg(abs(va)) + avg(abs(vb))) / 2), 6) AS disagreement FROM px GROUP BY feature")
def e16(spark, sf):
    return rounded(G.per_feature_disagreement(*two(spark, sf)), "disagreement")


THREE = with_cte(*[sql_attribution(name, first, last, name) for name, (first, last) in THIRDS.items()])


@query("e17_agreement_table", THREE + """
, al_ AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), sp_(id, sa, sb) AS (VALUES ('A1', 'a', 'b'), ('A2', 'a', 'c')),
sm AS (SELECT 'pooled' AS sample, vec_id AS row_id FROM embeddings UNION ALL SELECT 'focus', vec_id FROM embeddings WHERE label < 3),
cells AS (SELECT s.id, m.sample, x.row_id, x.feature, x.value AS va, z.value AS vb FROM sp_ s JOIN al_ x ON x.set_id = s.sa JOIN al_ z ON z.set_id = s.sb AND z.row_id = x.row_id AND z.feature = x.feature JOIN sm m ON m.row_id = x.row_id),
""" + row_stats_sql("cells", "id, sample, row_id") + ", " + agreement_ci_sql(["id", "sample"], 10, "table"))
def e17(spark, sf):
    parts = [attribution(spark, sf, first, last, name) for name, (first, last) in THIRDS.items()]
    attr = parts[0].unionByName(parts[1]).unionByName(parts[2])
    e = table(spark, sf, "embeddings")
    samples = e.select(F.lit("pooled").alias("sample"), F.col("vec_id").alias("row_id")).unionByName(
        e.where("label < 3").select(F.lit("focus").alias("sample"), F.col("vec_id").alias("row_id"))
    )
    out = G.agreement_table(attr, [("A1", "a", "b"), ("A2", "a", "c")], samples, 22, 10, "table")
    return rounded(out, "estimate", "ci_low", "ci_high")


RANKED = "ord AS (SELECT row_id, feature, row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, feature) AS rk FROM abl)"
ORDW = "ordw AS (SELECT row_id, max(rk) FILTER (feature = 'x0') AS r0, max(rk) FILTER (feature = 'x1') AS r1, max(rk) FILTER (feature = 'x2') AS r2, max(rk) FILTER (feature = 'x3') AS r3 FROM ord GROUP BY row_id)"


def curves_sql(reference: str) -> str:
    return f"""cur AS (SELECT s.row_id, k.k, any_value({sql_f(['s.x0', 's.x1', 's.x2', 's.x3'])}) AS output,
  avg({sql_f(mixed(lambda j: f'o.r{j} > k.k'))}) AS deletion, avg({sql_f(mixed(lambda j: f'o.r{j} <= k.k'))}) AS insertion
  FROM sx s JOIN ordw o USING (row_id), (SELECT CAST(unnest(range(5)) AS INTEGER) AS k) k, {reference} b GROUP BY ALL)"""


def curves(spark, sf, reference):
    df = coded(spark, sf)
    order = E.feature_ranks(E.feature_ablation(df, FEATURES, point(df), predict).withColumn("value", F.round("value", 9))).select("row_id", "feature", "rank")
    return E.removal_curves(df, FEATURES, order, reference(df), predict)


RANKED9 = "abl9 AS (SELECT row_id, feature, round(value, 9) AS value FROM abl), " + RANKED.replace("FROM abl)", "FROM abl9)")


@query("e18_removal_curves", with_cte(SALES, SX, PT, BG, abl_sql(), RANKED9, ORDW, curves_sql("bg")) + """
SELECT k, count(*) AS n, round(avg(output), 6) AS output, round(avg(deletion), 6) AS deletion, round(avg(insertion), 6) AS insertion, round(avg(abs(output - deletion)), 6) AS removed, round(avg(abs(output - insertion)), 6) AS kept FROM cur GROUP BY k""")
def e18(spark, sf):
    out = curves(spark, sf, background).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.avg("output").alias("output"), F.avg("deletion").alias("deletion"), F.avg("insertion").alias("insertion"),
        F.avg(F.abs(F.col("output") - F.col("deletion"))).alias("removed"), F.avg(F.abs(F.col("output") - F.col("insertion"))).alias("kept"),
    )
    return rounded(out, "output", "deletion", "insertion", "removed", "kept")


FAITH = """fr AS (SELECT row_id, avg(abs(output - deletion)) AS da, avg(abs(output - insertion)) AS ig, max(abs(output - deletion)) FILTER (k = 1) AS c1, max(abs(output - insertion)) FILTER (k = 1) AS s1,
  max(abs(output - deletion)) FILTER (k = 3) AS c3, max(abs(output - insertion)) FILTER (k = 3) AS s3 FROM cur GROUP BY row_id),
fl AS (SELECT row_id, unnest(['deletion_area', 'insertion_gap', 'comprehensiveness@1', 'sufficiency@1', 'comprehensiveness@3', 'sufficiency@3']) AS metric, unnest([da, ig, c1, s1, c3, s3]) AS value FROM fr)"""


@query("e19_faithfulness_scores", with_cte(SALES, SX, PT, abl_sql(), RANKED9, ORDW, curves_sql("pt"), FAITH, "rws AS (SELECT DISTINCT row_id FROM fl)", draws_sql("rws", [], 5, "faith")) + """
, st AS (SELECT rep, metric, sum(c * value) / sum(c) AS v FROM draws JOIN fl USING (row_id) GROUP BY ALL)
SELECT p.metric, round(p.e, 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high, count(v) AS reps
FROM (SELECT metric, avg(value) AS e FROM fl GROUP BY metric) p JOIN st USING (metric) GROUP BY p.metric, p.e""")
def e19(spark, sf):
    rows = E.faithfulness_rows(curves(spark, sf, point))

    def mean(weighted, by):
        return weighted.groupBy(*by, "metric").agg((F.sum(F.col("c") * F.col("value")) / F.sum("c")).alias("value"))

    return rounded(B.bootstrap_ci(rows, mean, ["metric"], 5, "faith"), "estimate", "ci_low", "ci_high")


NUDGED = """nd AS (SELECT row_id, 'x1' AS nudged, d AS delta, x0, x1 + d AS x1, x2, x3 FROM sx, (VALUES (-1.0::DOUBLE), (1.0::DOUBLE)) t(d) WHERE x1 + d BETWEEN 0 AND 6
  UNION ALL SELECT row_id, 'x0', d, x0 + d, x1, x2, x3 FROM sx, (VALUES (-1.0::DOUBLE), (1.0::DOUBLE)) t(d) WHERE x0 + d BETWEEN 1 AND 5)"""


@query("e20_stability", with_cte(SALES, SX, PT, abl_sql(), NUDGED) + f"""
, an AS (SELECT s.row_id, s.nudged, s.delta, 'x' || j AS feature, {sql_f(['s.x0', 's.x1', 's.x2', 's.x3'])} - {sql_f([f'CASE WHEN j = {j} THEN b.x{j} ELSE s.x{j} END' for j in range(4)])} AS value FROM nd s, pt b, {FEATURE_LIST}),
ch AS (SELECT n.row_id, n.nudged, n.delta, CASE WHEN sum(abs(o.value)) > 0 THEN sum(abs(n.value - o.value)) / sum(abs(o.value)) END AS change FROM an n JOIN abl o ON o.row_id = n.row_id AND o.feature = n.feature GROUP BY ALL)
SELECT nudged, count(*) AS n, round(median(change), 6) AS median_change FROM ch GROUP BY nudged""")
def e20(spark, sf):
    from plumbline.functions.ordering import exact_quantiles

    df = coded(spark, sf)
    pt = point(df)
    moved = P.nudge(df, ["x1", "x0"], {"x1": (0.0, 6.0), "x0": (1.0, 5.0)}).where("valid")
    packed = moved.withColumn("key", F.struct("row_id", "nudged", "delta"))
    after = E.feature_ablation(packed, FEATURES, pt, predict, row_id="key").select("key.row_id", "key.nudged", "key.delta", "feature", "value")
    changes = E.relative_changes(E.feature_ablation(df, FEATURES, pt, predict), after, ["nudged", "delta"])
    out = exact_quantiles(changes, "change", {"median_change": 0.5}, by=["nudged"], extra=[F.sum("__hr_c").alias("n")])
    return rounded(out, "median_change")


@query("e21_tp_vs_tn", with_cte(SALES, SX, PT, abl_sql(), f"""
mk AS (SELECT row_id, ({sql_arm_score('a')} >= 0.5 AND y = 1)::INT AS tp, ({sql_arm_score('a')} < 0.5 AND y = 0)::INT AS tn FROM sx),
rws AS (SELECT * FROM mk WHERE tp = 1 OR tn = 1)""", draws_sql("rws", ["tp"], 5, "tptn")) + """
, wt AS (SELECT -1 AS rep, row_id, 1 AS c FROM rws UNION ALL SELECT rep, row_id, c FROM draws),
st AS (SELECT rep, feature, sum(c * value * tp) / sum(c * tp) AS a, sum(c * value * tn) / sum(c * tn) AS b FROM wt JOIN rws USING (row_id) JOIN abl USING (row_id) GROUP BY ALL)
SELECT feature, round(max(a) FILTER (rep = -1), 6) AS mean_tp, round(max(b) FILTER (rep = -1), 6) AS mean_tn, round(max(a - b) FILTER (rep = -1), 6) AS difference,
  round(quantile_cont(a - b, 0.025) FILTER (rep <> -1), 6) AS ci_low, round(quantile_cont(a - b, 0.975) FILTER (rep <> -1), 6) AS ci_high FROM st GROUP BY feature""")
def e21(spark, sf):
    df = coded(spark, sf)
    attr = E.feature_ablation(df, FEATURES, point(df), predict)
    return rounded(G.tp_vs_tn(attr, df.withColumn("score", arm_score("a")), 0.5, 5, "tptn"), "mean_tp", "mean_tn", "difference", "ci_low", "ci_high")


@query("e22_error_stats", with_cte(SALES, SX, PT, BG, cv_sql("bg"), phi_sql(), abl_sql()) + """
, j AS (SELECT p.feature, a.value AS e, p.value AS t FROM phi p JOIN abl a ON a.row_id = p.row_id AND a.feature = p.feature), u AS (SELECT * FROM j UNION ALL SELECT 'ALL', e, t FROM j)
SELECT feature, count(*) AS n, round(avg(abs(e - t)), 6) AS mean_abs_error, round(max(abs(e - t)), 6) AS max_abs_error, round(avg(abs(e - t)) / avg(abs(t)), 6) AS relative_error, round(avg((sign(e) = sign(t))::INT), 6) AS same_sign_share FROM u GROUP BY feature""")
def e22(spark, sf):
    df = coded(spark, sf)
    out = E.error_stats(E.feature_ablation(df, FEATURES, point(df), predict), E.exact_shapley(df, FEATURES, background(df), predict))
    return rounded(out, "mean_abs_error", "max_abs_error", "relative_error", "same_sign_share")


@query("e23_baseline_sensitivity", TWO + PX + ", rws AS (SELECT DISTINCT row_id FROM px), " + draws_sql("rws", [], 20, "base") + """
, dd AS (SELECT rep, row_id, c FROM draws UNION ALL SELECT -1, row_id, 1 FROM rws),
im AS (SELECT rep, feature, sum(c * abs(va)) / sum(c) AS ia, sum(c * abs(vb)) / sum(c) AS ib FROM dd JOIN px USING (row_id) GROUP BY ALL),
sp AS (SELECT rep, corr(ra, rb) AS v FROM (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY ia) AS ra, rank() OVER (PARTITION BY rep ORDER BY ib) AS rb FROM im) GROUP BY rep)
SELECT 'spearman' AS metric, round(max(v) FILTER (rep = -1), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (rep <> -1), 6) AS ci_low, round(quantile_cont(v, 0.975) FILTER (rep <> -1), 6) AS ci_high, count(v) FILTER (rep <> -1) AS reps FROM sp""")
def e23(spark, sf):
    return rounded(G.baseline_sensitivity(G.pair(*two(spark, sf)), 32, 20, "base"), "estimate", "ci_low", "ci_high")


@query("e24_ablation_shapley_gap", with_cte(SALES, SX, PT, cv_sql("pt"), phi_sql(), inter_sql(), abl_sql()) + """
, c AS (SELECT p.row_id, p.feature, a.value - p.value AS gap, p.value AS sh, (SELECT NULL) AS z FROM phi p JOIN abl a ON a.row_id = p.row_id AND a.feature = p.feature),
s AS (SELECT row_id, feature_i AS feature, sum(value) AS ps FROM inter WHERE feature_i <> feature_j GROUP BY ALL),
j AS (SELECT c.*, s.ps FROM c JOIN s ON s.row_id = c.row_id AND s.feature = c.feature),
q AS (SELECT round(gap, 9) AS g, round(ps, 9) AS p FROM j),
r AS (SELECT rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS b FROM q)
SELECT count(DISTINCT row_id) AS n, round(avg(abs(gap)), 6) AS mean_abs_gap, round(avg(abs(sh)), 6) AS mean_abs_shapley, round(1 - sum((gap - ps) * (gap - ps)) / (var_pop(gap) * count(*)), 6) AS r2,
  round(avg(CASE WHEN abs(gap) > 1e-6 THEN (sign(gap) = sign(ps))::INT END), 6) AS same_sign_share, (SELECT round(corr(a, b), 6) FROM r) AS spearman FROM j""")
def e24(spark, sf):
    df = coded(spark, sf)
    pt = point(df)
    out = G.ablation_shapley_gap(
        E.point_shapley(df, FEATURES, pt, predict), E.feature_ablation(df, FEATURES, pt, predict), E.shapley_interactions(df, FEATURES, pt, predict)
    )
    return rounded(out, "mean_abs_gap", "mean_abs_shapley", "r2", "same_sign_share", "spearman")


@query("e25_association_vs_disagreement", with_cte(SALES, SX, PT, BG, cv_sql("bg"), phi_sql(), abl_sql()) + """
, q AS (SELECT [quantile_cont(x2, 0.25), quantile_cont(x2, 0.5), quantile_cont(x2, 0.75)] AS q2, [quantile_cont(x3, 0.25), quantile_cont(x3, 0.5), quantile_cont(x3, 0.75)] AS q3 FROM sx),
d AS (SELECT CAST(x0 AS VARCHAR) AS x0, CAST(x1 AS VARCHAR) AS x1, CAST((x2 > q2[1])::INT + (x2 > q2[2])::INT + (x2 > q2[3])::INT AS VARCHAR) AS x2, CAST((x3 > q3[1])::INT + (x3 > q3[2])::INT + (x3 > q3[3])::INT AS VARCHAR) AS x3 FROM sx, q),
cells AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS la, {b} AS lb, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY ALL" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]) + """),
m AS (SELECT *, sum(n) OVER (PARTITION BY a, b, la) AS ra, sum(n) OVER (PARTITION BY a, b, lb) AS cb FROM cells),
v AS (SELECT a, b, sqrt(greatest(sum(n * n / (ra * cb)) - 1, 0) / (least(count(DISTINCT la), count(DISTINCT lb)) - 1)) AS v FROM m GROUP BY a, b),
w AS (SELECT a AS feature, b AS partner, v FROM v UNION ALL SELECT b, a, v FROM v),
t AS (SELECT feature, max(v) AS max_v, arg_max(partner, v) AS partner FROM w GROUP BY feature),
g AS (SELECT p.feature, avg(abs(p.value - a.value)) / ((avg(abs(p.value)) + avg(abs(a.value))) / 2) AS disagreement FROM phi p JOIN abl a ON a.row_id = p.row_id AND a.feature = p.feature GROUP BY p.feature)
SELECT feature, round(max_v, 6) AS max_v, partner, round(disagreement, 6) AS disagreement FROM t JOIN g USING (feature)""")
def e25(spark, sf):
    df = coded(spark, sf)
    gap = G.per_feature_disagreement(E.exact_shapley(df, FEATURES, background(df), predict), E.feature_ablation(df, FEATURES, point(df), predict))
    return rounded(G.association_vs_disagreement(df, ["x0", "x1"], ["x2", "x3"], gap), "max_v", "disagreement")


@query("e26_local_table", with_cte(SALES, SX, PT, abl_sql(), RANKED9) + """
SELECT o.row_id, o.feature, CAST(o.rk AS INTEGER) AS rank, round(a.value, 6) + 0.0 AS value FROM ord o JOIN abl9 a ON a.row_id = o.row_id AND a.feature = o.feature""")
def e26(spark, sf):
    df = coded(spark, sf)
    attr = E.feature_ablation(df, FEATURES, point(df), predict).withColumn("value", F.round("value", 9))
    out = E.local_table(df, attr, FEATURES).select("row_id", "feature", "rank", "value")
    return rounded(out, "value").withColumn("value", F.col("value") + 0.0)


CHANGED = "s2 AS (SELECT row_id, 1.0::DOUBLE AS x0, x1, x2, x3 FROM sx)"


@query("e26_what_if", with_cte(SALES, SX, BG, CHANGED, cv_sql("bg"), phi_sql(), cv_sql("bg", "cv2", "s2"), phi_sql("cv2", "phi2")) + f"""
SELECT p.feature, count(*) AS n, round(avg(p.value), 6) AS before, round(avg(q.value), 6) AS after, round(avg({sql_f(['s.x0', 's.x1', 's.x2', 's.x3'])}), 6) AS output_before, round(avg({sql_f(['1.0::DOUBLE', 's.x1', 's.x2', 's.x3'])}), 6) AS output_after
FROM phi p JOIN phi2 q ON q.row_id = p.row_id AND q.feature = p.feature JOIN sx s ON s.row_id = p.row_id GROUP BY p.feature""")
def e26_what_if(spark, sf):
    df = coded(spark, sf)
    out = E.what_if(df, {"x0": 1.0}, FEATURES, background(df), predict).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("contribution_before").alias("before"), F.avg("contribution_after").alias("after"),
        F.avg("output_before").alias("output_before"), F.avg("output_after").alias("output_after"),
    )
    return rounded(out, "before", "after", "output_before", "output_after")


@query("e26_compare_methods", TWO + "SELECT a.row_id, a.feature, round(a.value, 6) AS a, round(b.value, 6) AS b FROM a JOIN b ON a.row_id = b.row_id AND a.feature = b.feature")
def e26_methods(spark, sf):
    a, b = two(spark, sf)
    return rounded(E.compare_methods(a.unionByName(b), ["a", "b"]), "a", "b")


@query("e27_importance_views", TWO + SHARES + ", rws AS (SELECT DISTINCT row_id FROM ab), " + draws_sql("rws", [], 20, "views") + """
, st AS (SELECT rep, set_id, feature, sum(c * abs(value)) / sum(c) AS v FROM draws JOIN ab USING (row_id) GROUP BY ALL)
SELECT s.set_id, s.feature, round(s.importance, 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high, count(v) AS reps, round(s.share, 6) AS share
FROM sh s JOIN st USING (set_id, feature) GROUP BY s.set_id, s.feature, s.importance, s.share""")
def e27(spark, sf):
    a, b = two(spark, sf)
    return rounded(G.importance_views(a.unionByName(b), 20, "views"), "estimate", "ci_low", "ci_high", "share")


@query("e28_dependence_means", with_cte(SALES, SX, PT, abl_sql()) + """
SELECT s.x0, s.x1, count(*) AS n, round(avg(a.value), 6) + 0.0 AS mean_value FROM abl a JOIN sx s USING (row_id) WHERE a.feature = 'x1' GROUP BY s.x0, s.x1""")
def e28(spark, sf):
    df = coded(spark, sf)
    out = E.dependence_means(df, E.feature_ablation(df, FEATURES, point(df), predict), "x1", "x0")
    return rounded(out, "mean_value").withColumn("mean_value", F.col("mean_value") + 0.0)


@query("e29_vector_projection")
def e29(spark, sf):
    return E.vector_projection(table(spark, sf, "embeddings"))


@query("e30_unit_concentration", """
WITH u AS (SELECT i.pos AS unit, max(abs(embedding[i.pos])) AS peak, avg(abs(CAST(embedding[i.pos] AS DOUBLE))) AS size, avg((embedding[i.pos] > 0)::INT) AS active FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) i GROUP BY i.pos),
r AS (SELECT *, row_number() OVER (ORDER BY size DESC, unit) AS r FROM u)
SELECT count(*) AS n_units, count(*) FILTER (peak = 0) AS never_active, round(median(active), 6) AS median_active_share, round(sum(size) FILTER (r <= 10) / sum(size), 6) AS top_share FROM r""")
def e30(spark, sf):
    return rounded(E.unit_concentration(table(spark, sf, "embeddings")), "median_active_share", "top_share")
