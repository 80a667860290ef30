"""Queries over splits, samples, weights and contexts (survey section 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import contexts as X
from plumbline.operators import profile as A
from plumbline.operators import resample
from plumbline.operators import splits as D
from plumbline.operators import weights as W
from plumbline.plans.bindings import (
    DOCS, SALES, arm_score, docs, rounded, sales, sql_arm_score, sql_int, sql_key, table, with_cte,
)
from plumbline.plans.registry import query


def rank_sql(part: str, seed: str, *salt: str) -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY {sql_key(seed, *salt, 'row_id')}, row_id)"


@query("d1_stratified_folds", with_cte(SALES) + f"SELECT row_id, CAST(({rank_sql('grp, y', 'fold')} - 1) % 5 AS INTEGER) AS fold FROM sales")
def d1(spark, sf):
    return D.stratified_folds(sales(spark, sf), ["grp", "y"], 5, "fold").select("row_id", "fold")


@query("d2_nested_folds", with_cte(SALES) + f"""
, o AS (SELECT *, ({rank_sql('grp, y', 'nest')} - 1) % 5 AS own FROM sales),
t AS (SELECT o.*, f.outer_fold FROM o, (SELECT CAST(unnest(range(5)) AS INTEGER) AS outer_fold) f WHERE f.outer_fold <> o.own)
SELECT row_id, outer_fold, CAST(({rank_sql('outer_fold, grp, y', 'nest-inner', 'outer_fold')} - 1) % 3 AS INTEGER) AS inner_fold FROM t""")
def d2(spark, sf):
    return D.nested_folds(sales(spark, sf), ["grp", "y"], 5, 3, "nest").select("row_id", "outer_fold", "inner_fold")


@query("d3_leave_one_group_out", with_cte(SALES) + """
SELECT h.held_out, count(*) FILTER (grp <> held_out) AS train_rows, count(*) FILTER (grp = held_out) AS val_rows
FROM sales, (SELECT DISTINCT grp AS held_out FROM sales) h GROUP BY h.held_out""")
def d3(spark, sf):
    return D.split_sizes(D.leave_one_group_out(sales(spark, sf).select("grp"), "grp"))


@query("d4_stratified_holdout", with_cte(SALES) + f"SELECT row_id, {rank_sql('y', 'hold')} <= floor(count(*) OVER (PARTITION BY y) * 0.2 + 0.5) AS is_holdout FROM sales")
def d4(spark, sf):
    return D.stratified_holdout(sales(spark, sf), 0.2, ["y"], "hold").select("row_id", "is_holdout")


def sample_sql(src: str, n: int, seed: str, name: str) -> str:
    """CTE ``name``: n rows of ``src`` by largest-remainder quotas over grp, y."""
    return f"""{name}_c AS (SELECT grp, y, count(*) AS n, count(*) * {n} / sum(count(*)) OVER () AS exact FROM {src} GROUP BY grp, y),
{name}_q AS (SELECT grp, y, floor(exact) + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, grp, y) <= {n} - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM {name}_c),
{name} AS (SELECT s.row_id, s.grp, s.y FROM (SELECT *, {rank_sql('grp, y', seed)} AS rk FROM {src}) s JOIN {name}_q q ON s.grp = q.grp AND s.y = q.y WHERE s.rk <= q.quota)"""


@query("d5_stratified_sample", with_cte(SALES, "pool AS (SELECT * FROM sales WHERE priority <> '5-LOW')", sample_sql("pool", 777, "take", "smp")) + "SELECT row_id, grp, y FROM smp")
def d5(spark, sf):
    s = sales(spark, sf)
    return D.stratified_sample(s, 777, ["grp", "y"], "take", exclude=s.where("priority = '5-LOW'")).select("row_id", "grp", "y")


@query("d6_build_sample_sets", with_cte(SALES, sample_sql("sales", 200, "sets-background", "bg"),
    "rest AS (SELECT * FROM sales WHERE row_id NOT IN (SELECT row_id FROM bg))", sample_sql("rest", 500, "sets-pooled", "pl")) + """
SELECT 'background' AS set_name, row_id FROM bg UNION ALL SELECT 'pooled', row_id FROM pl UNION ALL SELECT 'focus', row_id FROM sales WHERE grp = 'ASIA'
UNION ALL SELECT 'explanation', row_id FROM (SELECT row_id FROM pl UNION SELECT row_id FROM sales WHERE grp = 'ASIA')""")
def d6(spark, sf):
    return D.build_sample_sets(sales(spark, sf), 200, 500, "ASIA", "sets")


@query("d7_fraction_per_stratum", with_cte(SALES) + f"""
SELECT row_id, grp, y FROM (SELECT *, {rank_sql('grp, y', 'frac')} AS rk, count(*) OVER (PARTITION BY grp, y) AS n FROM sales) WHERE rk <= floor(n * 0.1 + 0.5)""")
def d7(spark, sf):
    return D.fraction_per_stratum(sales(spark, sf), 0.1, ["grp", "y"], "frac").select("row_id", "grp", "y")


@query("d8_sample_n", with_cte(SALES) + f"SELECT row_id FROM sales ORDER BY {sql_key('pick', 'row_id')}, row_id LIMIT 300")
def d8(spark, sf):
    return D.sample_n(sales(spark, sf), 300, "pick").select("row_id")


@query("d9_sample_with_replacement", with_cte(SALES) + f"""
, p AS (SELECT row_id, {rank_sql('', 'rep-pool')} AS rk FROM sales WHERE segment = 'BUILDING'),
d AS (SELECT i AS draw, {sql_int('rep', 'i')} % (SELECT count(*) FROM p) + 1 AS rk FROM (SELECT unnest(range(2000)) AS i))
SELECT d.draw, p.row_id FROM d JOIN p USING (rk)""")
def d9(spark, sf):
    pool = sales(spark, sf).where("segment = 'BUILDING'")
    return D.sample_with_replacement(pool, 2000, "rep").select("draw", "row_id")


def deal_sql(take: str, n: str, rank: str, lists: int, limit_cte: str = "") -> str:
    return f"(({rank} - 1 - list_id * {take}) % {n} + {n}) % {n} < {take}"


@query("d10_stratified_contexts", with_cte(SALES) + f"""
, r AS (SELECT row_id, grp, y, {rank_sql('grp, y', 'ctx')} AS rk, count(*) OVER (PARTITION BY grp, y) AS n,
  CAST(floor(count(*) OVER (PARTITION BY grp, y) * least(1.0, 2000 / count(*) OVER ())) AS BIGINT) AS take FROM sales)
SELECT list_id, row_id FROM r, (SELECT CAST(unnest(range(4)) AS INTEGER) AS list_id) WHERE {deal_sql('take', 'n', 'rk', 4)}""")
def d10(spark, sf):
    return X.stratified_contexts(sales(spark, sf), ["grp", "y"], 4, 2000, "ctx").select("list_id", "row_id")


@query("d11_balanced_contexts", with_cte(SALES) + f"""
, c AS (SELECT grp, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY grp) AS ng FROM sales GROUP BY grp, y),
k AS (SELECT least((SELECT min(ng) FROM c), (SELECT floor(3000 / count(DISTINCT grp)) FROM c)) AS per),
t AS (SELECT c.grp, c.y, c.n, CAST(floor(k.per * c.n / c.ng) AS BIGINT) AS take FROM c, k),
r AS (SELECT row_id, grp, y, {rank_sql('grp, y', 'bal')} AS rk FROM sales)
SELECT list_id, r.row_id FROM r JOIN t USING (grp, y), (SELECT CAST(unnest(range(3)) AS INTEGER) AS list_id) WHERE {deal_sql('take', 'n', 'rk', 3)}""")
def d11(spark, sf):
    return X.balanced_contexts(sales(spark, sf), "grp", "y", 3, 3000, "bal").select("list_id", "row_id")


@query("d12_balanced_batches", with_cte(DOCS) + f"""
, g AS (SELECT grp, count(*) AS n, floor(64 / count(*) OVER ()) AS per, ceil(sum(count(*)) OVER () / 64) AS steps FROM docs GROUP BY grp),
p AS (SELECT d.row_id, g.*, unnest(range(CAST(ceil(per * steps * 3 / n) AS BIGINT))) AS pass FROM docs d JOIN g USING (grp)),
q AS (SELECT *, pass * n + {rank_sql('grp, pass', 'batch', 'pass')} - 1 AS q FROM p)
SELECT CAST(floor(floor(q / per) / steps) AS BIGINT) AS epoch, CAST(floor(q / per) % steps AS BIGINT) AS step, CAST(q % per AS BIGINT) AS slot, grp, row_id FROM q WHERE q < per * steps * 3""")
def d12(spark, sf):
    return X.balanced_batches(docs(spark, sf), "grp", 64, 3, "batch")


@query("d13_class_weights", with_cte(DOCS) + "SELECT row_id, round(count(*) OVER () / ((SELECT count(DISTINCT toxic) FROM docs) * count(*) OVER (PARTITION BY toxic)), 6) AS weight FROM docs")
def d13(spark, sf):
    return rounded(W.class_weights(docs(spark, sf), "toxic").select("row_id", "weight"), "weight")


@query("d14_within_group_class_weights", with_cte(DOCS) + """
, k AS (SELECT grp, count(DISTINCT y) AS k FROM docs GROUP BY grp)
SELECT row_id, round(count(*) OVER (PARTITION BY grp) / (k * count(*) OVER (PARTITION BY grp, y)), 6) AS weight FROM docs JOIN k USING (grp)""")
def d14(spark, sf):
    return rounded(W.within_group_class_weights(docs(spark, sf)).select("row_id", "weight"), "weight")


@query("d15_group_weights", with_cte(DOCS) + """
, w AS (SELECT row_id, count(*) OVER () / ((SELECT count(DISTINCT grp) FROM docs) * count(*) OVER (PARTITION BY grp)) AS g,
  count(*) OVER () / ((SELECT count(DISTINCT y) FROM docs) * count(*) OVER (PARTITION BY y)) AS c FROM docs)
SELECT row_id, round(g, 6) AS group_weight, round(g * c, 6) AS weight FROM w""")
def d15(spark, sf):
    both = W.class_by_group_weights(W.group_weights(docs(spark, sf), out="group_weight"))
    return rounded(both.select("row_id", "group_weight", "weight"), "group_weight", "weight")


@query("d16_no_resampling", with_cte(SALES) + "SELECT grp, count(*) AS n, count(*) FILTER (row_id IS NULL) AS n_weighted FROM sales GROUP BY grp")
def d16(spark, sf):
    return W.no_resampling(sales(spark, sf)).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count("weight").alias("n_weighted"))


SMOTE_SQL = f"""rws AS (SELECT row_id, y, price AS a, balance * 50 AS b FROM sales),
sm AS (SELECT row_id, a, b, {rank_sql('', 'smote-base')} AS rk FROM rws WHERE y = 1),
nn AS (SELECT x.row_id, z.a AS na, z.b AS nb, row_number() OVER (PARTITION BY x.row_id ORDER BY sqrt((x.a - z.a) * (x.a - z.a) + (x.b - z.b) * (x.b - z.b)), z.row_id) AS pos
  FROM sm x JOIN sm z ON x.row_id <> z.row_id QUALIFY pos <= 5),
sl AS (SELECT {rank_sql('', 'smote-slot')} AS slot FROM rws WHERE y = 0),
dr AS (SELECT slot, {sql_int('smote-draw', 'slot')} % (SELECT count(*) FROM sm) + 1 AS rk, {sql_int('smote-nbr', 'slot')} % 5 + 1 AS j,
  ({sql_int('smote-u', 'slot')} % 1000000) / 1000000.0 AS u FROM sl WHERE slot <= (SELECT count(*) FROM sl) - (SELECT count(*) FROM sm))"""


@query("d17_smote", with_cte(SALES, SMOTE_SQL) + """
SELECT row_id, y, round(a, 8) AS a, round(b, 8) AS b, false AS is_synthetic FROM rws
UNION ALL SELECT NULL, 1, round(s.a + u * (n.na - s.a), 8), round(s.b + u * (n.nb - s.b), 8), true FROM dr JOIN sm s USING (rk) JOIN nn n ON n.row_id = s.row_id AND n.pos = dr.j""")
def d17(spark, sf):
    rows = sales(spark, sf).select("row_id", "y", F.col("price").alias("a"), (F.col("balance") * 50).alias("b"))
    out = resample.smote(rows, ["a", "b"], 5, "smote")
    return out.withColumns({"a": F.round("a", 8), "b": F.round("b", 8)})


@query("d18_group_ids", with_cte(DOCS) + "SELECT row_id, CAST(dense_rank() OVER (ORDER BY grp) - 1 AS INTEGER) AS group_id, CAST(dense_rank() OVER (ORDER BY grp || '_' || y) - 1 AS INTEGER) AS cell_id FROM docs")
def d18(spark, sf):
    return W.group_ids(W.group_ids(docs(spark, sf)), target="y", out="cell_id").select("row_id", "group_id", "cell_id")


def audit_sql(seeds: list[int]) -> str:
    parts = []
    for s in seeds:
        parts.append(f"""SELECT 'nested_cv_outer' AS design, '{s}' AS seed, CAST(own AS VARCHAR) AS fold, (SELECT count(*) FROM sales) - count(*) AS train_rows, count(*) AS test_rows, CAST(sum(y) AS BIGINT) AS test_positives
  FROM (SELECT y, ({rank_sql('grp, y', f'audit-{s}')} - 1) % 5 AS own FROM sales) GROUP BY own""")
        parts.append(f"""SELECT 'nested_cv_inner', '{s}', outer_fold || '.' || inner_fold, CAST(sum(count(*)) OVER (PARTITION BY outer_fold) - count(*) AS BIGINT), count(*), CAST(sum(y) AS BIGINT) FROM (
    SELECT outer_fold, y, ({rank_sql('outer_fold, grp, y', f'audit-{s}-inner', 'outer_fold')} - 1) % 3 AS inner_fold FROM (
      SELECT o.*, f.outer_fold FROM (SELECT *, ({rank_sql('grp, y', f'audit-{s}')} - 1) % 5 AS own FROM sales) o, (SELECT CAST(unnest(range(5)) AS INTEGER) AS outer_fold) f WHERE f.outer_fold <> o.own)) GROUP BY outer_fold, inner_fold""")
    parts.append("SELECT 'leave_one_group_out', 'n/a', grp, (SELECT count(*) FROM sales) - count(*), count(*), CAST(sum(y) AS BIGINT) FROM sales GROUP BY grp")
    return " UNION ALL\n".join(parts)


@query("d19_fold_size_audit", with_cte(SALES) + audit_sql([0, 1]))
def d19(spark, sf):
    return D.fold_size_audit(sales(spark, sf), [0, 1], 5, 3)


@query("d19_fold_size_summary", with_cte(SALES, f"au AS ({audit_sql([0])})") + """
SELECT design, count(*) AS folds, min(train_rows) AS min_train_rows, max(train_rows) AS max_train_rows, min(test_positives) AS min_test_positives FROM au GROUP BY design""")
def d19_summary(spark, sf):
    return D.fold_size_summary(D.fold_size_audit(sales(spark, sf), [0], 5, 3))


@query("d20_composition", with_cte(DOCS) + """
, s AS (SELECT grp, y, count(*) AS n FROM docs WHERE n_chars > 9000 GROUP BY ALL)
SELECT g.grp, t.y, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT grp FROM s) g, (SELECT DISTINCT y FROM s) t LEFT JOIN s ON s.grp = g.grp AND s.y = t.y""")
def d20(spark, sf):
    d = docs(spark, sf)
    return D.composition(d, d.where("n_chars > 9000"))


@query("d21_random_rankings", with_cte(DOCS) + f"""
SELECT perm, row_id, feature, CAST(row_number() OVER (PARTITION BY perm, row_id ORDER BY {sql_key('perm', 'perm', 'row_id', 'feature')}) AS INTEGER) AS rank
FROM docs, (SELECT CAST(unnest(range(3)) AS INTEGER) AS perm), (SELECT unnest(['age', 'job', 'phone', 'region']) AS feature)""")
def d21(spark, sf):
    return D.random_rankings(docs(spark, sf), ["age", "job", "phone", "region"], 3, "perm")


@query("d22_pick_examples", with_cte(SALES) + f"""
, p AS (SELECT row_id, grp, y, {sql_arm_score('a')} AS score FROM sales), f AS (SELECT * FROM p WHERE grp = 'EUROPE')
SELECT 'confident_tp' AS rule, (SELECT row_id FROM p WHERE y = 1 AND score >= 0.5 ORDER BY score DESC, row_id LIMIT 1) AS row_id
UNION ALL SELECT 'confident_tn', (SELECT row_id FROM p WHERE y = 0 AND score < 0.5 ORDER BY score, row_id LIMIT 1)
UNION ALL SELECT 'false_negative', (SELECT row_id FROM p WHERE y = 1 AND score < 0.5 ORDER BY score, row_id LIMIT 1)
UNION ALL SELECT 'false_positive', (SELECT row_id FROM p WHERE y = 0 AND score >= 0.5 ORDER BY score DESC, row_id LIMIT 1)
UNION ALL SELECT 'focus_typical', (SELECT row_id FROM f ORDER BY abs(score - (SELECT median(score) FROM f)), row_id LIMIT 1)""")
def d22(spark, sf):
    s = sales(spark, sf).withColumn("score", arm_score("a"))
    return D.pick_examples(s, s.where("grp = 'EUROPE'"), 0.5)
