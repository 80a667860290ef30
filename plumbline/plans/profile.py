"""Queries over profiling and association (survey section 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import profile as A
from plumbline.operators import resample
from plumbline.operators import splits as D
from plumbline.operators import weights as W
from plumbline.plans.bindings import (
    DOCS, EVENTS, SALES, arm_score, docs, events, rounded, sales, sql_arm_score, sql_int, sql_key, table, with_cte,
)
from plumbline.plans.registry import query
from plumbline.plans.splits import rank_sql


@query("a1_group_profile", with_cte(SALES) + """
, c AS (SELECT grp, count(*) AS rows, sum(y) AS positives FROM sales WHERE order_year < 1999 GROUP BY grp UNION ALL SELECT 'ALL', count(*), sum(y) FROM sales WHERE order_year < 1999),
o AS (SELECT grp, count(*) AS n FROM sales WHERE order_year >= 1999 GROUP BY grp UNION ALL SELECT 'ALL', count(*) FROM sales WHERE order_year >= 1999),
t AS (SELECT rows AS tr, positives AS tp FROM c WHERE grp = 'ALL')
SELECT c.grp, rows, CAST(positives AS BIGINT) AS positives, CAST(rows - positives AS BIGINT) AS negatives, round(positives / rows, 6) AS prevalence,
  round(rows / tr, 6) AS share_of_rows, round(positives / tp, 6) AS share_of_positives, coalesce(o.n, 0) AS other_rows FROM c LEFT JOIN o USING (grp), t""")
def a1(spark, sf):
    s = sales(spark, sf)
    return rounded(A.group_profile(s.where("order_year < 1999"), other=s.where("order_year >= 1999")), "prevalence", "share_of_rows", "share_of_positives")


@query("a2_target_share", with_cte(DOCS) + "SELECT grp, y, round(count(*) / sum(count(*)) OVER (PARTITION BY grp), 6) AS share FROM docs GROUP BY grp, y")
def a2(spark, sf):
    return rounded(A.target_share(docs(spark, sf)), "share")


@query("a3_crosstab", with_cte(SALES) + """
SELECT priority, segment, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY segment), 6) AS share FROM sales GROUP BY priority, segment""")
def a3(spark, sf):
    return rounded(A.crosstab(sales(spark, sf), "priority", "segment", "column"), "share")


LONG_SALES = """lg AS (SELECT 'priority' AS "column", priority AS level, grp, y FROM sales UNION ALL SELECT 'segment', segment, grp, y FROM sales)"""


@query("a4_rate_by_level", with_cte(SALES, LONG_SALES) + 'SELECT "column", level, grp, count(*) AS n, round(avg(y), 6) AS rate FROM lg GROUP BY ALL')
def a4(spark, sf):
    return rounded(A.rate_by_level(sales(spark, sf), ["priority", "segment"], group="grp"), "rate")


@query("a5_rate_by_bin", with_cte(SALES) + """
SELECT CASE WHEN price <= 1000 THEN NULL WHEN price <= 100000 THEN 0 WHEN price <= 250000 THEN 1 WHEN price <= 450000 THEN 2 END AS bin, count(*) AS n, round(avg(y), 6) AS rate FROM sales GROUP BY 1""")
def a5(spark, sf):
    return rounded(A.rate_by_bin(sales(spark, sf), "price", [1000, 100000, 250000, 450000]), "rate")


@query("a6_disguised_missing_profile", with_cte(SALES) + """
, s AS (SELECT grp, priority, segment, y FROM sales UNION ALL SELECT 'ALL', priority, segment, y FROM sales)
SELECT 'priority' AS "column", '4-NOT SPECIFIED' AS placeholder, grp, count(*) FILTER (priority = '4-NOT SPECIFIED') AS n, round(count(*) FILTER (priority = '4-NOT SPECIFIED') / count(*), 6) AS share_of_group_rows, count(*) FILTER (priority = '4-NOT SPECIFIED' AND y = 1) AS positives FROM s GROUP BY grp
UNION ALL SELECT 'segment', 'HOUSEHOLD', grp, count(*) FILTER (segment = 'HOUSEHOLD'), round(count(*) FILTER (segment = 'HOUSEHOLD') / count(*), 6), count(*) FILTER (segment = 'HOUSEHOLD' AND y = 1) FROM s GROUP BY grp""")
def a6(spark, sf):
    return rounded(A.disguised_missing_profile(sales(spark, sf), {"priority": "4-NOT SPECIFIED", "segment": "HOUSEHOLD"}), "share_of_group_rows")


@query("a7_numeric_summary", with_cte(SALES) + """
, s AS (SELECT grp, price, balance FROM sales UNION ALL SELECT 'ALL', price, balance FROM sales),
l AS (SELECT 'price' AS feature, grp, price AS v FROM s UNION ALL SELECT 'balance', grp, balance FROM s)
SELECT feature, grp, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, max(v) AS max, count(*) FILTER (v > 450000) AS n_outliers,
  round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75 FROM l GROUP BY ALL""")
def a7(spark, sf):
    out = A.numeric_summary(sales(spark, sf), ["price", "balance"], outlier_above=450000)
    return rounded(out, "q25", "median", "q75").withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("a8_rare_levels", with_cte("""
ps AS (SELECT p_type AS grp, p_brand AS brand, 's' || (p_size // 5) AS size FROM part),
l AS (SELECT 'brand' AS "column", brand AS level, grp FROM ps UNION ALL SELECT 'size', size, grp FROM ps),
g AS (SELECT x."column", x.level, y.grp, coalesce(count(l.level), 0) AS n FROM (SELECT DISTINCT "column", level FROM l) x, (SELECT DISTINCT grp FROM l) y
  LEFT JOIN l ON l."column" = x."column" AND l.level = x.level AND l.grp = y.grp GROUP BY ALL)""") + """
SELECT "column", level, min(n) AS min_cell FROM g GROUP BY ALL HAVING min(n) < 12""")
def a8(spark, sf):
    parts = table(spark, sf, "part").select(
        F.col("p_type").alias("grp"), F.col("p_brand").alias("brand"), F.concat(F.lit("s"), F.floor(F.col("p_size") / 5).cast("string")).alias("size")
    )
    return A.rare_levels(parts, ["brand", "size"], min_cell=12)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pearson_sql(where: str = "") -> str:
    from itertools import combinations

    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem {where}" for a, b in combinations(NUMBERS, 2))


@query("a9_pearson_matrix", f"SELECT a, b, round(r, 6) AS r FROM ({pearson_sql()})")
def a9(spark, sf):
    return rounded(A.pearson_matrix(table(spark, sf, "lineitem"), NUMBERS), "r")


EARLY = "WHERE l_shipdate < TIMESTAMP '1998-01-01'"
LATE = "WHERE l_shipdate >= TIMESTAMP '1998-01-01'"


@query("a10_correlation_shift", f"""
SELECT x.a, x.b, round(x.r, 6) AS r_before, round(y.r, 6) AS r_after, round(abs(y.r - x.r), 6) AS shift
FROM ({pearson_sql(EARLY)}) x JOIN ({pearson_sql(LATE)}) y ON x.a = y.a AND x.b = y.b ORDER BY abs(y.r - x.r) DESC LIMIT 3""")
def a10(spark, sf):
    li = table(spark, sf, "lineitem")
    turn = F.lit("1998-01-01").cast("timestamp_ntz")
    return rounded(A.correlation_shift(li.where(F.col("l_shipdate") < turn), li.where(F.col("l_shipdate") >= turn), NUMBERS, 3), "r_before", "r_after", "shift")


CELLS_SQL = """cells AS ({cells}),
m AS (SELECT *, sum(n) OVER (PARTITION BY a, b, la) AS ra, sum(n) OVER (PARTITION BY a, b, lb) AS cb FROM cells),
st AS (SELECT a, b, sum(n) AS n, sum(n * n / (ra * cb)) - 1 AS phi, count(DISTINCT la) AS r, count(DISTINCT lb) AS k FROM m GROUP BY a, b)"""


def pair_sql(src: str, columns: list[str]) -> str:
    from itertools import combinations

    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS VARCHAR) AS la, CAST({b} AS VARCHAR) AS lb, CAST(count(*) AS DOUBLE) AS n FROM {src} GROUP BY ALL" for a, b in combinations(columns, 2))


PLAIN_V = "round(CASE WHEN least(r, k) < 2 THEN 0 ELSE sqrt(greatest(phi, 0) / (least(r, k) - 1)) END, 6)"


@query("a11_cramers_v", with_cte(SALES, CELLS_SQL.format(cells=pair_sql("sales", ["priority", "nation"]))) + f"SELECT a, b, {PLAIN_V} AS v FROM st")
def a11(spark, sf):
    return rounded(A.cramers_v(sales(spark, sf), "priority", "nation"), "v")


TWO = "tw AS (SELECT CASE WHEN segment IN ('BUILDING', 'FURNITURE') THEN 'a' ELSE 'b' END AS two, nation, priority, y FROM sales)"


@query("a12_cramers_v_corrected", with_cte(SALES, TWO, CELLS_SQL.format(cells=pair_sql("tw", ["two", "nation", "priority", "y"]))) + """
, full_ AS (SELECT l.a, l.b, l.la, r.lb, l.ra, r.cb, coalesce(c.n, 0) AS o, l.ra * r.cb / s.n AS e, s.n, s.r, s.k FROM
  (SELECT DISTINCT a, b, la, ra FROM m) l JOIN (SELECT DISTINCT a, b, lb, cb FROM m) r ON l.a = r.a AND l.b = r.b JOIN st s ON s.a = l.a AND s.b = l.b
  LEFT JOIN cells c ON c.a = l.a AND c.b = l.b AND c.la = l.la AND c.lb = r.lb),
x AS (SELECT a, b, any_value(n) AS n, any_value(r) AS r, any_value(k) AS k,
  sum(CASE WHEN r = 2 AND k = 2 THEN (abs(o - e) - least(0.5, abs(o - e))) * (abs(o - e) - least(0.5, abs(o - e))) / e ELSE (o - e) * (o - e) / e END) AS chi2 FROM full_ GROUP BY a, b)
SELECT a, b, round(sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1)), 6) AS v FROM x""")
def a12(spark, sf):
    s = sales(spark, sf).withColumn("two", F.when(F.col("segment").isin("BUILDING", "FURNITURE"), "a").otherwise("b"))
    return rounded(A.association_matrix(s, ["two", "nation", "priority", "y"], corrected=True), "v")


QUARTERED = """qe AS (SELECT [quantile_cont(price, 0.25), quantile_cont(price, 0.5), quantile_cont(price, 0.75)] AS p, [quantile_cont(balance, 0.25), quantile_cont(balance, 0.5), quantile_cont(balance, 0.75)] AS b FROM sales),
qs AS (SELECT grp, priority, segment, y, (price > p[1])::INT + (price > p[2])::INT + (price > p[3])::INT AS price, (balance > b[1])::INT + (balance > b[2])::INT + (balance > b[3])::INT AS balance FROM sales, qe)"""


@query("a13_association_matrix", with_cte(SALES, QUARTERED, CELLS_SQL.format(cells=pair_sql("qs", ["grp", "priority", "segment", "y", "price", "balance"]))) + f"SELECT a, b, {PLAIN_V} AS v FROM st")
def a13(spark, sf):
    return rounded(A.association_matrix(sales(spark, sf), ["grp", "priority", "segment", "y"], ["price", "balance"]), "v")


@query("a14_total_variation", with_cte(SALES, LONG_SALES) + """
, g AS (SELECT x."column", x.level, h.grp, count(l.level) AS n FROM (SELECT DISTINCT "column", level FROM lg) x, (SELECT DISTINCT grp FROM lg) h LEFT JOIN lg l ON l."column" = x."column" AND l.level = x.level AND l.grp = h.grp GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY "column", grp) AS share FROM g)
SELECT x."column", x.grp AS a, z.grp AS b, round(sum(abs(x.share - z.share)) / 2, 6) AS distance FROM s x JOIN s z ON x."column" = z."column" AND x.level = z.level AND x.grp < z.grp GROUP BY ALL""")
def a14(spark, sf):
    return rounded(A.total_variation(sales(spark, sf), ["priority", "segment"]), "distance")


def smoted(spark, sf):
    """Labelled documents with the rarer quality class oversampled on length and two one-hot language columns."""
    d = docs(spark, sf)
    block = d.select(
        "row_id", "y", F.col("n_chars").cast("double").alias("n_chars"), (F.col("grp") == "en").cast("double").alias("lang_en"),
        (F.col("grp") != "en").cast("double").alias("lang_other"),
    )
    return block, resample.smote(block, ["n_chars", "lang_en", "lang_other"], 5, "blend", minority=0)


@query("a15_resampling_balance", with_cte(SALES, f"f AS (SELECT y, CAST(({rank_sql('grp, y', 'fold')} - 1) % 3 AS INTEGER) AS fold FROM sales)") + """
, c AS (SELECT fold, y, count(*) AS n FROM f GROUP BY ALL)
SELECT 'before' AS stage, fold, y, n FROM c UNION ALL SELECT 'after', fold, y, max(n) OVER (PARTITION BY fold) FROM c""")
def a15(spark, sf):
    rows = sales(spark, sf).select("row_id", "grp", "y", "price")
    folded = D.stratified_folds(rows, ["grp", "y"], 3, "fold")
    after = None
    for fold in range(3):
        part = resample.smote(folded.where(F.col("fold") == fold), ["price"], 2, f"bal-{fold}").withColumn("fold", F.lit(fold))
        after = part if after is None else after.unionByName(part)
    return A.resampling_balance(folded, after)


BLEND_SQL = f"""bl AS (SELECT row_id, y, CAST(n_chars AS DOUBLE) AS a, CAST((grp = 'en')::INT AS DOUBLE) AS b, CAST((grp <> 'en')::INT AS DOUBLE) AS c FROM docs),
sm AS (SELECT row_id, a, b, c, min(row_id) OVER (PARTITION BY a, b, c) AS gid, {rank_sql('', 'blend-base')} AS rk FROM bl WHERE y = 0),
nn AS (SELECT x.row_id, z.b AS nb, z.c AS nc, row_number() OVER (PARTITION BY x.row_id ORDER BY sqrt((x.a - z.a) * (x.a - z.a) + (x.b - z.b) * (x.b - z.b) + (x.c - z.c) * (x.c - z.c)), z.gid, z.row_id) AS pos
  FROM sm x JOIN sm z ON x.row_id <> z.row_id QUALIFY pos <= 5),
sl AS (SELECT {rank_sql('', 'blend-slot')} AS slot FROM bl WHERE y <> 0),
dr AS (SELECT slot, {sql_int('blend-draw', 'slot')} % (SELECT count(*) FROM sm) + 1 AS rk, {sql_int('blend-nbr', 'slot')} % 5 + 1 AS j,
  ({sql_int('blend-u', 'slot')} % 1000000) / 1000000.0 AS u FROM sl WHERE slot <= (SELECT count(*) FROM sl) - (SELECT count(*) FROM sm)),
al AS (SELECT b, c FROM bl UNION ALL SELECT s.b + u * (n.nb - s.b), s.c + u * (n.nc - s.c) FROM dr JOIN sm s USING (rk) JOIN nn n ON n.row_id = s.row_id AND n.pos = dr.j)"""


@query("a16_blended_levels", with_cte(DOCS, BLEND_SQL) + """
SELECT CASE WHEN b >= c THEN 'en' ELSE 'other' END AS dominant, count(*) AS n, count(*) FILTER (greatest(b, c) < 0.999) AS n_blended FROM al GROUP BY 1""")
def a16(spark, sf):
    _, after = smoted(spark, sf)
    return A.blended_levels(after, {"en": "lang_en", "other": "lang_other"})


@query("a16_non_integer_share", with_cte(EVENTS) + """
SELECT 'value' AS "column", round(avg((value % 1 <> 0)::INT), 6) AS share FROM ev UNION ALL SELECT 'k', round(avg((k % 1 <> 0)::INT), 6) FROM ev""")
def a16_codes(spark, sf):
    return rounded(A.non_integer_share(events(spark, sf), ["value", "k"]), "share")


@query("a17_positive_share", with_cte(SALES) + f"SELECT grp, count(*) AS n, round(avg(({sql_arm_score('a')} >= 0.5)::INT), 6) AS positive_share FROM sales GROUP BY grp")
def a17(spark, sf):
    return rounded(A.positive_share(sales(spark, sf).withColumn("score", arm_score("a")), 0.5, ["grp"]), "positive_share")


@query("a18_latency_summary", with_cte(EVENTS) + """
SELECT event_type, count(value) AS runs, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(sum(k) * 1000.0 / sum(value), 6) AS rows_per_second,
  round(median(value), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
  round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci_low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci_high FROM ev GROUP BY event_type""")
def a18(spark, sf):
    out = A.latency_summary(events(spark, sf), "value", ["event_type"], F.col("k"))
    return rounded(out, "mean", "max", "rows_per_second", "p50", "p95", "p99", "ci_low", "ci_high")


LOSS = "-(y * ln(least(greatest({s}, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest({s}, 1e-15), 1 - 1e-15)))"


@query("a19_group_mean_loss", with_cte(SALES) + f"""
, w AS (SELECT grp, y, {sql_arm_score('a')} AS s, count(*) OVER () / (2 * count(*) OVER (PARTITION BY y)) AS weight FROM sales)
SELECT grp, count(*) AS n, round(avg({LOSS.format(s='s')} * weight), 6) AS loss FROM w GROUP BY grp""")
def a19(spark, sf):
    weighted = W.class_weights(sales(spark, sf).withColumn("score", arm_score("a")))
    return rounded(A.group_mean_loss(weighted, n_groups=5), "loss")


@query("a20_history_mean", """
WITH l AS (SELECT vec_id, label, CAST(floor(i / 4) AS INTEGER) + 1 AS epoch, CAST(i % 4 AS INTEGER) AS grp, CAST(embedding[1 + i] AS DOUBLE) AS q, CAST(embedding[33 + i] AS DOUBLE) AS loss FROM embeddings, (SELECT unnest(range(32)) AS i))
SELECT epoch, grp AS "group", round(avg(q), 6) AS q, round(avg(loss), 6) AS loss FROM l GROUP BY ALL""")
def a20(spark, sf):
    e = table(spark, sf, "embeddings")
    steps = F.sequence(F.lit(0), F.lit(7))

    def nested(first: int):
        return F.transform(steps, lambda i: F.slice(F.transform("embedding", lambda v: v.cast("double")), i * 4 + first, 4))

    return rounded(A.history_mean(e.select(nested(1).alias("q"), nested(33).alias("loss"))), "q", "loss")
