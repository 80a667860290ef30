"""Queries over cleaning, encoders and binning (survey section 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import encode as P
from plumbline.plans.bindings import (
    DOCS, EVENTS, SALES, arm_score, docs, events, rounded, sales, sql_arm_score, table, with_cte,
)
from plumbline.plans.registry import query

PRIORITIES = {"priority": "4-NOT SPECIFIED", "absent_column": "x"}
CATEGORICAL = ["priority", "segment"]
NUMERIC = ["price", "balance"]
VOCAB_SQL = """vocab AS (
  SELECT 'priority' AS "column", priority AS level, CAST(row_number() OVER (ORDER BY priority) AS INTEGER) AS idx
  FROM (SELECT DISTINCT priority FROM sales WHERE order_year < 1997 AND segment <> 'MACHINERY' AND priority <> '5-LOW')
  UNION ALL
  SELECT 'segment', segment, CAST(row_number() OVER (ORDER BY segment) AS INTEGER)
  FROM (SELECT DISTINCT segment FROM sales WHERE order_year < 1997 AND segment <> 'MACHINERY' AND priority <> '5-LOW'))"""


def train_part(df):
    return df.where("order_year < 1997 AND segment <> 'MACHINERY' AND priority <> '5-LOW'")


@query("p1_recode_disguised_missing", with_cte(SALES) + """
SELECT CASE WHEN priority = '4-NOT SPECIFIED' THEN 'unknown' ELSE priority END AS priority, count(*) AS n FROM sales GROUP BY 1""")
def p1(spark, sf):
    return P.recode_disguised_missing(sales(spark, sf), PRIORITIES).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


@query("p2_flag_above", """
SELECT p_size, p_size > 40 AS is_outlier, count(*) AS n FROM part GROUP BY ALL""")
def p2(spark, sf):
    return P.flag_above(table(spark, sf, "part"), "p_size", 40, "is_outlier").groupBy("p_size", "is_outlier").agg(F.count(F.lit(1)).alias("n"))


@query("p3_one_hot", with_cte(SALES) + """
SELECT row_id, (priority = '1-URGENT')::INT AS p1_urgent, (priority = '2-HIGH')::INT AS p2_high,
  (priority = '3-MEDIUM')::INT AS p3_medium, (priority = '4-NOT SPECIFIED')::INT AS p4_none,
  (segment = 'AUTOMOBILE')::INT AS seg_auto, (segment = 'BUILDING')::INT AS seg_building,
  (segment = 'FURNITURE')::INT AS seg_furniture, (segment = 'HOUSEHOLD')::INT AS seg_household, 10 AS n_encoded
FROM sales""")
def p3(spark, sf):
    s = sales(spark, sf)
    vocab = P.vocabulary_map(train_part(s), CATEGORICAL)
    out = P.one_hot(s, vocab)
    names = {
        "priority_1-URGENT": "p1_urgent", "priority_2-HIGH": "p2_high", "priority_3-MEDIUM": "p3_medium",
        "priority_4-NOT SPECIFIED": "p4_none", "segment_AUTOMOBILE": "seg_auto", "segment_BUILDING": "seg_building",
        "segment_FURNITURE": "seg_furniture", "segment_HOUSEHOLD": "seg_household",
    }
    n_encoded = sum(len(ls) for ls in vocab.values()) + len(NUMERIC)
    return out.select("row_id", *[F.col(f"`{k}`").alias(v) for k, v in names.items()], F.lit(n_encoded).alias("n_encoded"))


@query("p3_one_hot_sparse", with_cte(EVENTS) + """
, a AS (SELECT event_type AS level, row_number() OVER (ORDER BY event_type) AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT event_type FROM ev)),
b AS (SELECT level, row_number() OVER (ORDER BY level) AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS level FROM ev))
SELECT row_id, a.n + b.n AS size, CAST(a.idx - 1 AS VARCHAR) || ',' || CAST(a.n + b.idx - 1 AS VARCHAR) AS places FROM ev JOIN a ON a.level = event_type JOIN b ON b.level = CAST(user_id AS VARCHAR)""")
def p3_sparse(spark, sf):
    """Users as levels: a vocabulary that grows with the table."""
    ev = events(spark, sf).select("row_id", "event_type", "user_id")
    columns = ["event_type", "user_id"]
    out = P.one_hot_sparse(ev, P.vocabulary(ev, columns), columns)
    return out.select("row_id", "hot.size", F.array_join(F.col("hot.indices").cast("array<string>"), ",").alias("places"))


@query("p9_codes_from_table", with_cte(EVENTS) + """
SELECT row_id, CAST(user_id AS VARCHAR) AS user_id, CAST(dense_rank() OVER (ORDER BY CAST(user_id AS VARCHAR)) - 1 AS BIGINT) AS code FROM ev""")
def p9_table(spark, sf):
    ev = events(spark, sf).select("row_id", "user_id", "value")
    vocab = P.vocabulary(ev, ["user_id"])
    coded = P.codes_from_table(ev, vocab, ["user_id"], ["value"])
    back = P.levels_from_table(coded.drop("user_id"), vocab, ["user_id"])
    return back.select("row_id", "user_id", F.get("codes", 0).cast("bigint").alias("code"))


@query("p4_index_levels", with_cte(SALES, VOCAB_SQL) + """
SELECT s.row_id, coalesce(p.idx, 0) AS priority_idx, coalesce(g.idx, 0) AS segment_idx
FROM sales s LEFT JOIN vocab p ON p."column" = 'priority' AND p.level = s.priority
LEFT JOIN vocab g ON g."column" = 'segment' AND g.level = s.segment""")
def p4(spark, sf):
    s = sales(spark, sf)
    out = P.index_levels(s, P.vocabulary(train_part(s), CATEGORICAL), CATEGORICAL)
    return out.select("row_id", "priority_idx", "segment_idx")


@query("p4_vocabulary_sizes", with_cte(SALES, VOCAB_SQL) + 'SELECT "column", count(*) + 1 AS size FROM vocab GROUP BY ALL')
def p4_sizes(spark, sf):
    return P.vocabulary_sizes(P.vocabulary(train_part(sales(spark, sf)), CATEGORICAL))


SCALE_SQL = """st AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(balance) AS mb, stddev_pop(balance) AS sb
  FROM sales WHERE order_year < 1997 AND segment <> 'MACHINERY' AND priority <> '5-LOW')"""


@query("p5_standardize", with_cte(SALES, SCALE_SQL) + """
SELECT row_id, round((price - mp) / sp, 6) AS price, round((balance - mb) / sb, 6) AS balance FROM sales, st""")
def p5(spark, sf):
    s = sales(spark, sf)
    return rounded(P.standardize(s, train_part(s), NUMERIC).select("row_id", *NUMERIC), *NUMERIC)


@query("p6_tree_branch", with_cte(SALES) + """
SELECT row_id, (CASE WHEN priority = '4-NOT SPECIFIED' THEN 'unknown' ELSE priority END = 'unknown')::INT AS priority_unknown,
  (priority = '1-URGENT')::INT AS p1_urgent, (segment = 'BUILDING')::INT AS seg_building, price > 400000 AS price_outlier, price
FROM sales""")
def p6_tree(spark, sf):
    s = sales(spark, sf)
    out = P.tree_branch(s, train_part(s), CATEGORICAL, PRIORITIES, ("price", 400000, "price_outlier"))
    return out.select(
        "row_id", "priority_unknown", F.col("`priority_1-URGENT`").alias("p1_urgent"),
        F.col("segment_BUILDING").alias("seg_building"), "price_outlier", "price",
    )


@query("p6_index_branch", with_cte(SALES, SCALE_SQL) + """
SELECT row_id,
  CASE priority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 0 END AS priority_idx,
  CASE segment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 0 END AS segment_idx,
  round((price - mp) / sp, 6) AS price, price > 400000 AS price_outlier
FROM sales, st""")
def p6_index(spark, sf):
    s = sales(spark, sf)
    out = P.index_branch(s, train_part(s), CATEGORICAL, NUMERIC, PRIORITIES, ("price", 400000, "price_outlier"))
    return rounded(out.select("row_id", "priority_idx", "segment_idx", "price", "price_outlier"), "price")


@query("p7_stratify_key", with_cte(DOCS) + "SELECT grp || '_' || y AS strat_key, count(*) AS n FROM docs GROUP BY 1")
def p7(spark, sf):
    return docs(spark, sf).groupBy(P.stratify_key("grp", "y").alias("strat_key")).agg(F.count(F.lit(1)).alias("n"))


@query("p8_encode_strict", with_cte(SALES) + """
SELECT row_id, (priority = '1-URGENT')::INT AS p1_urgent, (segment = 'MACHINERY')::INT AS seg_machinery, price FROM sales""")
def p8(spark, sf):
    s = sales(spark, sf)
    out = P.encode_strict(s, P.vocabulary_map(s, CATEGORICAL), NUMERIC)
    return out.select("row_id", F.col("`priority_1-URGENT`").alias("p1_urgent"), F.col("segment_MACHINERY").alias("seg_machinery"), "price")


@query("p9_to_codes", with_cte(SALES) + """
, v AS (SELECT priority AS level, row_number() OVER (ORDER BY priority) - 1 AS code FROM (SELECT DISTINCT priority FROM sales)),
g AS (SELECT segment AS level, row_number() OVER (ORDER BY segment) - 1 AS code FROM (SELECT DISTINCT segment FROM sales))
SELECT s.row_id, CAST(v.code AS DOUBLE) AS c0, CAST(g.code AS DOUBLE) AS c1, s.price AS c2, s.priority AS priority, s.segment AS segment
FROM sales s JOIN v ON v.level = s.priority JOIN g ON g.level = s.segment""")
def p9(spark, sf):
    s = sales(spark, sf)
    vocab = P.vocabulary_map(s, CATEGORICAL)
    coded = P.to_codes(s, vocab, ["price"]).select("row_id", "codes")
    back = P.from_codes(coded, vocab, ["price"])
    return back.select(
        "row_id", F.element_at("codes", 1).alias("c0"), F.element_at("codes", 2).alias("c1"), F.element_at("codes", 3).alias("c2"),
        "priority", "segment",
    )


BASELINE_SQL = """c AS (SELECT 'priority' AS feature, priority AS level, count(*) AS n, row_number() OVER (ORDER BY priority) - 1 AS code FROM sales GROUP BY 2
  UNION ALL SELECT 'segment', segment, count(*), row_number() OVER (ORDER BY segment) - 1 FROM sales GROUP BY 2),
b AS (SELECT feature, CAST(code AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, code) AS r FROM c) WHERE r = 1)"""


@query("p10_baseline_point", with_cte(SALES, BASELINE_SQL) + """
SELECT 'modal' AS kind, feature, round(value, 6) AS value FROM b
UNION ALL SELECT 'unknown', feature, -1.0 FROM b
UNION ALL SELECT k, 'price', (SELECT round(avg(price), 6) FROM sales) FROM (VALUES ('modal'), ('unknown')) t(k)
UNION ALL SELECT k, 'balance', (SELECT round(avg(balance), 6) FROM sales) FROM (VALUES ('modal'), ('unknown')) t(k)""")
def p10(spark, sf):
    s = sales(spark, sf)
    vocab = P.vocabulary(s, CATEGORICAL)
    parts = [P.baseline_point(s, vocab, CATEGORICAL, NUMERIC, kind).withColumn("kind", F.lit(kind)) for kind in ("modal", "unknown")]
    return rounded(parts[0].unionByName(parts[1]), "value").select("kind", "feature", "value")


@query("p11_select_scenario", with_cte(SALES) + """
SELECT row_id, price FROM sales WHERE segment = 'BUILDING' AND priority IN ('1-URGENT', '2-HIGH') AND grp = 'ASIA'""")
def p11(spark, sf):
    chosen = P.select_scenario(
        sales(spark, sf), {"segment": ["BUILDING"], "priority": ["1-URGENT", "2-HIGH"]}, group=("grp", "ASIA")
    )
    return chosen.select("row_id", "price")


@query("p12_cut", """
SELECT CASE WHEN p_size <= 0 THEN NULL WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 WHEN p_size <= 45 THEN 2 END AS bin,
  count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1""")
def p12(spark, sf):
    binned = P.cut(table(spark, sf, "part"), "p_size", [0, 10, 25, 45])
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))


@query("p13_qcut", with_cte(EVENTS) + """
, e AS (SELECT quantile_cont(k, 0.25) AS a, quantile_cont(k, 0.5) AS b, quantile_cont(k, 0.75) AS c FROM ev)
SELECT row_id, CASE WHEN k <= a THEN 0 WHEN k <= b THEN 1 WHEN k <= c THEN 2 ELSE 3 END AS bin FROM ev, e""")
def p13(spark, sf):
    return P.qcut(events(spark, sf), "k", 4).select("row_id", "bin")


@query("p14_nudge", with_cte(EVENTS) + """
, m AS (SELECT CAST(min(k) AS DOUBLE) AS lo, CAST(max(k) AS DOUBLE) AS hi FROM ev WHERE event_type = 'view')
SELECT row_id, d AS delta, CAST(k + d AS DOUBLE) AS k, k + d BETWEEN 5 AND 95 AS valid
FROM ev, (VALUES (-1.0::DOUBLE), (1.0::DOUBLE)) t(d)""")
def p14(spark, sf):
    ev = events(spark, sf).withColumn("k", F.col("k").cast("double"))
    return P.nudge(ev, ["k"], {"k": (5.0, 95.0)}).select("row_id", "delta", "k", "valid")


@query("p15_standardize_vectors", """
WITH l AS (SELECT vec_id AS row_id, label, i.pos AS dim, CAST(e.embedding[i.pos + 1] AS DOUBLE) AS x
  FROM embeddings e, (SELECT CAST(unnest(range(64)) AS INTEGER) AS pos) i),
s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM l WHERE label < 7 GROUP BY dim)
SELECT row_id, dim, round((x - m) / (s + 1e-8), 6) AS value FROM l JOIN s USING (dim)""")
def p15(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id")
    return rounded(P.standardize_vectors(e, e.where("label < 7")), "value")


@query("p16_score_to_label", with_cte(SALES) + f"""
, p AS (SELECT row_id, {sql_arm_score('a')} AS score FROM sales)
SELECT row_id, CASE WHEN score >= 0.5 THEN 'Yes' ELSE 'No' END AS label, round(CASE WHEN score >= 0.5 THEN score ELSE 1 - score END, 6) AS confidence FROM p""")
def p16(spark, sf):
    out = P.score_to_label(sales(spark, sf).withColumn("score", arm_score("a")), 0.5)
    return rounded(out.select("row_id", "label", "confidence"), "confidence")


@query("p17_drop_features", with_cte(SALES) + """
SELECT priority, segment, price, balance FROM sales""")
def p17(spark, sf):
    s = sales(spark, sf).drop("nation", "order_date")
    return P.drop_features(s, ["row_id", "order_year", "y"], "grp", use_group=False)
