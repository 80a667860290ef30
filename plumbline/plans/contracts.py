"""Queries over data contracts (survey section 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import contracts as C
from plumbline.operators import metrics as M
from plumbline.operators import splits as D
from plumbline.plans.bindings import (
    DOCS, EVENTS, SALES, arm_score, attribution, docs, events, rounded, sales, sql_arm_score, sql_attribution,
    sql_int, sql_key, table, with_cte,
)
from plumbline.plans.registry import query


@query("v1_check_schema", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def v1(spark, sf):
    expected = {"o_orderkey": T.LongType(), "o_orderstatus": T.StringType(), "o_totalprice": T.DoubleType()}
    return C.check_schema(table(spark, sf, "orders"), expected).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("v2_duplicate_keys", """
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2)""")
def v2(spark, sf):
    return C.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("v3_key_report", """
SELECT 'order' AS candidate, count(*) AS n_rows, count(*) - count(DISTINCT l_orderkey) AS duplicate_rows FROM lineitem
UNION ALL
SELECT 'order+line', count(*), count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL
SELECT 'order+line+part', count(*), count(*) - count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) FROM lineitem""")
def v3(spark, sf):
    candidates = {
        "order": ["l_orderkey"],
        "order+line": ["l_orderkey", "l_linenumber"],
        "order+line+part": ["l_orderkey", "l_linenumber", "l_partkey"],
    }
    return C.key_report(table(spark, sf, "lineitem"), candidates)


PARTIES = """sup AS (SELECT CAST(s_nationkey AS VARCHAR) AS nation, CAST(CAST(floor(s_acctbal / 100) AS BIGINT) AS VARCHAR) AS band FROM supplier),
cus AS (SELECT CAST(c_nationkey AS VARCHAR) AS nation, CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS VARCHAR) AS band FROM customer),
sup_l AS (SELECT DISTINCT 'nation' AS "column", nation AS level FROM sup UNION SELECT DISTINCT 'band', band FROM sup),
cus_l AS (SELECT DISTINCT 'nation' AS "column", nation AS level FROM cus UNION SELECT DISTINCT 'band', band FROM cus)"""


def parties(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    sup = s.select(F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).alias("band"))
    cus = c.select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).alias("band"))
    return sup, cus


@query("v4_unseen_levels", with_cte(PARTIES) + """
SELECT "column", level FROM cus_l EXCEPT SELECT "column", level FROM sup_l""")
def v4(spark, sf):
    sup, cus = parties(spark, sf)
    return C.unseen_levels(sup, cus, ["nation", "band"])


@query("v5_cardinality", """
SELECT 'event_type' AS "column", count(DISTINCT event_type) AS n_levels FROM events UNION ALL
SELECT 'user_id', count(DISTINCT user_id) FROM events UNION ALL
SELECT 'props', count(DISTINCT props) FROM events""")
def v5(spark, sf):
    return C.cardinality(table(spark, sf, "events"), ["event_type", "user_id", "props"])


@query("v6_null_counts", """
WITH j AS (SELECT d.lang AS grp, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
u AS (SELECT grp, 'source' AS "column", source IS NULL AS missing FROM j UNION ALL
      SELECT grp, 'quality', quality IS NULL FROM j UNION ALL SELECT grp, 'toxic', toxic IS NULL FROM j)
SELECT "column", grp, CAST(sum(missing::INT) AS BIGINT) AS n_null FROM u GROUP BY ALL
UNION ALL SELECT "column", 'ALL', CAST(sum(missing::INT) AS BIGINT) FROM u GROUP BY ALL""")
def v6(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    joined = d.join(l, "doc_id", "left").withColumnRenamed("lang", "grp")
    return C.null_counts(joined, ["source", "quality", "toxic"], "grp")


RECORD_SQL = """CASE event_type
  WHEN 'error' THEN '{"event_type": "View", ' || substr(props, 2)
  WHEN 'signup' THEN '{"event_type": "signup", "k": "' || CAST(json_extract(props, '$.k') AS VARCHAR) || '"}'
  WHEN 'purchase' THEN '{"event_type": "purchase", "extra": 1, ' || substr(props, 2)
  ELSE '{"event_type": "' || event_type || '", ' || substr(props, 2) END"""


@query("v7_validate_records", f"""
WITH r AS (SELECT event_id, {RECORD_SQL} AS record FROM events),
f AS (SELECT event_id, json_type(record, '$.k') AS kt, json_extract_string(record, '$.event_type') AS et,
        CASE WHEN json_type(record, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(record, '$.k') AS BIGINT) END AS k,
        json_exists(record, '$.extra') AS extra FROM r),
e AS (SELECT event_id, concat_ws('; ',
        CASE WHEN et NOT IN ('click', 'purchase', 'signup', 'view') THEN 'event_type: not an allowed value' END,
        CASE WHEN kt NOT IN ('UBIGINT', 'BIGINT') THEN 'k: not an integer'
             WHEN k NOT BETWEEN 5 AND 90 THEN 'k: outside 5..90' END,
        CASE WHEN extra THEN 'extra: unknown field' END) AS errors FROM f)
SELECT event_id, errors, errors = '' AS is_valid FROM e""")
def v7(spark, sf):
    e = table(spark, sf, "events")
    tail = F.expr("substr(props, 2)")
    record = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"event_type": "View", '), tail))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"event_type": "signup", "k": "'), F.get_json_object("props", "$.k"), F.lit('"}')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"event_type": "purchase", "extra": 1, '), tail))
        .otherwise(F.concat(F.lit('{"event_type": "'), F.col("event_type"), F.lit('", '), tail))
    )
    checked = C.validate_records(
        e.withColumn("record", record), "record",
        enums={"event_type": ["click", "purchase", "signup", "view"]}, ranges={"k": (5, 90)},
    )
    return checked.select("event_id", F.array_join("errors", "; ").alias("errors"), "is_valid")


@query("v8_vocabulary_diff", with_cte(PARTIES) + """
SELECT coalesce(s."column", c."column") AS "column", coalesce(s.level, c.level) AS level,
       CASE WHEN c.level IS NULL THEN 'schema_only' ELSE 'data_only' END AS side
FROM sup_l s FULL OUTER JOIN cus_l c ON s."column" = c."column" AND s.level = c.level
WHERE s.level IS NULL OR c.level IS NULL""")
def v8(spark, sf):
    sup, cus = parties(spark, sf)
    return C.vocabulary_diff(C.levels(sup, ["nation", "band"]), C.levels(cus, ["nation", "band"]))


MARKED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]


@query("v9_fingerprint", f"""
WITH h AS (SELECT md5({" || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}, 'N')" for c in MARKED)}) AS k FROM lineitem)
SELECT count(*) AS n_rows, concat_ws('-', sum(CAST('0x' || substr(k, 1, 15) AS HUGEINT))::VARCHAR, sum(CAST('0x' || substr(k, 17, 15) AS HUGEINT))::VARCHAR) AS content_hash
FROM h""")
def v9(spark, sf):
    return C.fingerprint(table(spark, sf, "lineitem"), MARKED)


@query("v10_ood_warnings", """
WITH m AS (SELECT max(p_size) AS ms, max(p_partkey) AS mk FROM part WHERE p_type = 'SMALL' AND p_size < 45)
SELECT p_partkey, concat_ws('; ',
  CASE WHEN p_size > ms THEN 'p_size=' || p_size || ' exceeds the training maximum of ' || ms || '; prediction is an extrapolation' END,
  CASE WHEN p_partkey > mk THEN 'p_partkey=' || p_partkey || ' exceeds the training maximum of ' || mk || '; prediction is an extrapolation' END) AS warnings
FROM part, m""")
def v10(spark, sf):
    part = table(spark, sf, "part")
    train = part.where("p_type = 'SMALL' AND p_size < 45")
    return C.ood_warnings(part, train, ["p_size", "p_partkey"]).select("p_partkey", F.array_join("warnings", "; ").alias("warnings"))


@query("v11_alignment", with_cte(sql_attribution("a", 1, 32, "a"), sql_attribution("b", 33, 64, "b")) + """
SELECT count(*) FILTER (a.row_id IS NOT NULL AND b.row_id IS NOT NULL) AS aligned,
       count(*) FILTER (b.row_id IS NULL) AS only_a, count(*) FILTER (a.row_id IS NULL) AS only_b
FROM (SELECT * FROM a WHERE grp <> 0) a FULL OUTER JOIN (SELECT * FROM b WHERE grp <> 1 OR feature <> 'f03') b
  ON a.row_id = b.row_id AND a.feature = b.feature""")
def v11(spark, sf):
    a = attribution(spark, sf, 1, 32, "a").where("grp <> 0")
    b = attribution(spark, sf, 33, 64, "b").where("grp <> 1 OR feature <> 'f03'")
    return C.alignment_report(a, b)


@query("v12_score_parity", with_cte(SALES) + f"""
, p AS (SELECT {sql_arm_score('a')} AS s, {sql_arm_score('b')} AS t FROM sales)
SELECT count(*) AS n, round(max(abs(s - t)), 6) AS max_abs_diff, round(avg(abs(s - t)), 6) AS mean_abs_diff,
  count(*) FILTER (abs(s - t) > 0.0505) AS n_beyond_atol,
  count(*) FILTER ((s >= 0.5005) <> (t >= 0.5005)) AS n_flips,
  count(*) FILTER ((s >= 0.5005) <> (t >= 0.5005) AND NOT (abs(s - 0.5005) <= 0.0505 OR abs(t - 0.5005) <= 0.0505)) AS n_flips_outside_band
FROM p""")
def v12(spark, sf):
    s = sales(spark, sf)
    out = C.score_parity(s.withColumn("score", arm_score("a")), s.withColumn("score", arm_score("b")), 0.0505, 0.5005)
    return rounded(out, "max_abs_diff", "mean_abs_diff")


FOLD_AP = f"""folded AS (
  SELECT row_id, y, grp, (row_number() OVER (PARTITION BY grp || '_' || y ORDER BY {sql_key('fold', 'row_id')}, row_id) - 1) % 5 AS fold FROM sales),
scored AS (SELECT 'a' AS arm, fold, y, {sql_arm_score('a')} AS score FROM folded UNION ALL
           SELECT 'b' AS arm, fold, y, {sql_arm_score('b')} AS score FROM folded),
cells AS (SELECT arm, fold, score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL),
cums AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY arm, fold) AS p
         FROM cells WINDOW w AS (PARTITION BY arm, fold ORDER BY score DESC)),
fold_ap AS (SELECT arm, fold, sum(pos * (tp / (tp + fp)) / p) AS ap FROM cums GROUP BY ALL)"""


def fold_ap(spark, sf):
    """Average precision per arm and fold on the sales binding."""
    folded = D.stratified_folds(sales(spark, sf), ["grp", "y"], 5, "fold")
    both = folded.withColumn("arm", F.explode(F.array(F.lit("a"), F.lit("b"))))
    scored = both.withColumn("score", F.when(F.col("arm") == "a", arm_score("a")).otherwise(arm_score("b")))
    return M.average_precision(scored, by=["arm", "fold"])


@query("v13_reproduction_gate", with_cte(SALES, FOLD_AP) + """
SELECT 'model' AS arm, 'ap' AS metric, count(*) AS folds, round(avg(n.ap) - avg(o.ap), 6) AS mean_difference,
       round(max(abs(n.ap - o.ap)), 6) AS max_fold_difference, abs(avg(n.ap) - avg(o.ap)) <= 0.01 AS within
FROM (SELECT * FROM fold_ap WHERE arm = 'a') n JOIN (SELECT * FROM fold_ap WHERE arm = 'b') o ON n.fold = o.fold""")
def v13(spark, sf):
    per_fold = fold_ap(spark, sf).select("arm", "fold", F.lit("ap").alias("metric"), F.col("ap").alias("value"))
    new = per_fold.where("arm = 'a'").withColumn("arm", F.lit("model"))
    old = per_fold.where("arm = 'b'").withColumn("arm", F.lit("model"))
    return rounded(C.reproduction_gate(new, old, 0.01), "mean_difference", "max_fold_difference")


@query("v14_completion_report", with_cte(EVENTS) + """
, manifest AS (SELECT event_type AS arm, user_id % 5 AS seed, k % 5 AS fold, sum(k) AS seconds,
    CASE WHEN min(user_id) % 2 = 0 THEN 'cpu' ELSE 'gpu' END AS device FROM ev WHERE k % 25 <> user_id % 25 GROUP BY ALL HAVING max(k) < 100 AND min(row_id) % 4 <> 0),
grid AS (SELECT arm, seed, fold FROM (SELECT DISTINCT event_type AS arm FROM ev), (SELECT unnest(range(5)) AS seed), (SELECT unnest(range(5)) AS fold))
SELECT g.arm, count(*) AS expected, count(m.arm) AS finished, count(*) - count(m.arm) AS missing,
  round(coalesce(sum(m.seconds), 0) / 3600.0, 6) AS hours, coalesce(string_agg(DISTINCT m.device, ',' ORDER BY m.device), '') AS devices
FROM grid g LEFT JOIN manifest m ON g.arm = m.arm AND g.seed = m.seed AND g.fold = m.fold GROUP BY g.arm""")
def v14(spark, sf):
    ev = events(spark, sf)
    runs = ev.where("k % 25 <> user_id % 25").groupBy(
        F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("seed"), (F.col("k") % 5).alias("fold")
    )
    manifest = runs.agg(
        F.sum("k").alias("seconds"),
        F.when(F.min("user_id") % 2 == 0, "cpu").otherwise("gpu").alias("device"),
        F.min("row_id").alias("first_row"), F.max("k").alias("max_k"),
    ).where("max_k < 100 AND first_row % 4 <> 0")
    arms = ev.select(F.col("event_type").alias("arm")).distinct()
    seq = F.expr("sequence(0L, 4L)")
    grid = arms.withColumn("seed", F.explode(seq)).withColumn("fold", F.explode(seq))
    return rounded(C.completion_report(grid, manifest, ["arm", "seed", "fold"]), "hours")


@query("v15_attribution_report", with_cte(sql_attribution("a", 1, 32, "a"), sql_attribution("b", 33, 64, "b")) + """
, x AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM b WHERE grp = 3),
c AS (SELECT set_id, row_id, feature, count(*) AS c, count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) AS bad FROM x GROUP BY ALL)
SELECT set_id, CAST(sum(c) AS BIGINT) AS n_values, CAST(sum(bad) AS BIGINT) AS n_not_finite, CAST(sum(c - 1) AS BIGINT) AS n_repeated,
  count(DISTINCT feature) AS n_features, CAST(1 AS BIGINT) AS n_headers FROM c GROUP BY set_id""")
def v15(spark, sf):
    a, b = attribution(spark, sf, 1, 32, "a"), attribution(spark, sf, 33, 64, "b")
    body = a.unionByName(b).unionByName(b.where("grp = 3"))
    return C.attribution_report(body, body.select("set_id").distinct())


@query("v16_finite_score_gate", with_cte(SALES) + f"SELECT grp, count(*) AS n, round(max({sql_arm_score('a')}), 6) AS max_score FROM sales GROUP BY grp")
def v16(spark, sf):
    scored = C.finite_score_gate(sales(spark, sf).withColumn("score", arm_score("a")))
    return rounded(scored.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score")), "max_score")
