"""Queries over drift monitoring (survey section 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import unpivot_text
from plumbline.functions.session import scratch_path
from plumbline.operators import drift as R
from plumbline.operators import drift_check as K
from plumbline.plans.bindings import EVENTS, events, rounded, with_cte
from plumbline.plans.registry import query
from plumbline.sources import prediction_log as S

# The early events are the reference; the late ones lose most low-k signups and gain an unseen level.
EARLY_SQL = """early AS (SELECT *, 'u' || (user_id % 4) AS ug FROM ev WHERE ts < TIMESTAMP '2024-01-20'),
late AS (SELECT row_id, ts, user_id, CASE WHEN event_type = 'error' AND k > 80 THEN 'crash' ELSE event_type END AS event_type, value, k, 'u' || (user_id % 4) AS ug
  FROM ev WHERE ts >= TIMESTAMP '2024-01-20' AND NOT (event_type = 'signup' AND k < 60))"""
CATEGORICAL, NUMERIC = ["event_type", "ug"], ["k"]


def halves(spark, sf):
    ev = events(spark, sf).withColumn("ug", F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")))
    early = ev.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    late = ev.where((F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")) & ~((F.col("event_type") == "signup") & (F.col("k") < 60)))
    renamed = F.when((F.col("event_type") == "error") & (F.col("k") > 80), "crash").otherwise(F.col("event_type"))
    return early, late.withColumn("event_type", renamed)


def long_sql(src: str, name: str) -> str:
    return f"""{name}_s AS (SELECT *, 'all' AS segment FROM {src} UNION ALL SELECT *, ug AS segment FROM {src}),
{name}_n AS (SELECT segment, 'k' AS feature, CAST(k AS DOUBLE) AS v FROM {name}_s UNION ALL SELECT segment, 'prediction_score', value FROM {name}_s),
{name}_t AS (SELECT segment, 'event_type' AS feature, event_type AS level FROM {name}_s UNION ALL SELECT segment, 'ug', ug FROM {name}_s WHERE segment = 'all')"""


DECILE_LIST = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
EDGE_TEXT = "CASE WHEN abs({x}) >= 1 THEN format('{{:g}}', {x}) ELSE printf('%.3f', {x}) END"
LABEL_SQL = f"""'(' || CASE WHEN lo IS NULL THEN '-inf' ELSE {EDGE_TEXT.format(x='lo')} END || ', ' || CASE WHEN hi IS NULL THEN 'inf' ELSE {EDGE_TEXT.format(x='hi')} END || ']'"""

PROFILE_SQL = long_sql("early", "e") + f""",
edges AS (SELECT segment, feature, list_sort(list_distinct(quantile_disc(v, {DECILE_LIST}))) AS edges FROM e_n GROUP BY ALL),
ngrid AS (SELECT segment, feature, edges, CAST(unnest(range(len(edges) + 1)) AS INTEGER) AS bin FROM edges),
nlab AS (SELECT segment, feature, bin, CASE WHEN bin > 0 THEN edges[bin] END AS lo, CASE WHEN bin < len(edges) THEN edges[bin + 1] END AS hi FROM ngrid),
ncnt AS (SELECT n.segment, n.feature, CAST(len(list_filter(e.edges, lambda x: x < n.v)) AS INTEGER) AS bin, count(*) AS n FROM e_n n JOIN edges e USING (segment, feature) GROUP BY ALL),
tlev AS (SELECT s.segment, s.feature, l.level, CAST(row_number() OVER (PARTITION BY s.segment, s.feature ORDER BY l.level) - 1 AS INTEGER) AS bin
  FROM (SELECT DISTINCT segment, feature FROM e_t) s JOIN (SELECT DISTINCT feature, level FROM e_t WHERE segment = 'all') l USING (feature)),
tgrid AS (SELECT segment, feature, bin, level AS label FROM tlev UNION ALL SELECT segment, feature, CAST(count(*) AS INTEGER), '(unseen)' FROM tlev GROUP BY ALL),
tcnt AS (SELECT segment, feature, level AS label, count(*) AS n FROM e_t GROUP BY ALL),
profile AS (
  SELECT g.segment, g.feature, 'numeric' AS kind, g.bin, g.lo, g.hi, {LABEL_SQL} AS label, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.segment, g.feature) AS ref_share
  FROM nlab g LEFT JOIN ncnt c USING (segment, feature, bin)
  UNION ALL
  SELECT g.segment, g.feature, 'categorical', g.bin, NULL, NULL, g.label, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.segment, g.feature)
  FROM tgrid g LEFT JOIN tcnt c USING (segment, feature, label))"""

DRIFT_SQL = long_sql("late", "l") + """,
rcnt AS (SELECT n.segment, n.feature, CAST(len(list_filter(e.edges, lambda x: x < n.v)) AS INTEGER) AS bin, count(*) AS n FROM l_n n JOIN edges e USING (segment, feature) GROUP BY ALL
  UNION ALL
  SELECT t.segment, t.feature, coalesce(g.bin, u.bin), count(*) FROM l_t t JOIN tgrid u ON u.segment = t.segment AND u.feature = t.feature AND u.label = '(unseen)'
    LEFT JOIN tgrid g ON g.segment = t.segment AND g.feature = t.feature AND g.label = t.level GROUP BY ALL),
both_ AS (SELECT p.segment, p.feature, p.bin, p.label, p.ref_share AS e0, coalesce(r.n, 0) / sum(coalesce(r.n, 0)) OVER (PARTITION BY p.segment, p.feature) AS a0
  FROM profile p LEFT JOIN (SELECT segment, feature, bin, sum(n) AS n FROM rcnt GROUP BY ALL) r USING (segment, feature, bin)),
terms AS (SELECT *, (greatest(a0, 1e-4) - greatest(e0, 1e-4)) * ln(greatest(a0, 1e-4) / greatest(e0, 1e-4)) AS term FROM both_),
top AS (SELECT *, row_number() OVER (PARTITION BY segment, feature ORDER BY round(term, 12) DESC, bin) AS r FROM terms),
psis AS (SELECT segment, feature, sum(term) AS psi FROM terms GROUP BY ALL),
drift AS (SELECT p.segment, p.feature, p.psi, CASE WHEN p.psi < 0.1 THEN 'stable' WHEN p.psi <= 0.25 THEN 'moderate' ELSE 'significant' END AS status,
  t.label AS largest_shift_bin, t.e0 AS reference_share, t.a0 AS recent_share FROM psis p JOIN top t USING (segment, feature) WHERE t.r = 1)"""


@query("r1_decile_edges", with_cte(EVENTS) + f"""
, q AS (SELECT event_type, unnest(list_distinct(quantile_disc(value, {DECILE_LIST}))) AS edge FROM ev GROUP BY event_type)
SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY edge) - 1 AS INTEGER) AS pos, edge FROM q""")
def r1(spark, sf):
    return R.decile_edges(events(spark, sf), "value", ["event_type"]).select("event_type", F.posexplode("edges").alias("pos", "edge"))


@query("r2_numeric_shares", with_cte(EVENTS, EARLY_SQL, PROFILE_SQL) + """
SELECT n.segment, n.feature, n.bin, n.lo, n.hi, round(coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY n.segment, n.feature), 6) AS share
FROM nlab n LEFT JOIN ncnt c USING (segment, feature, bin)""")
def r2(spark, sf):
    early, _ = halves(spark, sf)
    numbers, _ = R.long_features(early, CATEGORICAL, NUMERIC, "value", "ug")
    keys = ["segment", "feature"]
    shares = R.numeric_shares(numbers, R.decile_edges(numbers, "value", keys), keys)
    return rounded(shares.drop("label"), "share")


@query("r3_categorical_shares", with_cte(EVENTS, EARLY_SQL) + """
, lv AS (SELECT event_type AS level FROM early GROUP BY 1), c AS (SELECT CASE WHEN event_type IN (SELECT level FROM lv) THEN event_type ELSE '(unseen)' END AS label, count(*) AS n FROM late GROUP BY 1),
g AS (SELECT level AS label, CAST(row_number() OVER (ORDER BY level) - 1 AS INTEGER) AS bin FROM lv UNION ALL SELECT '(unseen)', CAST(count(*) AS INTEGER) FROM lv)
SELECT 'event_type' AS feature, g.bin, g.label, round(coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (), 6) AS share FROM g LEFT JOIN c USING (label)""")
def r3(spark, sf):
    early, late = halves(spark, sf)

    def long(part):
        return unpivot_text(part, [], ["event_type"]).withColumnRenamed("column", "feature")

    return rounded(R.categorical_shares(long(late), long(early).distinct(), ["feature"]), "share")


@query("r4_bin_labels", f"""
WITH s AS (SELECT o_orderpriority AS grp, max(o_totalprice) * 3 AS hi, min(o_totalprice) / 1e5 AS lo FROM orders GROUP BY 1
  UNION ALL SELECT o_orderstatus, avg(o_totalprice), NULL FROM orders GROUP BY 1 UNION ALL SELECT 'n' || n_nationkey, NULL, CAST(n_nationkey * n_nationkey AS DOUBLE) FROM nation)
SELECT grp, {LABEL_SQL} AS label FROM s""")
def r4(spark, sf):
    from plumbline.plans.bindings import table

    o, n = table(spark, sf, "orders"), table(spark, sf, "nation")
    a = o.groupBy(F.col("o_orderpriority").alias("grp")).agg((F.max("o_totalprice") * 3).alias("hi"), (F.min("o_totalprice") / 1e5).alias("lo"))
    b = o.groupBy(F.col("o_orderstatus").alias("grp")).agg(F.avg("o_totalprice").alias("hi"), F.lit(None).cast("double").alias("lo"))
    c = n.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("grp"), F.lit(None).cast("double").alias("hi"),
        (F.col("n_nationkey") * F.col("n_nationkey")).cast("double").alias("lo"),
    )
    return a.unionByName(b).unionByName(c).select("grp", R.bin_label(F.col("lo"), F.col("hi")).alias("label"))


WEEKS_SQL = """, g AS (SELECT DISTINCT event_type AS feature, CAST(k // 10 AS INTEGER) AS bin FROM ev),
a AS (SELECT event_type AS feature, CAST(k // 10 AS INTEGER) AS bin, count(*) AS n FROM ev WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL),
b AS (SELECT event_type AS feature, CAST(k // 10 AS INTEGER) AS bin, count(*) AS n FROM ev WHERE ts >= TIMESTAMP '2024-01-16' AND k % 10 < 10 - user_id % 7 GROUP BY ALL),
s AS (SELECT g.feature, g.bin, greatest(coalesce(a.n, 0) / sum(coalesce(a.n, 0)) OVER (PARTITION BY g.feature), 1e-4) AS e,
  greatest(coalesce(b.n, 0) / sum(coalesce(b.n, 0)) OVER (PARTITION BY g.feature), 1e-4) AS x FROM g LEFT JOIN a USING (feature, bin) LEFT JOIN b USING (feature, bin)),
p AS (SELECT feature, sum((x - e) * ln(x / e)) AS psi FROM s GROUP BY feature)
"""


@query("r5_psi", with_cte(EVENTS) + WEEKS_SQL + "SELECT feature, round(psi, 6) AS psi FROM p")
def r5(spark, sf):
    return rounded(weekly_psi(spark, sf), "psi")


def weekly_psi(spark, sf):
    ev = events(spark, sf).select(F.col("event_type").alias("feature"), F.floor(F.col("k") / 10).cast("int").alias("bin"), "ts", "k", "user_id")
    grid = ev.select("feature", "bin").distinct()
    turn = F.lit("2024-01-16").cast("timestamp_ntz")

    def shares(part):
        from pyspark.sql import Window

        counts = part.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
        filled = grid.join(counts, ["feature", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        return filled.select("feature", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias("share"))

    return R.psi(shares(ev.where(F.col("ts") < turn)), shares(ev.where((F.col("ts") >= turn) & (F.col("k") % 10 < 10 - F.col("user_id") % 7))), ["feature"])


@query("r6_psi_status", with_cte(EVENTS) + WEEKS_SQL + """
SELECT feature, m AS factor, CASE WHEN psi * m < 0.1 THEN 'stable' WHEN psi * m <= 0.25 THEN 'moderate' ELSE 'significant' END AS status FROM p, (SELECT unnest([1, 5, 20]) AS m)""")
def r6(spark, sf):
    scaled = weekly_psi(spark, sf).withColumn("factor", F.explode(F.array(F.lit(1), F.lit(5), F.lit(20))))
    return scaled.select("feature", "factor", R.psi_status(F.col("psi") * F.col("factor")).alias("status"))


@query("r7_build_profile", with_cte(EVENTS, EARLY_SQL, PROFILE_SQL) + "SELECT segment, feature, kind, bin, lo, hi, label, round(ref_share, 6) AS ref_share FROM profile")
def r7(spark, sf):
    early, _ = halves(spark, sf)
    return rounded(R.build_profile(early, CATEGORICAL, NUMERIC, "value", "ug"), "ref_share")


def drift(spark, sf):
    early, late = halves(spark, sf)
    profile = R.build_profile(early, CATEGORICAL, NUMERIC, "value", "ug")
    return R.feature_drift(profile, late, CATEGORICAL, NUMERIC, "value", "ug")


@query("r9_feature_drift", with_cte(EVENTS, EARLY_SQL, PROFILE_SQL, DRIFT_SQL) + """
SELECT segment, feature, round(psi, 6) AS psi, status, largest_shift_bin, round(reference_share, 6) AS reference_share, round(recent_share, 6) AS recent_share FROM drift""")
def r9(spark, sf):
    return rounded(drift(spark, sf), "psi", "reference_share", "recent_share")


@query("r10_drift_verdict", with_cte(EVENTS, EARLY_SQL, PROFILE_SQL, DRIFT_SQL) + """
, rr AS (SELECT segment, avg((value >= 50)::INT) AS r FROM e_s GROUP BY segment), rc AS (SELECT segment, count(*) AS n, avg((value >= 50)::INT) AS r FROM l_s GROUP BY segment),
w AS (SELECT segment, max(psi) AS max_psi, max(CASE status WHEN 'stable' THEN 0 WHEN 'moderate' THEN 10 ELSE 20 END) AS code FROM drift GROUP BY segment)
SELECT segment, n AS n_recent, round(rr.r, 6) AS reference_positive_rate, round(rc.r, 6) AS recent_positive_rate,
  CASE WHEN n >= 500 THEN round(max_psi, 6) END AS max_psi,
  CASE WHEN n < 500 THEN 'insufficient_data' WHEN code = 0 THEN 'stable' WHEN code = 10 THEN 'moderate' ELSE 'significant' END AS status,
  CASE WHEN n >= 500 THEN code ELSE 30 END AS code FROM rc JOIN rr USING (segment) JOIN w USING (segment)""")
def r10(spark, sf):
    early, late = halves(spark, sf)
    hit = F.col("value") >= 50
    verdict = R.drift_verdict(drift(spark, sf), R.segment_rates(early, hit, "ug"), R.segment_rates(late, hit, "ug"))
    return rounded(verdict, "reference_positive_rate", "recent_positive_rate", "max_psi")


SINCE = "2024-01-26"
RECENT_SQL = f""", late AS (SELECT * FROM late0 WHERE k % 10 <> 0 AND ts >= TIMESTAMP '{SINCE}')"""
LAST_SQL = ", late AS (SELECT * FROM late0 WHERE k % 10 <> 0 ORDER BY date_trunc('millisecond', ts) DESC, row_id::VARCHAR DESC LIMIT 800)"
CHECK_SQL = """
, rr AS (SELECT avg((value >= 50)::INT) AS r FROM early), rc AS (SELECT count(*) AS n, avg((value >= 50)::INT) AS r FROM late),
w AS (SELECT max(psi) AS max_psi, max(CASE status WHEN 'stable' THEN 0 WHEN 'moderate' THEN 10 ELSE 20 END) AS code FROM drift WHERE segment = 'all')
SELECT 'v1' AS model_version, 'all' AS segment, rc.n AS n_recent, round(rr.r, 6) AS reference_positive_rate, round(rc.r, 6) AS recent_positive_rate,
  CASE WHEN n >= 500 THEN round(max_psi, 6) END AS max_psi,
  CASE WHEN n < 500 THEN 'insufficient_data' WHEN code = 0 THEN 'stable' WHEN code = 10 THEN 'moderate' ELSE 'significant' END AS status,
  CASE WHEN n >= 500 THEN code ELSE 30 END AS code, (SELECT count(*) + 3 FROM late0) AS lines_read, CAST(3 AS BIGINT) AS malformed,
  (SELECT count(*) FROM late0 WHERE k % 10 = 0 {window}) AS other_model_versions FROM rc, rr, w"""
LOGGED = EARLY_SQL.replace("late AS (", "late0 AS (")


def logged_check(spark, sf, **window):
    """Late events as a prediction log, every tenth k of another model version, three lines cut off; checked against the early events."""
    early, late = halves(spark, sf)
    events_of = S.prediction_events(late.withColumn("score", F.col("value")), ["event_type", "ug", "k"], "v1", 50.0)
    events_of = events_of.withColumn("model_version", F.when(F.col("features.k") % 10 == 0, "v0").otherwise("v1"))
    path = scratch_path(spark, "drift-log")
    S.append_predictions(events_of, path)
    broken = spark.createDataFrame([('{"timestamp": "2024-01-2',)] * 3, "value string")
    lines = S.log_lines(spark, path).select("value").unionByName(broken)
    reference = K.build_reference(early, CATEGORICAL, NUMERIC, "value", F.col("value") >= 50, "v1", "ug")
    features = T._parse_datatype_string("event_type string, ug string, k bigint")
    report, _ = K.drift_check(lines, features, reference, **window)
    return rounded(report, "reference_positive_rate", "recent_positive_rate", "max_psi")


@query("r11_drift_check", with_cte(EVENTS, LOGGED + RECENT_SQL, PROFILE_SQL, DRIFT_SQL) + CHECK_SQL.format(window=f"AND ts >= TIMESTAMP '{SINCE}'"))
def r11(spark, sf):
    return logged_check(spark, sf, since=SINCE)


@query("r11_drift_check_last_n", with_cte(EVENTS, LOGGED + LAST_SQL, PROFILE_SQL, DRIFT_SQL) + CHECK_SQL.format(window=""))
def r11_last_n(spark, sf):
    return logged_check(spark, sf, n=800)


@query("w9_last_n", "SELECT event_id AS row_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 250")
def w9(spark, sf):
    return R.last_n(events(spark, sf), 250).select("row_id", "event_type", "value")


@query("w10_global_sort", with_cte(EVENTS) + "SELECT user_id, count(*) AS n FROM ev GROUP BY user_id")
def w10(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id")
