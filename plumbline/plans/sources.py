"""Queries that write the given tables through a sink and read them back (survey section 2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.session import scratch_path
from plumbline.operators import contracts as C
from plumbline.operators import splits as D
from plumbline.plans.bindings import (
    DOCS, EVENTS, SALES, arm_score, attribution, docs, events, rounded, sales, sql_arm_score, sql_attribution, sql_key,
    table, with_cte,
)
from plumbline.plans.registry import query
from plumbline.sources import artifacts as S
from plumbline.sources import prediction_log as L
from plumbline.sources import survey as V


def survey_csv(spark, sf):
    path = scratch_path(spark, "survey")
    part = sales(spark, sf).select("row_id", "grp", "order_year", "priority", "segment", "y")
    part.write.option("header", True).csv(path)
    return path


SURVEY = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("grp", T.StringType()), T.StructField("order_year", T.LongType()),
    T.StructField("priority", T.StringType()), T.StructField("segment", T.StringType()), T.StructField("y", T.LongType()),
])


@query("s1_read_survey", with_cte(SALES) + "SELECT grp, priority, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, CAST(max(order_year) AS BIGINT) AS last_year FROM sales GROUP BY ALL")
def s1(spark, sf):
    df = V.read_survey(spark, survey_csv(spark, sf), SURVEY, ["row_id", "grp"], target="y")
    return df.groupBy("grp", "priority").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.max("order_year").alias("last_year"))


@query("s2_read_raw_records", with_cte(SALES) + "SELECT segment, CAST(order_year AS BIGINT) AS order_year, count(*) AS n FROM sales GROUP BY ALL")
def s2(spark, sf):
    df = V.read_raw_records(spark, survey_csv(spark, sf), ["segment"], ["order_year"])
    return df.groupBy("segment", "order_year").agg(F.count(F.lit(1)).alias("n"))


FEATURES = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("k", T.LongType())])


def log_path(spark, sf):
    """The events as a daily prediction log: score = value / 1000, version by user."""
    path = scratch_path(spark, "log")
    ev = events(spark, sf).withColumn("score", F.col("value") / 1000.0)
    for version, part in (("v1", ev.where("user_id % 5 <> 0")), ("v0", ev.where("user_id % 5 = 0"))):
        L.append_predictions(L.prediction_events(part, ["event_type", "k"], version, 0.05), path)
    return path


@query("s3_read_prediction_log", with_cte(EVENTS) + """
SELECT event_type, CASE WHEN user_id % 5 = 0 THEN 'v0' ELSE 'v1' END AS model_version, count(*) AS n, round(sum(value / 1000.0), 6) AS total_score,
  count(*) FILTER (value / 1000.0 >= 0.05) AS n_yes, CAST(0 AS BIGINT) AS n_malformed FROM ev GROUP BY ALL""")
def s3(spark, sf):
    parsed = L.parse_log(L.log_lines(spark, log_path(spark, sf), pattern="*.json"), FEATURES)
    out = parsed.groupBy(F.col("features.event_type").alias("event_type"), "model_version").agg(
        F.count(F.lit(1)).alias("n"), F.sum("probability").alias("total_score"),
        F.count_if(F.col("prediction") == "Yes").alias("n_yes"), F.count_if("malformed").alias("n_malformed"),
    )
    return rounded(out, "total_score")


@query("s4_prune_log_days", with_cte(EVENTS) + """
SELECT strftime(day, '%Y-%m-%d') AS event_day, count(*) AS n FROM ev WHERE day >= DATE '2024-01-25' GROUP BY ALL""")
def s4(spark, sf):
    lines = L.log_lines(spark, log_path(spark, sf), since="2024-01-25 06:00:00")
    return lines.groupBy(F.date_format(L.DAY, "yyyy-MM-dd").alias("event_day")).agg(F.count(F.lit(1)).alias("n"))


def broken_lines(spark, sf):
    """Log lines of the events in which every 150th line is cut short and every 400th is blank."""
    ev = events(spark, sf).withColumn("score", F.col("value") / 1000.0)
    version = F.when(F.col("user_id") % 5 == 0, "v0").otherwise("v1")
    full = F.to_json(F.struct(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), version.alias("model_version"),
        F.struct("event_type", "k").alias("features"), F.col("score").alias("probability"),
    ))
    value = F.when(F.col("row_id") % 400 == 7, F.lit("  ")).when(F.col("row_id") % 150 == 3, F.substring(full, 1, 40)).otherwise(full)
    return ev.select(value.alias("value"))


@query("r8_scan_statistics", with_cte(EVENTS) + """
, x AS (SELECT *, row_id % 150 = 3 AS bad, date_trunc('millisecond', ts) >= TIMESTAMP '2024-01-20' AS win, user_id % 5 <> 0 AS v1 FROM ev WHERE row_id % 400 <> 7)
SELECT count(*) AS lines_read, count(*) FILTER (bad) AS malformed, count(*) FILTER (NOT bad AND win AND NOT v1) AS other_model_versions,
  count(*) FILTER (NOT bad AND win AND v1 AND event_type = 'view') AS n_events FROM x""")
def r8_statistics(spark, sf):
    return L.scan_statistics(L.parse_log(broken_lines(spark, sf), FEATURES), "2024-01-20", "v1", ("event_type", "view"))


@query("r8_scan_log", with_cte(EVENTS) + """
SELECT k, count(*) AS n, round(sum(value / 1000.0), 6) AS total_score FROM ev
WHERE row_id % 400 <> 7 AND row_id % 150 <> 3 AND date_trunc('millisecond', ts) >= TIMESTAMP '2024-01-20' AND user_id % 5 <> 0 AND event_type = 'view' GROUP BY k""")
def r8(spark, sf):
    found = L.scan_log(L.parse_log(broken_lines(spark, sf), FEATURES), "2024-01-20", "v1", ("event_type", "view"))
    return rounded(found.groupBy(F.col("features.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("probability").alias("total_score")), "total_score")


def score_files(spark, sf):
    """Out-of-fold files of two complete arms and of one that lacks a fold."""
    path = scratch_path(spark, "oof")
    folded = D.stratified_folds(sales(spark, sf), ["grp", "y"], 5, "fold")
    arms = folded.withColumn("arm", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("partial"))))
    rows = arms.where("NOT (arm = 'partial' AND fold = 3)").select(
        F.lit("nested").alias("design"), "arm", F.lit(0).alias("seed"), "fold", "row_id", "grp", "y",
        F.when(F.col("arm") == "a", arm_score("a")).otherwise(arm_score("b")).alias("score"),
    )
    S.write_oof(rows, path)
    return path


@query("s5_read_oof", with_cte(SALES) + f"""
SELECT arm, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(sum(score), 6) AS total_score FROM (
  SELECT 'a' AS arm, y, {sql_arm_score('a')} AS score FROM sales UNION ALL SELECT 'b', y, {sql_arm_score('b')} FROM sales) GROUP BY arm
UNION ALL SELECT 'partial', NULL, NULL, NULL""")
def s5(spark, sf):
    ids = sales(spark, sf).select("row_id")
    scores, excluded = S.read_oof(spark, score_files(spark, sf), "nested", ["a", "b", "partial"], 1, 5, ids)
    checked = S.check_coverage(scores, ids)
    summary = checked.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.sum("score").alias("total_score"))
    return rounded(summary, "total_score").unionByName(excluded.select("arm"), allowMissingColumns=True)


@query("s6_write_oof_resume", """
SELECT 'nested' AS design, arm, 0 AS seed, CAST(fold AS INTEGER) AS fold FROM (SELECT unnest(range(5)) AS fold), (SELECT unnest(['new', 'partial']) AS arm) WHERE arm = 'new' OR fold = 3""")
def s6(spark, sf):
    path = score_files(spark, sf)
    folds = D.stratified_folds(sales(spark, sf), ["grp", "y"], 5, "fold").select("fold").distinct()
    plan = folds.withColumn("arm", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("partial"), F.lit("new"))))
    return S.pending(plan.select(F.lit("nested").alias("design"), "arm", F.lit(0).alias("seed"), "fold"), S.manifest(spark, path))


@query("s7_write_checkpoints", with_cte(SALES) + """
SELECT 'train' AS part, count(*) AS n FROM sales WHERE order_year < 1998 UNION ALL SELECT 'test', count(*) FROM sales WHERE order_year >= 1998
UNION ALL SELECT 'vocabulary', count(DISTINCT priority) + count(DISTINCT segment) FROM sales WHERE order_year < 1998""")
def s7(spark, sf):
    s = sales(spark, sf)
    path = V.write_checkpoints(s.where("order_year < 1998"), s.where("order_year >= 1998"), ["priority", "segment"], scratch_path(spark, "parts"))
    parts = [spark.read.parquet(f"{path}/{p}").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n")) for p in ("train", "test", "vocabulary")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s8_attributions", with_cte(sql_attribution("a", 1, 32, "a"), sql_attribution("b", 33, 64, "b")) + """
SELECT set_id, feature, 'hash' AS method, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def s8(spark, sf):
    values = attribution(spark, sf, 1, 32, "a").unionByName(attribution(spark, sf, 33, 64, "b"))
    header = values.select("set_id").distinct().select("set_id", F.lit("hash").alias("method"), F.lit("logit").alias("space"), F.lit(0.0).alias("base_value"))
    loaded, head = S.load_attributions(spark, S.save_attributions(values, header, scratch_path(spark, "attributions")))
    joined = loaded.join(head.select("set_id", "method"), "set_id")
    return rounded(joined.groupBy("set_id", "feature", "method").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total")


@query("s9_sample_sets", with_cte(DOCS) + f"""
SELECT 'focus' AS set_name, row_id FROM docs WHERE grp = 'fr'
UNION ALL SELECT 'sample', row_id FROM (SELECT row_id FROM docs ORDER BY {sql_key('pick', 'row_id')}, row_id LIMIT 60)""")
def s9(spark, sf):
    d = docs(spark, sf)
    sets = d.where("grp = 'fr'").select(F.lit("focus").alias("set_name"), "row_id").unionByName(
        D.sample_n(d, 60, "pick").select(F.lit("sample").alias("set_name"), "row_id")
    )
    mark = C.fingerprint(d, ["row_id", "grp", "y"])
    path = S.save_sample_sets(sets, mark, scratch_path(spark, "sets"))
    return S.load_sample_sets(spark, path, mark).select("set_name", "row_id")


@query("s10_append_predictions", with_cte(EVENTS) + """
SELECT strftime(day, '%Y-%m-%d') AS event_day, count(*) AS n, count(*) FILTER (value / 1000.0 >= 0.05) AS n_yes FROM ev GROUP BY ALL""")
def s10(spark, sf):
    log = spark.read.schema("prediction string, event_date date").json(log_path(spark, sf))
    return log.groupBy(F.date_format(L.DAY, "yyyy-MM-dd").alias("event_day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == "Yes").alias("n_yes")
    )


@query("s11_write_report", with_cte(SALES) + "SELECT grp, segment, count(*) AS n FROM sales GROUP BY ALL")
def s11(spark, sf):
    result = sales(spark, sf).groupBy("grp", "segment").agg(F.count(F.lit(1)).alias("n"))
    V.write_report(result, scratch_path(spark, "report-csv"), "csv")
    path = V.write_report(result, scratch_path(spark, "report-json"), "json")
    return spark.read.schema("grp string, segment string, n bigint").json(path)


@query("s12_training_metadata", """
WITH m AS (SELECT count(*) AS n_rows, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT p_type AS x FROM part)) AS levels_p_type,
  CAST(min(p_size) AS BIGINT) AS min_p_size, CAST(max(p_size) AS BIGINT) AS max_p_size FROM part)
SELECT *, substr(sha256(n_rows || ';' || levels_p_type || ';' || min_p_size || ';' || max_p_size), 1, 12) AS version FROM m""")
def s12(spark, sf):
    return V.training_metadata(table(spark, sf, "part"), ["p_type"], ["p_size"])
