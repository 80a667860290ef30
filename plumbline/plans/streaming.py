"""Streaming queries over the events table (survey section 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.session import scratch_path
from plumbline.operators import drift as R
from plumbline.operators import models as L
from plumbline.plans.bindings import EVENTS, events, rounded, table, with_cte
from plumbline.plans.contracts import RECORD_SQL
from plumbline.plans.drift import CATEGORICAL, EARLY_SQL, LABEL_SQL, NUMERIC, PROFILE_SQL, halves
from plumbline.plans.registry import query
from plumbline.sources import prediction_log as S
from plumbline.streaming import drift as TD
from plumbline.streaming import scoring as T


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = T.file_stream(spark, sf, schema, pattern="events.parquet")
    return raw.select(
        F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), "props",
        F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("ug"),
    )


@query("t1_stream_score", with_cte(EVENTS) + """
SELECT 'scored' AS sink, count(*) AS n FROM ev WHERE event_type IN ('click', 'view') AND k BETWEEN 5 AND 90
UNION ALL SELECT 'quarantine', count(*) FROM ev WHERE NOT (event_type IN ('click', 'view') AND k BETWEEN 5 AND 90)""")
def t1(spark, sf):
    train = events(spark, sf).select("row_id", "k", "event_type", (F.col("value") > 35).cast("int").alias("y"))
    model = L.fit_logistic(L.FeatureSet(("event_type",), ("k",)))(train, {"maxIter": 5})
    record = F.concat(F.lit('{"event_type": "'), F.col("event_type"), F.lit('", '), F.expr("substr(props, 2)"))
    stream = event_stream(spark, sf).withColumn("record", record)
    log, quarantine = scratch_path(spark, "scored"), scratch_path(spark, "quarantine")

    def to_events(scored):
        return S.prediction_events(scored, ["event_type", "k"], "v1", 0.5)

    T.stream_score(
        stream, "record", {"event_type": ["click", "view"]}, {"k": (5, 90)}, lambda df: L.score(model, df), to_events,
        log, quarantine, scratch_path(spark, "checkpoint"),
    ).awaitTermination()
    good = spark.read.schema("probability double, prediction string").json(log).agg(F.lit("scored").alias("sink"), F.count("probability").alias("n"))
    bad = spark.read.schema("record string, errors string").json(quarantine).agg(F.lit("quarantine").alias("sink"), F.count("errors").alias("n"))
    return good.unionByName(bad)


@query("t2_stream_log_sink", with_cte(EVENTS) + """
SELECT strftime(day, '%Y-%m-%d') AS event_day, count(*) AS n, count(*) FILTER (value / 1000.0 >= 0.05) AS n_yes FROM ev GROUP BY ALL""")
def t2(spark, sf):
    stream = S.prediction_events(event_stream(spark, sf).withColumn("score", F.col("value") / 1000.0), ["event_type", "k"], "v1", 0.05)
    path = scratch_path(spark, "stream-log")
    T.stream_log_sink(stream, path, scratch_path(spark, "checkpoint")).awaitTermination()
    log = spark.read.schema("prediction string, event_date date").json(path)
    return log.groupBy(F.date_format(S.DAY, "yyyy-MM-dd").alias("event_day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == "Yes").alias("n_yes"))


WEEKS = """wk AS (SELECT *, 'u' || (user_id % 4) AS ug, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week FROM ev),
ws AS (SELECT *, 'all' AS segment FROM wk UNION ALL SELECT *, ug AS segment FROM wk),
wn AS (SELECT week, segment, 'k' AS feature, CAST(k AS DOUBLE) AS v FROM ws UNION ALL SELECT week, segment, 'prediction_score', value FROM ws),
wt AS (SELECT week, segment, 'event_type' AS feature, event_type AS level FROM ws UNION ALL SELECT week, segment, 'ug', ug FROM ws WHERE segment = 'all'),
wc AS (SELECT n.week, n.segment, n.feature, CAST(len(list_filter(e.edges, lambda x: x < n.v)) AS INTEGER) AS bin, count(*) AS n FROM wn n JOIN edges e USING (segment, feature) GROUP BY ALL
  UNION ALL SELECT t.week, t.segment, t.feature, coalesce(g.bin, u.bin), count(*) FROM wt t JOIN tgrid u ON u.segment = t.segment AND u.feature = t.feature AND u.label = '(unseen)'
    LEFT JOIN tgrid g ON g.segment = t.segment AND g.feature = t.feature AND g.label = t.level GROUP BY ALL),
wg AS (SELECT s.week, p.* FROM (SELECT DISTINCT week, segment, feature FROM wc) s JOIN profile p USING (segment, feature)),
wb AS (SELECT g.week, g.segment, g.feature, g.bin, g.label, g.ref_share AS e0, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.week, g.segment, g.feature) AS a0 FROM wg g LEFT JOIN wc c USING (week, segment, feature, bin)),
wm AS (SELECT *, (greatest(a0, 1e-4) - greatest(e0, 1e-4)) * ln(greatest(a0, 1e-4) / greatest(e0, 1e-4)) AS term FROM wb),
wp AS (SELECT week, segment, feature, sum(term) AS psi FROM wm GROUP BY ALL)"""
WINDOW_DRIFT = """SELECT strftime(make_timestamp(week * 604800 * 1000000), '%Y-%m-%d') AS week_start, segment, feature, round(psi, 6) AS psi,
  CASE WHEN psi < 0.1 THEN 'stable' WHEN psi <= 0.25 THEN 'moderate' ELSE 'significant' END AS status FROM wp"""


def profile(spark, sf):
    early, _ = halves(spark, sf)
    return R.build_profile(early, CATEGORICAL, NUMERIC, "value", "ug")


def shown(drift):
    out = drift.select(F.date_format("window_start", "yyyy-MM-dd").alias("week_start"), "segment", "feature", "psi", "status")
    return rounded(out, "psi")


@query("t3_window_drift", with_cte(EVENTS, EARLY_SQL, PROFILE_SQL, WEEKS) + WINDOW_DRIFT)
def t3_batch(spark, sf):
    ref = profile(spark, sf)
    rows = events(spark, sf).withColumns({"ug": F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")), "ts": F.col("ts").cast("timestamp")})
    return shown(TD.window_drift(ref, TD.window_counts(ref, rows, "ts", "1 week", CATEGORICAL, NUMERIC, "value", "ug")))


@query("t3_stream_drift", with_cte(EVENTS, EARLY_SQL, PROFILE_SQL, WEEKS) + WINDOW_DRIFT + " WHERE (week + 1) * 604800 <= (SELECT floor(max(epoch(ts))) FROM ev) - 3600")
def t3_stream(spark, sf):
    from plumbline.functions.session import cut

    ref = cut(profile(spark, sf))
    path = scratch_path(spark, "window-counts")
    TD.stream_counts(
        ref, event_stream(spark, sf), "ts", "1 week", "1 hour", CATEGORICAL, NUMERIC, path, scratch_path(spark, "checkpoint"), "value", "ug"
    ).awaitTermination()
    counts = spark.read.schema("window_start timestamp, window_end timestamp, segment string, feature string, bin int, n bigint").parquet(path)
    return shown(TD.window_drift(ref, counts))


T4_SINCE = "2024-01-08"
T4_EVENT = "timestamp string, model_version string, probability double"


@query("t4_stream_counters", with_cte(EVENTS) + f"""
, o AS (SELECT CASE WHEN row_id % 97 = 0 THEN 'malformed' WHEN row_id % 31 = 0 THEN 'other_version' WHEN ts < TIMESTAMP '{T4_SINCE}' THEN 'late' ELSE 'written' END AS counter FROM ev)
SELECT c.counter, count(o.counter) AS n FROM (SELECT unnest(['written', 'late', 'malformed', 'other_version']) AS counter) c LEFT JOIN o USING (counter) GROUP BY ALL""")
def t4(spark, sf):
    """The log of the events, with every 97th line cut off and every 31st of another model version."""
    cells = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.when(F.col("row_id") % 31 == 0, "v0").otherwise("v1").alias("model_version"), (F.col("value") / 1000.0).alias("probability"))
    text = F.to_json(cells)
    lines = event_stream(spark, sf).select(F.when(F.col("row_id") % 97 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value"))
    path = scratch_path(spark, "counted-log")
    T.stream_counted_log(lines, T4_EVENT, "v1", T4_SINCE, path, scratch_path(spark, "checkpoint")).awaitTermination()
    return T.stream_counters(spark, path)
