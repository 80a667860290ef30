"""Scans, sinks, logs and streams: round trips, pruning, resume and loud failures."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import contracts as C
from plumbline.operators import drift as R
from plumbline.sources import artifacts as S
from plumbline.sources import prediction_log as L
from plumbline.sources import survey as V
from plumbline.streaming import drift as TD
from plumbline.streaming import scoring as TS


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-")


ROW = ["Kenya", "2018", "uniqueid_1", "Yes", "Rural", "Yes", "3", "24", "Female", "Spouse", "Widowed", "Primary education", "Self employed"]
HEADER = [*V.SURVEY_COLUMNS[:3], V.SURVEY_TARGET, *V.SURVEY_COLUMNS[3:]]


def write_csv(folder, header, rows):
    path = Path(folder) / "survey.csv"
    path.write_text("\n".join(",".join(r) for r in [header, *rows]) + "\n", encoding="utf-8")
    return str(path)


def read(spark, path):
    return V.read_survey(spark, path, V.survey_schema(True), V.SURVEY_KEY, V.SURVEY_TARGET)


def test_survey_scan(spark, folder):
    second = [*ROW]
    second[0] = "Uganda"  # the same uniqueid in another country is no duplicate
    df = read(spark, write_csv(folder, HEADER, [ROW, second]))
    assert df.count() == 2 and df.schema["household_size"].dataType == T.LongType()


def test_survey_scan_failures(spark, folder):
    with pytest.raises(C.ContractError, match="repeat"):
        read(spark, write_csv(folder, HEADER, [ROW, ROW]))
    with pytest.raises(C.ContractError, match="missing columns"):
        read(spark, write_csv(folder, HEADER[:-1], [ROW[:-1]]))
    bad = [*ROW]
    bad[6] = "three"
    with pytest.raises(Exception):
        read(spark, write_csv(folder, HEADER, [bad])).collect()
    with pytest.raises(Exception, match="household_size is not an integer"):
        V.read_raw_records(spark, write_csv(folder, HEADER, [bad]), ["country"], ["household_size"]).collect()


FEATURES = T.StructType([T.StructField("age", T.LongType()), T.StructField("country", T.StringType())])


def log_rows(n, version="v1", country="Kenya", ts="2026-01-10T10:00:00+00:00"):
    return [json.dumps({"timestamp": ts, "model_version": version, "features": {"age": 30, "country": country}, "probability": 0.4, "prediction": "No"}) for _ in range(n)]


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_scan_order_and_malformed_limit(spark):
    rows = log_rows(200) + log_rows(5, version="v0") + log_rows(3, ts="2025-01-01T00:00:00+00:00") + log_rows(4, country="Rwanda") + ["", "   ", "{broken"]
    rows.append(json.dumps({"timestamp": "2026-01-10T10:00:00+00:00", "features": {"age": 1}, "probability": "x"}))
    parsed = L.parse_log(lines(spark, rows), FEATURES)
    stats = L.scan_statistics(parsed, "2026-01-01", "v1", ("country", "Kenya")).first()
    assert stats.asDict() == {"lines_read": 214, "malformed": 2, "other_model_versions": 5, "n_events": 200}
    assert L.scan_log(parsed, "2026-01-01", "v1", ("country", "Kenya")).count() == 200
    corrupt = L.parse_log(lines(spark, log_rows(200) + ["{"] * 10), FEATURES)
    with pytest.raises(Exception, match="10/210 log lines are malformed"):
        L.scan_log(corrupt).collect()


def test_log_days_before_the_window_are_not_read(spark, folder):
    scored = spark.createDataFrame([(i, f"2026-01-{1 + i:02d} 12:00:00", 0.3) for i in range(9)], "row_id long, ts string, score double").withColumn("ts", F.col("ts").cast("timestamp"))
    L.append_predictions(L.prediction_events(scored, ["row_id"], "v1", 0.5), folder)
    found = L.log_lines(spark, folder, since="2026-01-07 06:00:00")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert found.count() == 3
    with pytest.raises(Exception, match="non-finite score"):
        L.append_predictions(L.prediction_events(scored.withColumn("score", F.lit(float("nan"))), ["row_id"], "v1", 0.5), folder)


def test_oof_resume_and_coverage(spark, folder):
    rows = spark.createDataFrame([("nested", "a", 0, i % 2, i, "g", i % 2, 0.5) for i in range(10)], "design string, arm string, seed int, fold int, row_id long, grp string, y int, score double")
    plan = rows.select(*S.UNIT).distinct()
    ids = rows.select("row_id")
    S.write_oof(rows.where("fold = 0"), folder)
    todo = S.pending(plan, S.manifest(spark, folder)).collect()
    assert [r["fold"] for r in todo] == [1]
    scores, excluded = S.read_oof(spark, folder, "nested", ["a"], 1, 2, ids)
    assert scores.count() == 0 and excluded.first()["arm"] == "a"
    S.write_oof(rows.where("fold = 1"), folder)
    scores, excluded = S.read_oof(spark, folder, "nested", ["a"], 1, 2, ids)
    assert S.check_coverage(scores, ids).count() == 10 and excluded.count() == 0
    with pytest.raises(C.ContractError, match="exactly once"):
        S.check_coverage(scores, ids.union(ids.select(F.col("row_id") + 100)))


def test_attributions_and_sample_sets_are_checked(spark, folder):
    values = spark.createDataFrame([("s", 1, "f", 0.5), ("s", 1, "f", 0.6)], "set_id string, row_id long, feature string, value double")
    header = spark.createDataFrame([("s", "shapley")], "set_id string, method string")
    with pytest.raises(C.ContractError, match="malformed"):
        S.save_attributions(values, header, f"{folder}/a")
    loaded, _ = S.load_attributions(spark, S.save_attributions(values.limit(1), header, f"{folder}/b"))
    assert loaded.count() == 1
    data = spark.createDataFrame([(1, "x"), (2, "y")], "row_id long, grp string")
    mark = C.fingerprint(data, ["row_id", "grp"])
    S.save_sample_sets(data.select(F.lit("focus").alias("set_name"), "row_id"), mark, f"{folder}/c")
    assert S.load_sample_sets(spark, f"{folder}/c", mark).count() == 2
    with pytest.raises(C.ContractError, match="other data"):
        S.load_sample_sets(spark, f"{folder}/c", C.fingerprint(data.limit(1), ["row_id", "grp"]))


def test_late_rows_are_counted(spark, folder):
    schema = "ts timestamp, k double, level string"

    def batch(times, name):
        df = spark.createDataFrame([(t, 1.0, "a") for t in times], "t string, k double, level string").select(F.col("t").cast("timestamp").alias("ts"), "k", "level")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")

    batch(["2026-01-01 00:00:00", "2026-01-20 00:00:00"], "one")
    base = spark.createDataFrame([(float(i), "a") for i in range(20)], "k double, level string")
    profile = R.build_profile(base, ["level"], ["k"]).cache()

    def run():
        stream = TS.file_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files_per_trigger=1)
        q = TD.stream_counts(profile, stream, "ts", "1 day", "1 hour", ["level"], ["k"], f"{folder}/out", f"{folder}/cp")
        q.awaitTermination()
        return q

    assert TS.dropped_rows(run().recentProgress) == 0
    batch(["2026-01-01 01:00:00", "2026-02-20 00:00:00"], "two")
    assert TS.dropped_rows(run().recentProgress) > 0
    counts = spark.read.parquet(f"{folder}/out")
    assert {str(r["window_start"])[:10] for r in counts.select("window_start").distinct().collect()} >= {"2026-01-01", "2026-01-20"}


def test_unknown_segments_of_a_stream_stay_across_restarts(spark, folder):
    rows = lambda g, day: spark.createDataFrame([(f"2026-01-{day:02d} 0{i % 9}:00:00", float(i % 5), g) for i in range(30)], "t string, k double, g string").select(F.col("t").cast("timestamp").alias("ts"), "k", "g")
    profile = R.build_profile(rows("a", 1).drop("ts"), ["g"], ["k"], group="g").cache()
    for part, day in ((rows("a", 2).unionByName(rows("new", 2)), 2), (rows("new", 3), 3), (rows("a", 9), 9)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = TS.file_stream(spark, f"{folder}/in", part.schema, files_per_trigger=1)
        TD.stream_counts(profile, stream, "ts", "1 day", "1 hour", ["g"], ["k"], f"{folder}/out", f"{folder}/cp", group="g").awaitTermination()
    counts = spark.read.parquet(f"{folder}/out")
    closed = [rows("a", 2), rows("new", 2), rows("new", 3)]
    twin = TD.window_counts(profile, closed[0].unionByName(closed[1]).unionByName(closed[2]), "ts", "1 day", ["g"], ["k"], group="g")
    assert sorted(map(tuple, counts.select(twin.columns).collect())) == sorted(map(tuple, twin.collect()))
    found = {(r.segment, r.feature, r.window_start.day): r.status for r in TD.window_drift(profile, counts).collect()}
    assert found["new", "k", 2] == found["new", "k", 3] == "no_reference" and found["a", "k", 2] == "stable" and ("new", "g", 2) not in found


def test_drift_check_refuses_and_counts(spark):

    from plumbline.operators import drift_check as K

    base = spark.createDataFrame([(i, ("x", "y")[i % 2], float(i % 11), (i % 10) / 10, "ab"[i % 2]) for i in range(600)], "row_id long, t string, v double, p double, g string")
    reference = K.build_reference(base, ["t", "g"], ["v"], "p", F.col("p") >= 0.5, "v1", "g")
    with pytest.raises(C.ContractError):
        K.build_reference(base.limit(10), ["t", "g"], ["v"], "p", F.col("p") >= 0.5, "v1", "g", expected=reference.data)
    event = F.to_json(F.struct(
        F.concat(F.lit("2024-02-01T00:"), F.lpad((F.col("row_id") % 60).cast("string"), 2, "0"), F.lit(":00Z")).alias("timestamp"), F.col("row_id").cast("string").alias("request_id"),
        F.when(F.col("row_id") % 6 == 0, "v0").otherwise("v1").alias("model_version"), F.struct("t", "g", "v").alias("features"), F.col("p").alias("probability"),
        F.when(F.col("p") >= 0.5, "Yes").otherwise("No").alias("prediction"),
    ))
    lines = base.select(event.alias("value"))
    features = T._parse_datatype_string("t string, g string, v double")
    report = K.drift_check(lines, features, reference, segment="a", min_samples=50)[0].first()
    assert (report["segment"], report["lines_read"], report["malformed"], report["other_model_versions"], report["n_recent"]) == ("a", 600, 0, 100, 200)
    assert K.drift_check(lines, features, reference, any_version=True)[0].first()["n_recent"] == 600
    assert K.drift_check(lines, features, reference, n=100)[0].first()["status"] == "insufficient_data"
    assert K.drift_check(lines, features, reference, since="2030-01-01")[0].first()["n_recent"] == 0
    with pytest.raises(C.ContractError):
        K.drift_check(lines, features, reference, segment="c")
    with pytest.raises(Exception, match="malformed"):
        K.drift_check(lines.unionByName(spark.createDataFrame([("{",)] * 50, "value string")), features, reference)[0].collect()
