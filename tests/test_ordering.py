"""Two-level ranks, prefix sums and quantiles against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.hashing import hash_int, hash_unit
from plumbline.functions.ordering import bucketed_cells, exact_quantiles, first_n, hash_rank, running_totals
from plumbline.operators import splits as D
from plumbline.operators.drift import last_n


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with a third of the rows, heavy ties, a NULL group."""
    rng = np.random.default_rng(0)
    n = 3000
    grp = np.where(np.arange(n) % 3 == 0, "hot", rng.choice(["a", "b", "c"], n)).astype(object)
    grp[5] = None
    frame = pd.DataFrame({"row_id": np.arange(n), "grp": grp, "x": np.round(rng.gamma(0.5, 1.0, n), 2), "w": rng.integers(0, 4, n)})
    return frame, spark.createDataFrame(frame, "row_id long, grp string, x double, w long")


def test_hash_values_are_md5(spark):
    row = spark.range(1).select(hash_int("s", F.lit(7)).alias("h"), hash_unit("s", F.lit(7)).alias("u")).first()
    expected = int(hashlib.md5(b"s|7").hexdigest()[:15], 16)
    assert row["h"] == expected
    assert row["u"] == (expected % 1_000_000) / 1e6


def test_hash_rank_is_the_plain_rank(skewed):
    frame, df = skewed
    got = {r["row_id"]: (r["rank"], r["stratum_size"]) for r in hash_rank(df, "s", "row_id", ["grp"]).collect()}
    key = frame.row_id.map(lambda i: hashlib.md5(f"s|{i}".encode()).hexdigest())
    for _, part in frame.assign(key=key).groupby("grp", dropna=False):
        order = part.sort_values(["key", "row_id"]).row_id
        for rank, row_id in enumerate(order, start=1):
            assert got[row_id] == (rank, len(part))


@pytest.mark.parametrize("parts", [1, 17])
def test_folds_do_not_depend_on_partitioning(skewed, parts):
    _, df = skewed
    base = {r["row_id"]: r["fold"] for r in D.stratified_folds(df, ["grp"], 5, "f").collect()}
    again = {r["row_id"]: r["fold"] for r in D.stratified_folds(df.repartition(parts), ["grp"], 5, "f").collect()}
    assert base == again


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("target", [1, 7, 100, 1_000_000])
def test_running_totals(skewed, descending, target):
    frame, df = skewed
    out = running_totals(df, "x", {"w": F.col("w")}, by=["grp"], descending=descending, target=target).toPandas()
    cells = frame.groupby(["grp", "x"], dropna=False).w.sum().reset_index().sort_values("x", ascending=not descending)
    cells["cum"] = cells.groupby("grp", dropna=False).w.cumsum()
    cells["total"] = cells.groupby("grp", dropna=False).w.transform("sum")
    merged = out.merge(cells, on=["grp", "x"])
    assert len(merged) == len(cells) == len(out)
    assert (merged.w_cum == merged["cum"]).all()
    assert (merged.w_total == merged["total"]).all()


def test_buckets_follow_the_cells(spark):
    for rows in (20_000, 200_000):
        # a steep distribution with one hot group, a hot value, and small groups
        df = spark.range(rows).select(
            F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("grp"),
            F.when(F.col("id") % 4 == 0, 0.5).otherwise(F.exp(F.col("id") / rows * 20)).alias("x"),
        )
        for by in (["grp"], []):
            cells = bucketed_cells(df, "x", {"n": F.lit(1)}, by=by, target=500)
            found = cells.groupBy(*by, "__bk").count()
            assert found.agg(F.max("count")).first()[0] <= 1000
            assert found.count() >= df.select(*by, "x").distinct().count() / 1000
            assert cells.agg(F.sum("n")).first()[0] == rows


def test_buckets_read_the_rows_once(spark):
    df = spark.range(10_000).select((F.col("id") % 7).alias("grp"), (F.col("id") % 501).cast("double").alias("x"))
    plan = running_totals(df, "x", {"n": F.lit(1)}, by=["grp"])
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.split("== Initial Plan ==")[0].count("Range (0, 10000") == 1


def test_quantiles_match_numpy(skewed):
    frame, df = skewed
    qs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q975": 0.975, "q1": 1.0}
    for method in ("linear", "inverted_cdf"):
        got = exact_quantiles(df, "x", qs, by=["grp"], method=method).toPandas()
        for _, row in got.iterrows():
            part = frame[frame.grp.isna()] if row.grp is None else frame[frame.grp == row.grp]
            expected = np.quantile(part.x, list(qs.values()), method=method)
            assert np.allclose([row[n] for n in qs], expected)


def test_weighted_quantile_repeats_rows(skewed):
    frame, df = skewed
    got = exact_quantiles(df.where("w > 0"), "x", {"m": 0.5}, weight=F.col("w")).first()["m"]
    assert got == pytest.approx(np.median(np.repeat(frame.x, frame.w)))


def test_first_rows_of_counted_buckets(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 97 > 0, F.col("id") * 7919 % 1013).alias("x"))
    rows = [(r.row_id, r.x) for r in df.collect()]
    for n in (1, 60, 4999, 5000, 9000):
        got = first_n(df, n, F.coalesce(F.floor(F.col("x") / 100), F.lit(99)), [F.asc_nulls_last("x"), "row_id"])
        expected = sorted(rows, key=lambda r: (r[1] is None, r[1], r[0]))[:n]
        assert sorted(r.row_id for r in got.collect()) == sorted(r[0] for r in expected)
    assert first_n(df.where("row_id < 0"), 5, F.lit(0), ["row_id"]).count() == 0


def test_a_large_sample_is_no_global_limit(spark):
    df = spark.range(1_200_000).withColumnRenamed("id", "row_id")
    picked = D.sample_n(df, 1_000_000, "s")
    assert picked.count() == 1_000_000 == picked.distinct().count()
    for plan in (picked, last_n(df.withColumn("ts", F.timestamp_seconds("row_id")), 1_000_000)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in text and "GlobalLimit" not in text and "CollectLimit" not in text


def test_last_rows_with_ties_and_without_time(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") % 5 > 0, F.timestamp_seconds(F.col("id") % 50 * 40)).alias("ts"))
    rows = [(r.row_id, r.ts) for r in df.collect()]
    for n in (3, 95, 400, 450):
        got = sorted(r.row_id for r in last_n(df, n).collect())
        known = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0]), reverse=True)
        assert got == sorted([r[0] for r in known + sorted((r for r in rows if r[1] is None), reverse=True)][:n])
