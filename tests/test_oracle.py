"""Every registered query beside its SQL on the smallest tables.

A short list runs by default; ORACLE_ALL=1 runs every query.
"""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, duck

SHORT = (
    "v", "p", "j", "w", "x", "f", "s1_", "s3_", "s4_", "s8_", "s12_", "d1_", "d2_", "d5_", "d9_", "d10_", "d12_", "d14_", "d18_", "d20_", "d22_",
    "a1_", "a4_", "a6_", "a8_", "a12_", "a14_", "a20_", "m3_", "m7_", "b1_", "b6_", "b9_", "b11_", "r1_", "r3_", "r4_", "r8_", "r9_",
    "t2_", "t4_", "l10_dro", "e2_", "e6_", "e9_", "e11_", "e13_", "e14_", "e16_", "e30_",
)
NAMES = [n for n in queries() if os.environ.get("ORACLE_ALL") or n.startswith(SHORT)]


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    problem, _ = compare(df, con, sql)
    assert not problem


def test_entry(spark):
    out = entry(spark)
    assert out.columns and out.count() > 0


def test_no_cross_joins_or_python_rows(spark, sf_dir):
    for name in ("r9_feature_drift", "m8_metrics_by_group", "d5_stratified_sample", "e2_exact_shapley", "a13_association_matrix", "r3_categorical_shares"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert node not in plan, (name, node)
