"""Alignment joins, rankings, shares and set operations between survey tables.

Thin forms over Spark's own operators. Where a group may hold a large part of
the rows, totals are aggregated and joined back instead of windowed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import null_safe_join, running_totals
from plumbline.roles import require


def align(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Inner join on the row key: rows both tables have."""
    return a.join(b, list(keys))


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left join with a default for keys the table lacks."""
    joined = null_safe_join(df, table, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def exclude(df: DataFrame, rows: DataFrame, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Rows whose key is not in ``rows``."""
    return df.join(rows.select(*keys), list(keys), "left_anti")


def membership(df: DataFrame, rows: DataFrame, flag: str, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Add a boolean: whether the row's key is in ``rows``."""
    marks = rows.select(*keys).distinct().withColumn(flag, F.lit(True))
    return df.join(marks, list(keys), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def expand(df: DataFrame, values: Mapping[str, Sequence[object]]) -> DataFrame:
    """Each row with every combination of short parameter lists (coalitions, replicates, groups)."""
    out = df
    for name, items in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(i) for i in items])))
    return out


def bin_by_edges(df: DataFrame, column: str, edges: DataFrame, by: Sequence[str], out: str = "bin") -> DataFrame:
    """Bin of a value among its group's right-closed edges: an equi-join on the group, then a count of edges."""
    joined = df.join(edges.select(*by, F.col("edges").alias("__e")), list(by))
    return joined.withColumn(out, F.size(F.filter("__e", lambda e: e < F.col(column)))).drop("__e")


def unordered_pairs(df: DataFrame, key: str, by: Sequence[str], value: str) -> DataFrame:
    """Pairs ``a < b`` of a small aggregate's keys inside ``by``, with both values."""
    left = df.select(*by, F.col(key).alias("a"), F.col(value).alias("value_a"))
    right = df.select(*by, F.col(key).alias("b"), F.col(value).alias("value_b"))
    return left.join(right, list(by)).where("a < b")


def rank_min(df: DataFrame, by: Sequence[str], order: Column, out: str = "rank") -> DataFrame:
    """Competition ranking inside short groups; ties share the lowest rank."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(order)))


def rank_average(df: DataFrame, by: Sequence[str], column: str, out: str = "rank") -> DataFrame:
    """Ascending ranks with ties at their mean, for groups of any size."""
    cells = running_totals(df, column, {"__w": F.lit(1)}, by=by)
    ranks = cells.select(*by, column, (F.col("__w_cum") - F.col("__w") + (F.col("__w") + 1) / F.lit(2.0)).alias(out))
    return null_safe_join(df, ranks, [*by, column])


def cumulative(df: DataFrame, order: str, sums: Mapping[str, Column], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Prefix sums over distinct order values, peers together, with each value's own increment."""
    return running_totals(df, order, dict(sums), by=by, descending=descending)


def share_of_total(df: DataFrame, by: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """Value divided by its group's total."""
    totals = df.groupBy(*by).agg(F.sum(value).alias("__t"))
    return null_safe_join(df, totals, list(by)).withColumn(out, F.when(F.col("__t") != 0, F.col(value) / F.col("__t"))).drop("__t")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark limits groups before the shuffle."""
    require(k >= 1, "k must be positive")
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("__r") <= k).drop("__r")


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either selection, once each."""
    return a.union(b).distinct()


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)
