"""Scalar helpers built from Spark functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL where the denominator is 0."""
    return F.when(denominator != 0, numerator / denominator)


def unpivot_text(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form ``ids, column, level`` with every value as text."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    )
    return df.select(*ids, pairs.alias("__p")).select(*ids, "__p.column", "__p.level")


def unpivot_number(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form ``ids, feature, value`` with every value as double."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    return df.select(*ids, pairs.alias("__p")).select(*ids, "__p.feature", "__p.value")


def mean_pm_std(mean: Column, std: Column, digits: int = 3) -> Column:
    """``0.590 ± 0.019`` text."""
    pattern = f"%.{digits}f"
    return F.concat(F.format_string(pattern, mean), F.lit(" ± "), F.format_string(pattern, std))


def numbers_in(text: Column) -> Column:
    """All decimal numbers of a text cell, as an array of doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+\.?\d*)"), F.lit(1)), lambda s: s.cast("double"))
