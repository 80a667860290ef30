"""Row weights against class and group imbalance.

Counts are small aggregates joined back to the rows; the class or group with
most rows never has to fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import null_safe_join


def _counts(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def class_weights(df: DataFrame, target: str = "y", out: str = "weight") -> DataFrame:
    """n / (classes * n_class)."""
    per_class = _counts(df, [target], "__c")
    everything = Window.partitionBy(F.lit(0))
    table = per_class.select(
        target, (F.sum("__c").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("__c"))).alias(out)
    )
    return null_safe_join(df, table, [target])


def within_group_class_weights(df: DataFrame, group: str = "grp", target: str = "y", out: str = "weight") -> DataFrame:
    """Balanced class weights inside each group; a group's weights sum to its row count."""
    cells = _counts(df, [group, target], "__c")
    inside = Window.partitionBy(group)
    table = cells.select(
        group, target, (F.sum("__c").over(inside) / (F.count(F.lit(1)).over(inside) * F.col("__c"))).alias(out)
    )
    return null_safe_join(df, table, [group, target])


def group_weights(df: DataFrame, group: str = "grp", out: str = "weight") -> DataFrame:
    """n / (groups * n_group): equal total weight per group, mean 1."""
    return class_weights(df, group, out)


def class_by_group_weights(df: DataFrame, group: str = "grp", target: str = "y", out: str = "weight") -> DataFrame:
    """Class weight times group weight."""
    both = group_weights(class_weights(df, target, "__wc"), group, "__wg")
    return both.withColumn(out, F.col("__wc") * F.col("__wg")).drop("__wc", "__wg")


def no_resampling(df: DataFrame, out: str = "weight") -> DataFrame:
    """The rows as they are, without a weight."""
    return df.withColumn(out, F.lit(None).cast("double"))


def positive_class_weight(df: DataFrame, target: str = "y", scale: float | Column | None = None, out: str = "weight") -> DataFrame:
    """Weight 1 for negatives and ``scale`` (default: negatives / positives) for positives."""
    if scale is None:
        scale = df.agg((F.sum(1 - F.col(target)) / F.sum(target)).alias("s")).scalar()
    value = scale if isinstance(scale, Column) else F.lit(float(scale))
    return df.withColumn(out, F.when(F.col(target) == 1, value).otherwise(F.lit(1.0)))


def group_ids(df: DataFrame, group: str = "grp", target: str | None = None, out: str = "group_id") -> DataFrame:
    """Contiguous integer ids from 0 in label order, for a group or a group x class label."""
    label = F.col(group).cast("string")
    if target is not None:
        label = F.concat(label, F.lit("_"), F.col(target).cast("string"))
    labelled = df.withColumn("__label", label)
    names = labelled.select("__label").distinct()
    table = names.select("__label", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__label")) - 1).alias(out))
    return null_safe_join(labelled, table, ["__label"]).drop("__label")
