"""Row lists for bounded contexts and group-balanced batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import hash_rank, null_safe_join
from plumbline.roles import require


def _deal(ranked: DataFrame, n_lists: int, take: str, size: str) -> DataFrame:
    """Deal each stratum circularly: list i holds the ``take`` ranks from i * take on, wrapping round.

    Each row computes the lists that hold it: on the c-th time round, its place
    rank - 1 + c * size falls into list place // take. As ``take`` is at most
    ``size``, a list holds a row once; no row meets a list that doesn't hold it.
    """
    place = F.col("__rank") - 1
    rounds = F.floor((n_lists * F.col(take) - 1 - place) / F.col(size))
    times = F.when((F.col(take) > 0) & (rounds >= 0), F.sequence(F.lit(0).cast("bigint"), rounds)).otherwise(F.array().cast("array<bigint>"))
    spread = ranked.withColumn("__round", F.explode(times))
    return spread.withColumn("list_id", F.floor((place + F.col("__round") * F.col(size)) / F.col(take)).cast("int"))


def stratified_contexts(
    df: DataFrame, strata: Sequence[str], n_lists: int, max_rows: int, seed: object, row_id: str = "row_id"
) -> DataFrame:
    """``(list_id, row_id)``: lists within ``max_rows`` rows that keep every stratum's share.

    Together the lists use every row of a stratum when their capacity allows.
    """
    require(n_lists >= 1 and max_rows >= 1, "n_lists and max_rows must be positive")
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(F.lit(0)))
    shares = sizes.withColumn("__take", F.floor(F.col("__n") * F.least(F.lit(1.0), F.lit(max_rows) / total)))
    ranked = hash_rank(df.select(row_id, *strata), seed, row_id, strata, rank="__rank", size=None)
    return _deal(null_safe_join(ranked, shares, list(strata)), n_lists, "__take", "__n").select("list_id", *strata, row_id)


def balanced_contexts(
    df: DataFrame, group: str, target: str, n_lists: int, max_rows: int, seed: object, row_id: str = "row_id"
) -> DataFrame:
    """``(list_id, row_id)``: the same number of rows from every group, each group's class ratio kept.

    The number is the smallest group's size, capped so that a list fits ``max_rows``.
    """
    require(n_lists >= 1 and max_rows >= 1, "n_lists and max_rows must be positive")
    cells = df.groupBy(group, target).agg(F.count(F.lit(1)).alias("__n"))
    in_group = cells.withColumn("__ng", F.sum("__n").over(Window.partitionBy(group)))
    everything = Window.partitionBy(F.lit(0))
    groups = F.size(F.collect_set(group).over(everything))
    per_group = F.least(F.min("__ng").over(everything), F.floor(F.lit(max_rows) / groups))
    shares = in_group.select(group, target, "__n", F.floor(per_group * F.col("__n") / F.col("__ng")).alias("__take"))
    strata = [group, target]
    ranked = hash_rank(df.select(row_id, *strata), seed, row_id, strata, rank="__rank", size=None)
    return _deal(null_safe_join(ranked, shares, strata), n_lists, "__take", "__n").select("list_id", *strata, row_id)


def balanced_batches(
    df: DataFrame, group: str, batch_size: int, epochs: int, seed: object, row_id: str = "row_id"
) -> DataFrame:
    """Batch plan ``(epoch, step, slot, group, row_id)`` with equal rows per group in every step.

    A group is served in a shuffled order that is renewed once used up, so each
    of its rows appears before any repeats. An epoch has ceil(n / batch_size) steps.
    """
    require(batch_size >= 1 and epochs >= 1, "batch_size and epochs must be positive")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    everything = Window.partitionBy(F.lit(0))
    n_groups = F.count(F.lit(1)).over(everything)
    per_group = F.floor(F.lit(batch_size) / n_groups)
    checked = F.when(per_group >= 1, per_group).otherwise(F.raise_error(F.lit("batch_size is too small for the number of groups")).cast("bigint"))
    steps = F.ceil(F.sum("__n").over(everything) / F.lit(batch_size))
    plan = sizes.withColumn("__per", checked).withColumn("__steps", steps)
    plan = plan.withColumn("__total", F.col("__per") * F.col("__steps") * epochs)
    rows = null_safe_join(df.select(row_id, group), plan, [group])
    passes = F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("__total") / F.col("__n")) - 1)
    spread = rows.withColumn("__pass", F.explode(passes))
    ranked = hash_rank(spread, seed, row_id, [group, "__pass"], rank="__rank", size=None, salt=["__pass"])
    served = ranked.withColumn("__q", F.col("__pass") * F.col("__n") + F.col("__rank") - 1).where("__q < __total")
    step_index = F.floor(F.col("__q") / F.col("__per"))
    return served.select(
        F.floor(step_index / F.col("__steps")).cast("bigint").alias("epoch"),
        (step_index % F.col("__steps")).cast("bigint").alias("step"),
        (F.col("__q") % F.col("__per")).cast("bigint").alias("slot"),
        group, row_id,
    )
