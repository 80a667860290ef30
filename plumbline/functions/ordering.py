"""Ranks, prefix sums and exact quantiles that do not need one task per group.

``row_number() over (partition by g order by x)`` sends a whole group to one
task, which fails when one group holds a third of the rows. Every function
here splits a group into ordered buckets first: rows are ranked or summed
inside their bucket, and a small table of bucket totals supplies the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import hash_key
from plumbline.roles import require

BUCKET_CELLS = 50_000  # distinct values in a range bucket
SAMPLES_PER_BUCKET = 32  # sampled cells for one edge
_LONGEST = 30  # doublings of the edge search
HASH_DIGITS = 3  # 16**3 buckets per stratum


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; right keys are dropped."""
    require(len(keys) > 0, "a join needs key columns")
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
    condition = None
    for key in keys:
        term = left[key].eqNullSafe(renamed[f"__r_{key}"])
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{key}" for key in keys])


def _before(by: Sequence[str], order: Sequence[Column | str]):
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _whole(by: Sequence[str]):
    return Window.partitionBy(*(by or [F.lit(0)]))


def hash_rank(
    df: DataFrame,
    seed: object,
    row_id: str = "row_id",
    strata: Sequence[str] = (),
    rank: str = "rank",
    size: str | None = "stratum_size",
    salt: Sequence[str] = (),
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Add the 1-based hash-order rank of each row inside its stratum.

    ``salt`` columns enter the hash, so the same rows get a fresh order for
    each salt value (they are usually part of ``strata`` too).
    """
    strata = list(strata)
    keyed = df.withColumn("__hr_h", hash_key(seed, *salt, row_id)).withColumn("__bk", F.substring("__hr_h", 1, digits))
    counts = keyed.groupBy(*strata, "__bk").agg(F.count(F.lit(1)).alias("__hr_c"))
    offsets = counts.select(
        *strata,
        "__bk",
        F.coalesce(F.sum("__hr_c").over(_before(strata, ["__bk"])), F.lit(0)).alias("__hr_off"),
        F.sum("__hr_c").over(_whole(strata)).alias("__hr_n"),
    )
    inside = Window.partitionBy(*strata, "__bk").orderBy("__hr_h", row_id)
    ranked = keyed.withColumn("__hr_r", F.row_number().over(inside))
    out = null_safe_join(ranked, offsets, [*strata, "__bk"])
    out = out.withColumn(rank, (F.col("__hr_off") + F.col("__hr_r")).cast("bigint"))
    if size:
        out = out.withColumn(size, F.col("__hr_n").cast("bigint"))
    return out.drop("__hr_h", "__bk", "__hr_r", "__hr_off", "__hr_n")


def _edges_below(value: Column, edges: Column) -> Column:
    """Number of sorted edges below ``value``, by doubling steps: an order-preserving bucket number."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(_LONGEST))])

    def farther(found: Column, step: Column) -> Column:
        inside = (found + step <= F.size(edges)) & (F.get(edges, found + step - 1) < value)
        return F.when(inside, found + step).otherwise(found)

    return F.when(F.size(edges) == 0, 0).otherwise(F.aggregate(steps, F.lit(0), farther))


def bucketed_cells(df: DataFrame, order: str, sums: dict[str, Column], by: Sequence[str] = (), target: int = BUCKET_CELLS) -> DataFrame:
    """One row per (by, order) with the sums and a range bucket ``__bk`` of about ``target`` cells.

    Each group gets as many buckets as its counted cells need, one if they are within
    the target. Edges come from a mergeable sketch, the cells whose hash falls into a
    share of the hash range: every 32nd sampled value is an edge.
    """
    require(target >= 1, "target must be positive")
    by = list(by)
    cells = df.groupBy(*by, order).agg(*[F.sum(col).alias(name) for name, col in sums.items()])
    value = F.col(order).cast("double")
    sampled = F.when(F.pmod(F.xxhash64(order), F.lit(max(1, target // SAMPLES_PER_BUCKET))) == 0, value)
    picked = F.filter(F.array_sort(F.collect_list(sampled)), lambda _, i: (i + 1) % SAMPLES_PER_BUCKET == 0)
    # counting the sums as well keeps these cells' plan equal to that of the cells joined below: one scan and shuffle serve both
    size = F.greatest(F.count(F.lit(1)), *[F.count(name) for name in sums])
    shape = cells.groupBy(*by).agg(F.when(size > target, picked).otherwise(F.array().cast("array<double>")).alias("__e"))
    known = null_safe_join(cells, shape, by) if by else cells.withColumn("__e", shape.scalar())
    return known.withColumn("__bk", _edges_below(value, F.col("__e"))).drop("__e")


def running_totals(
    df: DataFrame, order: str, sums: dict[str, Column], by: Sequence[str] = (), descending: bool = False, target: int = BUCKET_CELLS
) -> DataFrame:
    """Prefix sums over the distinct values of ``order`` (a number), peers together.

    Returns one row per (by, order) with, for every name in ``sums``, the cell
    value ``name``, the inclusive prefix sum ``name_cum`` and the group total
    ``name_total``. Bucket edges only balance the work: the sums are exact whatever
    they are.
    """
    by = list(by)
    names = list(sums)
    known = bucketed_cells(df, order, sums, by, target)
    bucket_order = F.col("__bk").desc() if descending else F.col("__bk").asc()
    value_order = F.col(order).desc() if descending else F.col(order).asc()
    totals = known.groupBy(*by, "__bk").agg(*[F.sum(name).alias(name) for name in names])
    offsets = totals.select(
        *by,
        "__bk",
        *[F.coalesce(F.sum(n).over(_before(by, [bucket_order])), F.lit(0)).alias(f"__off_{n}") for n in names],
        *[F.sum(n).over(_whole(by)).alias(f"{n}_total") for n in names],
    )
    inside = Window.partitionBy(*by, "__bk").orderBy(value_order).rowsBetween(Window.unboundedPreceding, 0)
    local = known.select("*", *[F.sum(n).over(inside).alias(f"__in_{n}") for n in names])
    joined = null_safe_join(local, offsets, [*by, "__bk"])
    return joined.select(
        *by,
        order,
        *names,
        *[(F.col(f"__off_{n}") + F.col(f"__in_{n}")).alias(f"{n}_cum") for n in names],
        *[f"{n}_total" for n in names],
    )


def first_n(df: DataFrame, n: int, bucket: Column, order: Sequence[Column | str]) -> DataFrame:
    """The ``n`` first rows by (bucket, order); ``bucket`` is a coarse key that keeps the order and is never NULL.

    Buckets are counted where the rows are. Those that start within the first ``n``
    rows are read again and ranked each on its own, so neither ``n`` rows nor one
    more than a bucket meet in a task. What one task sees is the table of bucket
    counts, which the caller's key bounds.
    """
    require(n > 0, "n must be positive")
    keyed = df.withColumn("__bk", bucket)
    counts = keyed.groupBy("__bk").agg(F.count(F.lit(1)).alias("__c"))
    starts = counts.select("__bk", F.coalesce(F.sum("__c").over(_before([], ["__bk"])), F.lit(0)).alias("__s"))
    last = starts.where(F.col("__s") < n).agg(F.struct(F.max("__bk").alias("bk"), (n - F.max("__s")).alias("need"))).scalar()
    inside = Window.partitionBy("__bk").orderBy(*order)
    reached = keyed.withColumn("__l", last).where(F.col("__bk") <= F.col("__l.bk")).withColumn("__r", F.row_number().over(inside))
    return reached.where((F.col("__bk") < F.col("__l.bk")) | (F.col("__r") <= F.col("__l.need"))).drop("__bk", "__l", "__r")


def exact_quantiles(
    df: DataFrame,
    column: str,
    quantiles: dict[str, float],
    by: Sequence[str] = (),
    method: str = "linear",
    weight: Column | None = None,
    extra: Sequence[Column] = (),
    target: int = BUCKET_CELLS,
) -> DataFrame:
    """Exact quantiles per group through prefix sums over distinct values.

    ``linear`` interpolates between order statistics; ``inverted_cdf`` returns
    an observed value. NULLs are ignored. ``weight`` gives integer row
    multiplicities. ``extra`` aggregates (over ``column``, ``__hr_c`` the count of
    a value) are computed in the same pass.
    """
    require(method in ("linear", "inverted_cdf"), f"unknown quantile method {method!r}")
    for q in quantiles.values():
        require(0.0 <= q <= 1.0, f"quantile {q} is outside [0, 1]")
    present = df.where(F.col(column).isNotNull())
    cells = running_totals(present, column, {"__hr_c": weight if weight is not None else F.lit(1)}, by=by, target=target)
    total, upto = F.col("__hr_c_total"), F.col("__hr_c_cum")
    before = upto - F.col("__hr_c")

    def at(position: Column) -> Column:
        hit = (before <= position) & (position < upto)
        return F.max(F.when(hit, F.col(column)))

    outputs = []
    for name, q in quantiles.items():
        if method == "linear":
            position = F.lit(float(q)) * (total - 1)
            low, high = F.floor(position), F.ceil(position)
            fraction = F.max(position - low)
            outputs.append((at(low) + (at(high) - at(low)) * fraction).alias(name))
        else:
            # the smallest value whose cumulative share reaches q
            position = F.greatest(F.ceil(F.round(F.lit(float(q)) * total, 9)) - 1, F.lit(0))
            outputs.append(at(position).alias(name))
    return cells.groupBy(*by).agg(*outputs, *extra)
