"""Rank statistics over two short aligned arrays (one entry per feature).

The arrays hold one row's or one group's features, so their length is bounded by
the schema; everything is a narrow expression on the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def average_ranks(a: Column) -> Column:
    """Ascending ranks from 1; ties share their mean rank."""
    def ranks(values: Column) -> Column:
        def rank(x: Column) -> Column:
            lower = F.size(F.filter(values, lambda v: v < x))
            same = F.size(F.filter(values, lambda v: v == x))
            return lower + (same + 1) / F.lit(2.0)

        return F.transform(values, rank)

    return let(a, ranks)


def ordinal_ranks_desc(a: Column) -> Column:
    """0-based descending ranks; ties go to the lower position."""
    def ranks(values: Column) -> Column:
        return F.transform(
            values, lambda x, i: F.size(F.filter(values, lambda v, j: (v > x) | ((v == x) & (j < i)))).cast("double")
        )

    return let(a, ranks)


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation of two rank arrays in one pass; NULL when either is constant.

    Ranks are multiples of one half, so the sums are exact.
    """
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("n", "x", "y", "xx", "yy", "xy")])

    def add(s: Column, z: Column) -> Column:
        x, y = z["x"], z["y"]
        return F.struct(
            (s["n"] + 1.0).alias("n"), (s["x"] + x).alias("x"), (s["y"] + y).alias("y"),
            (s["xx"] + x * x).alias("xx"), (s["yy"] + y * y).alias("yy"), (s["xy"] + x * y).alias("xy"),
        )

    def finish(s: Column) -> Column:
        vx, vy = s["n"] * s["xx"] - s["x"] * s["x"], s["n"] * s["yy"] - s["y"] * s["y"]
        return F.when((vx > 0) & (vy > 0), (s["n"] * s["xy"] - s["x"] * s["y"]) / F.sqrt(vx * vy))

    return F.aggregate(F.arrays_zip(a.alias("x"), b.alias("y")), zero, add, finish)


def is_constant(a: Column) -> Column:
    return let(a, lambda values: F.array_max(values) == F.array_min(values))


def kendall_tau_b(a: Column, b: Column) -> Column:
    """Kendall's tau-b of two arrays; NULL when either is constant."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("num", "nx", "ny")])

    def over(pairs: Column) -> Column:
        # every ordered pair of positions: each unordered pair counts twice in all three sums
        def outer(s: Column, p: Column) -> Column:
            def inner(t: Column, q: Column) -> Column:
                sx, sy = F.signum(p["x"] - q["x"]), F.signum(p["y"] - q["y"])
                return F.struct((t["num"] + sx * sy).alias("num"), (t["nx"] + F.abs(sx)).alias("nx"), (t["ny"] + F.abs(sy)).alias("ny"))

            return F.aggregate(pairs, s, inner)

        return F.aggregate(
            pairs, zero, outer, lambda s: F.when((s["nx"] > 0) & (s["ny"] > 0), s["num"] / F.sqrt(s["nx"] * s["ny"]))
        )

    return let(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: F.struct(z["x"].cast("double").alias("x"), z["y"].cast("double").alias("y"))), over)


def top_k_overlap(a: Column, b: Column, k: int) -> Column:
    """Share of the ``k`` largest entries both arrays have in common."""
    def top(values: Column) -> Column:
        ranked = F.transform(ordinal_ranks_desc(values), lambda r, i: F.when(r < k, i))
        return F.array_compact(ranked)

    return F.size(F.array_intersect(top(a), top(b))) / F.lit(float(k))


def argmax(a: Column) -> Column:
    """1-based position of the first largest entry."""
    return let(a, lambda values: F.array_position(values, F.array_max(values)))
