"""Synthetic minority oversampling with exact nearest neighbours.

Neighbours are found without a cross join. Points are dealt to cells, boxes of
equally many points; a cell's points meet each other in one task, and those
that may have a neighbour across a border are sent to the cells within their
reach. Equal points are collapsed first, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions import nearest
from plumbline.functions.hashing import hash_int, hash_unit
from plumbline.functions.nearest import Blocks, matrix, plan_cells
from plumbline.functions.ordering import hash_rank
from plumbline.functions.session import cut
from plumbline.roles import require

register_pickle_by_value(nearest)  # tasks get its code and need no path to this package

MAX_PIVOTS = 100_000
CELL_POINTS = 4096
MAX_CELLS = 4096  # more points make larger cells, which have blocks of their own
CELL_SAMPLE, MAX_SAMPLE = 64, 1 << 17  # points that place the borders: for each cell, in all


def exact_neighbours(
    points: DataFrame, k: int, n_pivots: int | None = None, seed: object = "pivot", carry: Sequence[str] | None = None
) -> DataFrame:
    """The ``k`` nearest other points of every point: ``(id, nbr, dist, pos)`` with ``pos`` from 1.

    ``points`` has distinct ``id`` (bigint) and ``x`` (array<double>); it is read several
    times. Equal distances go by id, NaN is the greatest. A point with a NULL id or
    coordinate has no neighbours and is none. ``n_pivots`` is the number of cells;
    their borders come from a hash sample and only balance the work.

    With ``carry`` there is one row for each id that has neighbours: lists ``nbr``,
    ``dist`` and, for each name in ``carry``, ``nbr_<name>``, that column of ``points``.
    """
    import pyarrow as pa

    require(k >= 1, "k must be positive")
    require(n_pivots is None or n_pivots <= MAX_PIVOTS, f"at most {MAX_PIVOTS} pivots")
    carried = list(carry or ())
    more = [c for c in carried if c not in ("id", "x")]
    known = points.select(F.col("id").cast("bigint").alias("id"), "x", *more).where("id IS NOT NULL AND NOT exists(x, v -> v IS NULL)")
    n = known.count()
    if n_pivots is None:
        n_pivots = min(MAX_CELLS, max(1, -(-n // max(CELL_POINTS, 32 * k))))
    size = min(MAX_SAMPLE, CELL_SAMPLE * n_pivots)
    sampled = F.pmod(F.xxhash64(F.lit(str(seed)), "id"), F.lit(max(1, n))) < size
    sample = known.where(sampled).select("x").toArrow()["x"]
    cells = plan_cells(matrix(sample) if len(sample) else np.empty((0, 1)), n_pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = cells.of(matrix(pa.chunked_array([b["x"]])))
                yield b.append_column("cell", pa.array(cell.astype(np.int32)))

    def lists(values: np.ndarray | pa.Array, counts: np.ndarray) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, values if isinstance(values, pa.Array) else pa.array(values))

    def inside(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        cell, own = t["cell"][0].as_py(), Blocks(matrix(t["x"]), t["id"].to_numpy())
        place, met, dist, squares = own.nearest(own, own.reaches(k), k)
        counts = np.bincount(place, minlength=len(t))
        reach = np.full(len(t), np.nan)
        if len(full := np.flatnonzero(counts == k)):
            reach[full] = squares[np.repeat(counts == k, counts)].reshape(-1, k).max(axis=1)
        with np.errstate(all="ignore"):
            row, far = cells.others_near(own.x.T, reach, cell)
        out = t.take(pa.array(own.row))
        made = {"nbr": lists(own.ids[met], counts), "dist": lists(dist, counts)}
        made |= {f"nbr_{c}": lists(out[c].combine_chunks().take(pa.array(met)), counts) for c in carried}
        made |= {"reach": pa.array(reach), "others": lists(far.astype(np.int32), np.bincount(row, minlength=len(t)))}
        for name, values in made.items():
            out = out.append_column(name, values)
        return out

    def across(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            return pa.table([pa.array([], f.type) for f in found_types], names=found_types.names)
        asked, right = Blocks(matrix(left["x"]), left["id"].to_numpy()), right.combine_chunks()
        held = Blocks(matrix(right["x"]), right["id"].to_numpy())
        place, met, dist, _ = held.nearest(asked, left["reach"].to_numpy()[asked.row], k)
        near = right.take(pa.array(held.row[met]))
        return pa.table([pa.array(asked.ids[place]), near["id"], pa.array(dist), *[near[c] for c in carried]], names=found_types.names)

    pair = [T.StructField("nbr", T.LongType()), T.StructField("dist", T.DoubleType()), *[T.StructField(f"nbr_{c}", known.schema[c].dataType) for c in carried]]
    dealt = known.mapInArrow(deal, T.StructType([*known.schema.fields, T.StructField("cell", T.IntegerType())]))
    held = cut(dealt.groupBy("cell").applyInArrow(inside, T.StructType([
        *dealt.schema.fields, *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in pair],
        T.StructField("reach", T.DoubleType()), T.StructField("others", T.ArrayType(T.IntegerType())),
    ])))
    asking = held.select("id", "x", "reach", F.explode("others").alias("cell"))
    one = T.StructType([T.StructField("id", T.LongType()), *pair])
    found_types = to_arrow_schema(one)
    found = asking.groupBy("cell").cogroup(held.select(*known.columns, "cell").groupBy("cell")).applyInArrow(across, one)
    # points that share an id share their neighbours: then all lists meet
    shared = not known.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").isEmpty()
    settled = F.lit(False) if shared else F.size("others") == 0
    columns = [f.name for f in pair]
    items = F.explode(F.arrays_zip(*columns)).alias("__n")
    met = held.where(~settled).select("id", items).select("id", "__n.*").unionByName(found)
    order = Window.partitionBy("id").orderBy("dist", "nbr")
    ranked = met.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)
    if carry is None:
        listed = held.where(settled).select("id", F.posexplode(F.arrays_zip(*columns)).alias("__p", "__n"))
        return listed.select("id", "__n.*", (F.col("__p") + 1).alias("pos")).unionByName(ranked)
    together = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("__l"))
    together = together.select("id", *[F.col(f"__l.{c}").alias(c) for c in columns])
    return held.where(settled & (F.size("nbr") > 0)).select("id", *columns).unionByName(together)


def smote(
    df: DataFrame, features: Sequence[str], k: int = 5, seed: object = 0, target: str = "y", minority: int = 1,
    row_id: str = "row_id", n_pivots: int | None = None,
) -> DataFrame:
    """Original rows and interpolated minority rows up to a 1:1 class ratio.

    Adds ``is_synthetic``; synthetic rows have a NULL row id. A synthetic row lies
    between a drawn minority row and one of its ``k`` nearest minority rows; with
    fewer than ``k`` the job fails. Use it on a training part only.
    """
    require(k >= 1, "k must be positive")
    rows = cut(df.select(row_id, target, *[F.col(c).cast("double").alias(c) for c in features]))
    small = rows.where(F.col(target) == minority).withColumn("x", F.array(*features))
    large = rows.where(F.col(target) != minority)
    distinct = cut(small.groupBy("x").agg(F.min(row_id).alias("id"), F.count(F.lit(1)).alias("m")))
    listed = exact_neighbours(distinct, k, n_pivots, carry=["x", "m"])
    bases = hash_rank(small.select(row_id, "x"), f"{seed}-base", row_id, (), rank="__rank", size=None)
    # every majority row beyond the minority count is a slot for one synthetic row
    slots = hash_rank(large.select(row_id), f"{seed}-slot", row_id, (), rank="__slot", size="__large")
    n_small = small.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = slots.withColumn("__ns", n_small).where(F.col("__slot") <= F.col("__large") - F.col("__ns")).select(
        "__slot", (hash_int(f"{seed}-draw", "__slot") % F.col("__ns") + 1).alias("__rank"),
        (hash_int(f"{seed}-nbr", "__slot") % F.lit(k) + 1).alias("j"), hash_unit(f"{seed}-u", "__slot").alias("u"),
    )
    # lists come last: each is shuffled once, and numbers are sorted before points
    drawn = draws.join(bases.select("__rank", "x"), "__rank").withColumn("__h", F.xxhash64("x"))
    drawn = drawn.join(distinct.withColumn("__h", F.xxhash64("x")), ["__h", "x"])
    met = drawn.join(listed.select("id", F.arrays_zip(F.col("nbr_m").alias("copies"), F.col("nbr_x").alias("y")).alias("ns")), "id", "left")
    # a row's own copies are its first neighbours, then each distinct neighbour with its copies
    rest = F.col("j") - (F.col("m") - 1)
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("array<double>").alias("y"))

    def walk(acc: Column, item: Column) -> Column:
        hit = acc["y"].isNull() & (acc["seen"] + item["copies"] >= rest)
        return F.struct((acc["seen"] + item["copies"]).alias("seen"), F.when(hit, item["y"]).otherwise(acc["y"]).alias("y"))

    found = F.aggregate(F.coalesce("ns", F.array().cast("array<struct<copies:bigint,y:array<double>>>")), start, walk)["y"]
    few = F.raise_error(F.lit(f"fewer than {k} minority neighbours to interpolate with")).cast("array<double>")
    other = F.when(rest >= 1, F.coalesce(found, few)).otherwise(F.col("x"))
    made = met.withColumn("__y", other).withColumn("__z", F.zip_with("x", "__y", lambda a, b: a + F.col("u") * (b - a)))
    synthetic = made.select(
        F.lit(None).cast("bigint").alias(row_id), F.lit(minority).alias(target),
        *[F.element_at("__z", i + 1).alias(c) for i, c in enumerate(features)], F.lit(True).alias("is_synthetic"),
    )
    return rows.withColumn("is_synthetic", F.lit(False)).unionByName(synthetic)
