"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.session import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) but the roots; root is the least node reached.

    Each round hangs all larger neighbours of a node on its least neighbour, then the
    smaller ones; trees get flat in a logarithmic number of rounds. Rounds are tables
    in the shared folder; nothing but two checksums and a count reaches the driver.
    """
    least = F.least("u", "v")
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), least.alias("v")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = cut(small)
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
