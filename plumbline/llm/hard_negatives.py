"""Hard negatives by Fagin's threshold algorithm.

Rows of one label form blocks. A block keeps, for each dimension, its rows sorted by that
component. An anchor reads the 64 lists from the end that its own component's sign favours
(sorted access), scores each row it meets first in full (random access, integers), and
knows from the last components read what no unmet row can exceed: the threshold. It stops
once the threshold falls strictly below the k-th score of every window it must fill (of an
unfilled window: below its lower end), strictly, because ties go to the smaller id.

Two rounds: the best rows of the anchor's own label, in that label's blocks, then for each
of them the best rows of other labels in its window, in all other blocks. Every block gives
its best k; a rank over (anchor, window) keeps the best of all blocks, cut to k before the
shuffle. Rows are shuffled to their blocks, anchors (a stated query set) are sent to each
block they need; a block streams through its task, rows first.

Defined results: rows with a NULL id, label or vector, or a NULL or non-finite component,
take no part. Rows equal in id, label and vector count once. A row is no positive of an
anchor with its id. Vectors of different lengths are never compared. Equal scores go by
the smaller id. An anchor without positives, or a positive without negatives, has no rows.
Other columns are not used, whatever their names. Scores saturate at 64 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.session import cut

BLOCK_ROWS = 4096
_TARGET_SALTS = 64
_MOST = (1 << 63) - 1
_KEY = ("anchor_id", "label", "twin")

Need = tuple[int, int, int]  # lowest score, highest score, how many


class Block:
    """Rows of one label, sorted in each dimension."""

    def __init__(self, ids: list[int], vectors: np.ndarray):
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        self.ids, self.vectors = np.array(ids, np.int64)[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.lists, axis=0)
        self.largest = int(np.abs(self.vectors).max(initial=0))
        self.floats = self.vectors.astype(np.float64)
        self.reads = 0

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact integer inner products: in floats while every sum stays below 2^53."""
        bound = self.largest * int(np.abs(anchor).max(initial=0)) * len(anchor)
        if bound < 1 << 53:
            return (self.floats[rows] @ anchor.astype(np.float64)).astype(np.int64)
        if bound < 1 << 63:
            return self.vectors[rows] @ anchor
        exact = self.vectors[rows].astype(object) @ anchor.astype(object)
        return np.array([max(-_MOST, min(_MOST, int(x))) for x in exact], np.int64)

    def best(self, anchor: np.ndarray, needs: list[Need], without: int | None = None, step: int = 16) -> list[list[tuple[int, int]]]:
        """For each need the first rows within its scores, as (score, id), highest first, then smaller id."""
        n = len(self.ids)
        if not n:
            return [[] for _ in needs]
        used = np.flatnonzero(anchor)
        down, weight = anchor[used] > 0, anchor[used].astype(object)
        met, score = np.zeros(n, bool), np.zeros(n, np.int64)
        depth = 0
        while depth < n:
            until = min(n, depth + step) if len(used) else n
            fresh = np.zeros(n, bool)
            if len(used):
                fresh[self.lists[n - until : n - depth, used[down]]] = True
                fresh[self.lists[depth:until, used[~down]]] = True
            else:
                fresh[:] = True
            rows = np.flatnonzero(fresh & ~met)
            met[rows] = True
            score[rows] = self.scores(rows, anchor)
            depth, step = until, 2 * step
            last = np.where(down, self.sorted[n - depth, used], self.sorted[depth - 1, used])
            threshold = int((last.astype(object) * weight).sum()) if len(used) else 0
            seen = np.flatnonzero(met)
            if all(threshold < self._limit(score[seen], self.ids[seen], need, without) for need in needs):
                break
        self.reads += len(seen)
        return [self._first(score[seen], self.ids[seen], need, without) for need in needs]

    @staticmethod
    def _inside(score: np.ndarray, ids: np.ndarray, need: Need, without: int | None) -> np.ndarray:
        inside = (score >= need[0]) & (score <= need[1])
        return np.flatnonzero(inside if without is None else inside & (ids != without))

    def _limit(self, score: np.ndarray, ids: np.ndarray, need: Need, without: int | None) -> int:
        """The k-th score of a filled window, else its lower end."""
        inside = self._inside(score, ids, need, without)
        return int(np.partition(score[inside], len(inside) - need[2])[len(inside) - need[2]]) if len(inside) >= need[2] else need[0]

    def _first(self, score: np.ndarray, ids: np.ndarray, need: Need, without: int | None) -> list[tuple[int, int]]:
        inside = self._inside(score, ids, need, without)
        order = inside[np.lexsort((ids[inside], -score[inside]))[: need[2]]]
        return list(zip(score[order].tolist(), ids[order].tolist()))


def prepare(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """(id, label, dim, v): the rows that take part, v the floors of `scale` * components as little-endian 64-bit integers."""
    schema = "id bigint, label bigint, dim int, v binary"
    arrow = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("v", pa.binary())])
    most = float(1 << 62)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            lists = b.column(2)
            flat = lists.flatten()
            edges = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            for i, (k, lab) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                x = values[edges[i] : edges[i + 1]]
                if np.isfinite(x).all():
                    out[0].append(k)
                    out[1].append(lab)
                    out[2].append(len(x))
                    out[3].append(np.clip(np.floor(scale * x), -most, most).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    named = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    return named.where("id is not null and label is not null and x is not null").mapInArrow(run, schema)


def _streamed(rows: DataFrame, anchors: DataFrame, find, schema: pa.Schema) -> DataFrame:
    """find(block, anchor row) for each anchor sent to a block; a block's rows come before its anchors."""
    block = ["dim", "label", "block"]
    together = (
        rows.select(*block, F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("bigint").alias("own"), F.lit(None).cast("array<struct<score:bigint,id:bigint>>").alias("wins"))
        .unionByName(anchors.select(*block, F.lit(1).alias("kind"), "id", "v", "own", "wins"))
        .repartition(*block).sortWithinPartitions(*block, "kind")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, vectors, ready = None, [], [], None
        for b in batches:
            found: list[tuple] = []
            c = {name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)}
            for i, here in enumerate(zip(c["dim"], c["label"], c["block"])):
                if here != place:
                    place, ids, vectors, ready = here, [], [], None
                if c["kind"][i] == 0:
                    ids.append(c["id"][i])
                    vectors.append(c["v"][i])
                    continue
                if ready is None:
                    ready = Block(ids, np.frombuffer(b"".join(vectors), "<i8").reshape(len(ids), here[0]))
                found.extend(find(ready, c["id"][i], c["own"][i], np.frombuffer(c["v"][i], "<i8"), c["wins"][i]))
            columns = list(zip(*found)) if found else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(columns, schema)], schema=schema)

    types = ", ".join(f"{f.name} bigint" for f in schema)
    return together.mapInArrow(run, types)


def _fields(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])


def _twin(v: bytes) -> int:
    """Tells anchors apart that share id and label."""
    return zlib.crc32(v)


def mine(
    prepared: DataFrame, every: int = 50, n_positive: int = 5, n_negative: int = 3, low: int = 50, high: int = 95, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows of prepare().

    Anchors are the rows whose id is divisible by `every`. A positive's window holds the
    scores s with low * positive <= 100 * s <= high * positive.
    """
    rows = cut(prepared.dropDuplicates(["id", "label", "v"]))
    blocks = rows.groupBy("dim", "label").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = rows.join(blocks, ["dim", "label"]).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))
    numbers = F.sequence(F.lit(0), F.col("blocks") - 1)

    def positives(block: Block, anchor: int, own: int, v: np.ndarray, _) -> Iterator[tuple]:
        twin = _twin(v.tobytes())
        for s, i in block.best(v, [(-(1 << 63), (1 << 63) - 1, n_positive)], without=anchor)[0]:
            yield anchor, own, twin, i, s

    def negatives(block: Block, anchor: int, own: int, v: np.ndarray, wins: list[dict]) -> Iterator[tuple]:
        twin = _twin(v.tobytes())
        windows = [(-(-low * w["score"] // 100), high * w["score"] // 100, n_negative) for w in wins]
        open_ones = [i for i, (least, most, _) in enumerate(windows) if least <= most]
        for place, found in zip(open_ones, block.best(v, [windows[i] for i in open_ones]) if open_ones else []):
            w = wins[place]
            for s, i in found:
                yield anchor, own, twin, place, w["id"], w["score"], i, s

    anchors = dealt.where(F.col("id") % every == 0).withColumn("own", F.col("label"))
    none = F.lit(None).cast("array<struct<score:bigint,id:bigint>>")
    near = _streamed(
        dealt, anchors.withColumn("block", F.explode(numbers)).withColumn("wins", none), positives, _fields(*_KEY, "id", "score"),
    )
    best = Window.partitionBy(*_KEY).orderBy(F.desc("score"), "id")
    wins = (
        near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n_positive)
        .groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("w"))
        .select(*_KEY, F.transform("w", lambda w: F.struct(w["score"], w["id"])).cast("array<struct<score:bigint,id:bigint>>").alias("wins"))
    )
    asking = (
        anchors.select("dim", "own", "id", "v", F.crc32("v").alias("twin"))
        .join(wins.select(F.col("anchor_id").alias("id"), F.col("label").alias("own"), "twin", "wins"), ["id", "own", "twin"])
        .withColumn("salt", F.pmod(F.xxhash64("id", "twin"), F.lit(_TARGET_SALTS)).cast("int"))
    )
    targets = blocks.select("dim", "label", F.explode(numbers).alias("block")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_TARGET_SALTS - 1))))
    sent = asking.join(targets, ["dim", "salt"]).where("own <> label")
    far = _streamed(dealt, sent, negatives, _fields(*_KEY, "place", "positive_id", "positive_score", "negative_id", "negative_score"))
    order = Window.partitionBy(*_KEY, "place").orderBy(F.desc("negative_score"), "negative_id")
    return (
        far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negative)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
