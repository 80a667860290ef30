"""Best-fit packing of tokenized documents with certified bin counts.

Documents become token ids (whole texts; words are encoded once per task and reused),
longer ones are cut into pieces of the capacity. Only piece lengths are packed:

1. pieces are dealt into groups of about `group_pieces`; each group is packed by
   best-fit decreasing, and dual feasible functions give a lower bound of its bins
   (the sum bound, Fekete and Schepers' threshold and rounding functions);
2. bins that are full stay. A group whose count equals its bound is certified and
   releases only its emptiest bin, the one that more pieces could still fill; a
   group with a gap releases its loosest bins as well (LOOSE of them for each bin of
   the gap). Released pieces of FAN_IN groups are exchanged into one and packed again;
3. this repeats until one group is left.

Later groups hold released bins only, so no task ever holds all pieces. Bins never grow
in number: a repacking that needs more than it got is dropped.

Defined results: NULL and empty texts are the closing id alone. Repeated rows are
packed each on its own. Ties in length go by row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.session import cut
from plumbline.llm.common import map_batches, utf8
from plumbline.llm.wordwise import WordTokenizer

CAPACITY = 2048
GROUP_PIECES = 100_000
FAN_IN = 8
LOOSE = 4


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the closing id."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        encode = _tokenizer(tokenizer).encode
        closing = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for k, ids in zip(b["k"], encode(b["t"])):
                ids += closing
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(out, (k, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[c].append(v)
            yield out

    return map_batches(docs.select(F.col(key).alias("k"), utf8(F.col(text)).alias("t")), run,
                       "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, each into the bin with the least room that takes it.

    Open bins are kept by room left; a bit per room finds the least fitting one.
    """
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        above = mask >> size
        if above:
            room = size + ((above & -above).bit_length() - 1)
            at = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, at, n = capacity, n, n + 1
        bins[i], offsets[i] = at, capacity - room
        left = room - size
        if left:
            open_bins[left].append(at)
            mask |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most bins that one of the dual feasible functions proves necessary."""
    if not len(lengths):
        return 0
    size, count = np.unique(lengths, return_counts=True)
    best = -(-int((size * count).sum()) // capacity)
    total = np.cumsum((size * count)[::-1])[::-1]
    number = np.cumsum(count[::-1])[::-1]
    for e in size[size <= capacity // 2].tolist():
        # threshold function: over capacity - e counts as a whole bin, under e as nothing
        big = np.searchsorted(size, capacity - e, side="right")
        low = np.searchsorted(size, e)
        whole = int(number[big]) if big < len(size) else 0
        middle = int(total[low]) - (int(total[big]) if big < len(size) else 0)
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 12):
        # rounding function: (k + 1) x a whole number of capacities stays, else floor((k + 1) x / capacity) / k
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


_PACKED = pa.schema([
    ("id", pa.int64()), ("length", pa.int64()), ("grp", pa.int64()), ("bin", pa.int64()), ("off", pa.int64()),
    ("loose", pa.bool_()), ("bins", pa.int64()), ("bound", pa.int64()),
])
_PACKED_SQL = "id bigint, length bigint, grp bigint, bin bigint, off bigint, loose boolean, bins bigint, bound bigint"


def _pack_groups(rows: DataFrame, capacity: int) -> DataFrame:
    """Packs each group of (id, length, grp, was): `was` names the bin that a piece comes from."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("id", "ascending")])
        length, grp = t["length"].to_numpy(), t["grp"][0].as_py()
        bins, offsets = best_fit_decreasing(length, capacity)
        n, bound = int(bins.max()) + 1, lower_bound(length, capacity)
        was = t["was"].to_numpy()
        if (was >= 0).all() and n > len(np.unique(was)):  # no gain: as it came
            _, bins = np.unique(was, return_inverse=True)
            order = np.argsort(bins, kind="stable")
            sums = np.cumsum(length[order]) - length[order]
            starts = np.searchsorted(bins[order], np.arange(bins.max() + 1))
            offsets = np.empty(len(bins), np.int64)
            offsets[order] = sums - sums[starts][bins[order]]
            n = int(bins.max()) + 1
        free = capacity - np.bincount(bins, weights=length, minlength=n)
        released = np.argsort(-free, kind="stable")[: 1 + LOOSE * (n - bound)]
        loose = np.zeros(n, bool)
        loose[released] = free[released] > 0
        return pa.table({
            "id": t["id"], "length": length, "grp": np.full(len(length), grp), "bin": bins, "off": offsets, "loose": loose[bins],
            "bins": np.full(len(length), n), "bound": np.full(len(length), bound),
        }, schema=_PACKED)

    return rows.groupBy("grp").applyInArrow(run, _PACKED_SQL)


def pack(found: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`found` (as from `pieces`, a stored table) with sequence_id, offset, and its group's bins and bound."""
    stored = cut(found.withColumn("id", F.monotonically_increasing_id()))
    n = stored.count()
    groups = max(1, -(-n // group_pieces))
    rows = stored.select("id", "length", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("grp"), F.lit(-1).cast("bigint").alias("was"))
    settled: list[DataFrame] = []
    level = 0
    while True:
        packed = cut(_pack_groups(rows, capacity))
        name = (F.col("bin") * groups + F.col("grp")) * 64 + level  # of no other bin in any round
        if groups == 1:
            settled.append(packed.select("id", name.alias("sequence_id"), F.col("off").alias("offset")))
            break
        settled.append(packed.where("not loose").select("id", name.alias("sequence_id"), F.col("off").alias("offset")))
        groups, level = -(-groups // FAN_IN), level + 1
        rows = packed.where("loose").select("id", "length", F.pmod(F.col("grp"), F.lit(groups)).alias("grp"), name.alias("was"))
    placed = settled[0]
    for s in settled[1:]:
        placed = placed.unionByName(s)
    return stored.join(placed, "id").drop("id")


def pack_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    return pack(pieces(docs, tokenizer, key, text, capacity, end_id), capacity, group_pieces)
