"""Near-duplicate documents by SetSketch registers.

A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets
are one class (a 128-bit fingerprint of the set); all later work is on classes, so
copies cost one row each. A class has M SetSketch registers: register i is
floor(1 - log_B(least of element values)) for exponentially spaced values, cut to
16 bits. Registers merge by maximum and two sets share a register with a probability
close to their Jaccard similarity, so bands of ROWS equal registers find candidates:
all 56 bands of 6 miss a pair of similarity 0.80 with probability 4e-8, one of 0.85 with 3e-12.

Buckets are never expanded into all pairs:
1. every class is compared with one class only, the most central among those that
   share a bucket with it (most central: the largest sum of its buckets' sizes);
2. verified links give components; only buckets that still hold several components
   go on. There each member outside the bucket's largest component is compared with
   the likeliest of two members per bucket, one of that component and one of the
   others, drawn anew in each round, as long as rounds bring members in;
3. what is still outside is compared with all members of other components, each pair
   in its first common bucket only. Pairs inside a component can't change it.
A pair goes on if the registers' likelihood leaves the similarity possible: in 1 the
joint likelihood of the counts of larger, smaller and equal registers given both
sizes, in 2 and 3 that of the count of equal ones (three bits of each), a condition of
the join itself. Registers can't tell pairs a little below the similarity from those
above it, and a group of such texts has the square of its size of them: in 3 the
condition goes on to the sets, 32 bits of each shingle, so that only pairs that are
links (or would be but for such a collision) become rows. What is left is confirmed
on the full sets.

Defined results: texts without words have an empty set, link with nothing and are
their own component. A NULL doc_id never names a component unless all its members
have none. Rows that repeat a doc_id stay or go together.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.session import cut
from plumbline.llm.common import map_batches, utf8
from plumbline.llm.graph import components

BANDS, ROWS = 56, 6
M = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 65535
#: bit planes of register bits, and 64-bit words of each
PLANES, WORDS = 3, -(-M // 64)
#: Stars are drawn while they bring members into their bucket's top: rounds at most, and the share of members outside it from which on they stop.
STAR_ROUNDS = 8
STAR_GAIN = 0.9
#: Log-likelihood by which "below the similarity" must beat it for a pair to be dropped unseen: a chance of about e^-20.
MARGIN = 20.0
_CACHED_WORDS = 150_000
_ODD = (np.random.default_rng(7).integers(1, 2**32, M, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    """64-bit hashes of words, computed once for each word while it is kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = WordHashes()


def _mixed(x: np.ndarray, k: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * k
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle of all its words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    x = np.full(n, width, np.uint64)
    for k in range(width):
        x = _mixed(x + h[k : k + n], _K1)
    return np.unique(x)


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes."""
    low = np.full(M, 0xFFFFFFFF, np.uint32)
    short = (_mixed(items, _K3) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(low, np.multiply.outer(short[at : at + 512], _ODD).min(axis=0), out=low)
    value = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1.0 - np.log(value) / np.log(BASE)), 0, LIMIT).astype("<u2")


def fingerprint(items: np.ndarray) -> bytes:
    return np.array([_mixed(items, _K2).sum(), _mixed(items + _K3, _K1).sum()], "<u8").tobytes()


def sketch(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(k, h, n_shingles, c, sketch) for every row, h a hash of the text; c and sketch are NULL for empty sets."""

    def run(batches):
        for b in batches:
            sets = [shingles(t, size) for t in b["t"]]
            yield {
                "k": b["k"], "h": b["h"], "n_shingles": [len(s) for s in sets],
                "c": [fingerprint(s) if len(s) else None for s in sets],
                "sketch": [registers(s).tobytes() if len(s) else None for s in sets],
            }

    keyed = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), utf8(F.col(text)).alias("t"))
    return map_batches(keyed, run, "k bigint, h bigint, n_shingles bigint, c binary, sketch binary")


def _bucket(raw: bytes, band: int) -> int:
    return xxhash.xxh64_intdigest(raw[2 * ROWS * band : 2 * ROWS * (band + 1)], seed=band) - (1 << 63)


def bands(classes: DataFrame) -> DataFrame:
    """(bucket, band, c): a row for each class and band."""

    def run(batches):
        for b in batches:
            yield {
                "bucket": [_bucket(raw, k) for raw in b["sketch"] for k in range(BANDS)], "band": [*range(BANDS)] * len(b["c"]),
                "c": [c for c in b["c"] for _ in range(BANDS)],
            }

    return map_batches(classes.select("c", "sketch"), run, "bucket bigint, band int, c binary")


def signs(classes: DataFrame) -> DataFrame:
    """(c, n, bits, keys): three bits of each register in PLANES bit planes, and 32 bits of each bucket."""

    def run(batches):
        for b in batches:
            bits, keys = [], []
            for raw in b["sketch"]:
                mixed = np.frombuffer(raw, "<u2") * np.uint16(0x9E37) >> np.uint16(13)
                planes = np.zeros((PLANES, 64 * WORDS), np.uint8)
                planes[:, :M] = (mixed >> np.arange(PLANES, dtype=np.uint16)[:, None]) & np.uint16(1)
                bits.append(np.packbits(planes, axis=1).view(">i8").ravel().tolist())
                keys.append([(_bucket(raw, k) & 0xFFFFFFFF) - (1 << 31) for k in range(BANDS)])
            yield {"c": b["c"], "n": b["n"], "bits": bits, "keys": keys}

    return map_batches(classes.select("c", "n", "sketch"), run, "c binary, n bigint, bits array<bigint>, keys array<int>")


def equal_registers(x: Column, y: Column) -> Column:
    """How many registers agree in their bits."""
    total = F.lit(M - 64 * WORDS)
    for w in range(WORDS):
        differ = [F.get(x, F.lit(p * WORDS + w)).bitwiseXOR(F.get(y, F.lit(p * WORDS + w))) for p in range(PLANES)]
        total = total + F.bit_count(F.bitwise_not(differ[0].bitwiseOR(differ[1]).bitwiseOR(differ[2])))
    return total


def fewest_equal(percent: int) -> float:
    """Equal registers that a pair of the least similarity has but for a chance of 2e-8."""
    p = percent / 100 + (1 - percent / 100) / 2**PLANES
    return M * p - 5.5 * (M * p * (1 - p)) ** 0.5


def _possible(x: str, y: str, percent: int) -> Column:
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (equal_registers(F.col(f"{x}.bits"), F.col(f"{y}.bits")) >= fewest_equal(percent))


def low_bits(texts: DataFrame, size: int) -> DataFrame:
    """(c, items, lost): 32 bits of each shingle of (c, t), and how many of these coincide inside the set."""

    def run(batches):
        for b in batches:
            sets = [shingles(t, size) for t in b["t"]]
            low = [np.unique(s.astype(np.uint32)) for s in sets]
            yield {"c": b["c"], "items": [x.view(np.int32).tolist() for x in low], "lost": [len(s) - len(x) for s, x in zip(sets, low)]}

    return map_batches(texts.select("c", "t"), run, "c binary, items array<int>, lost int")


def _similar(x: str, y: str, percent: int) -> Column:
    """Whether the sets reach the similarity if all their coinciding bits are common shingles: never false for a link."""
    both = F.size(F.array_intersect(f"{x}.items", f"{y}.items")) + F.least(f"{x}.lost", f"{y}.lost")
    # the union is both sizes less the intersection, which is so computed once
    return (100 + percent) * both >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def likely(n_a: np.ndarray, n_b: np.ndarray, larger: np.ndarray, smaller: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the registers leave a similarity of `threshold` or more possible.

    larger, smaller: how many registers of a are above and below those of b.
    """
    equal = M - larger - smaller
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    most = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = np.maximum(p(u - v * j), 1e-9), np.maximum(p(v - u * j), 1e-9)
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-9))

    at = likelihood(np.minimum(threshold, most))
    best = np.max([likelihood(np.minimum(g, most)) for g in np.linspace(0.0, threshold, 40)], axis=0)
    return (most >= threshold - 1e-9) & (best - at <= MARGIN)


def likely_pairs(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that the likelihood-ratio test leaves."""

    def run(batches):
        for b in batches:
            if not b["a"]:
                continue
            x = np.frombuffer(b"".join(b["sa"]), "<u2").reshape(-1, M)
            y = np.frombuffer(b"".join(b["sb"]), "<u2").reshape(-1, M)
            ok = likely(np.array(b["na"], float), np.array(b["nb"], float), (x > y).sum(1), (x < y).sum(1), threshold)
            yield {"a": [v for v, k in zip(b["a"], ok) if k], "b": [v for v, k in zip(b["b"], ok) if k]}

    def side(s: str) -> DataFrame:
        return classes.select(F.col("c").alias(s), F.col("sketch").alias(f"s{s}"), F.col("n").alias(f"n{s}"))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb")
    return map_batches(joined, run, "a binary, b binary")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        seen: dict[bytes, np.ndarray] = {}

        def of(c: bytes, t: bytes) -> np.ndarray:
            if c not in seen:
                if len(seen) >= 64:
                    seen.clear()
                seen[c] = shingles(t, size)
            return seen[c]

        for b in batches:
            keep = []
            for a, c, ta, tb in zip(b["a"], b["b"], b["ta"], b["tb"]):
                x, y = of(a, ta), of(c, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield {"u": [a for a, k in zip(b["a"], keep) if k], "v": [c for c, k in zip(b["b"], keep) if k]}

    involved = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    texts = cut(texts.join(involved, "c", "left_semi").dropDuplicates(["c"]))
    joined = (
        pairs.join(texts.select(F.col("c").alias("a"), F.col("t").alias("ta")), "a")
        .join(texts.select(F.col("c").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")
    )
    return map_batches(joined, run, "u binary, v binary")


def _mixed_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, band, c, root, top) of the members of buckets with several components; top is the largest."""
    placed = cut(
        members.join(roots.withColumnRenamed("node", "c"), "c", "left").select("bucket", "band", "c", F.coalesce("root", "c").alias("root"))
    )
    largest = (
        placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        .groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
        .select("bucket", F.col("top.root").alias("top"))
    )
    return cut(placed.join(largest, "bucket"))


def _likeliest(mixed: DataFrame, signed: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): for each member outside its bucket's top, the likeliest of two members of other components of each bucket.

    One is of the top, one of the others; each turn draws them anew.
    """
    drawn = F.struct(F.xxhash64("c", F.lit(turn)), "c", "root")
    chosen = mixed.groupBy("bucket", (F.col("root") == F.col("top")).alias("of_top")).agg(F.max(drawn).alias("y")).select(
        "bucket", F.col("y.c").alias("yc"), F.col("y.root").alias("yroot")
    )
    outside = mixed.where("root <> top").select("bucket", "c", "root")
    x = outside.join(chosen, "bucket").where("root <> yroot").select("c", "yc").distinct().join(signed, "c").alias("x")
    y = signed.withColumnRenamed("c", "yc").alias("y")
    equal = equal_registers(F.col("x.bits"), F.col("y.bits"))
    best = x.join(y, (F.col("x.yc") == F.col("y.yc")) & _possible("x", "y", percent)).groupBy("x.c").agg(F.max(F.struct(equal, "y.yc")).alias("m"))
    return best.select(F.col("m.yc").alias("a"), F.col("c").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of `docs`."""
    rows = cut(sketch(docs, key, text, size))
    # registers and sizes are functions of the set, so any row of a class has them
    classes = cut(rows.where("c is not null").groupBy("c").agg(
        F.min("k").alias("least"), F.min(F.struct("k", "h")).alias("row"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
    ))
    banded = bands(classes)
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(banded.join(shared, "bucket"))  # (bucket, band, c, size)
    central = members.groupBy("c").agg(F.sum("size").alias("s"))
    ranked = cut(members.join(central, "c").select("bucket", "c", "s"))
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("s", "c")).alias("p"))
    first = cut(
        ranked.join(pivots, "bucket").where("c <> p.c").groupBy("c").agg(F.max("p").alias("p"))
        .select(F.col("p.c").alias("a"), F.col("c").alias("b"))
    )
    bucketed = classes.join(members.select("c").distinct(), "c", "left_semi")
    texts = cut(
        docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), utf8(F.col(text)).alias("t"))
        .join(bucketed.select("c", "row"), F.col("k").eqNullSafe(F.col("row.k")) & (F.col("h") == F.col("row.h"))).select("c", "t")
    )
    links = cut(confirm(cut(likely_pairs(first, classes, percent / 100)), texts, size, percent))
    signed = cut(signs(bucketed))
    mixed = _mixed_buckets(members, components(links))
    outside = mixed.where("root <> top").count()
    for turn in range(STAR_ROUNDS):
        tried = cut(_likeliest(mixed, signed, percent, turn))
        links = cut(links.unionByName(confirm(tried, texts, size, percent)))
        mixed = _mixed_buckets(members, components(links))
        before, outside = outside, mixed.where("root <> top").count()
        if outside > STAR_GAIN * before:
            break
    involved = texts.join(mixed.select("c").distinct(), "c", "left_semi").dropDuplicates(["c"])
    compared = mixed.join(signed.join(cut(low_bits(involved, size)), "c"), "c")
    x, y = compared.where("root <> top").alias("x"), compared.alias("y")
    earlier = F.exists(
        F.zip_with(F.slice("x.keys", F.lit(1), F.col("x.band")), F.slice("y.keys", F.lit(1), F.col("x.band")), lambda a, b: a == b), lambda e: e,
    )
    rest = cut(
        x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root"))
               & ((F.col("y.root") == F.col("y.top")) | (F.col("x.c") < F.col("y.c"))) & _possible("x", "y", percent) & ~earlier & _similar("x", "y", percent))
        .select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
    )
    roots = components(links.unionByName(confirm(rest, texts, size, percent)))
    rooted = cut(
        classes.select("c", "least").join(roots.withColumnRenamed("node", "c"), "c", "left")
        .select("c", "least", F.coalesce("root", "c").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("c", "component_id")
    out = rows.drop("sketch", "h").join(named, "c", "left").withColumn("component_id", F.coalesce("component_id", "k"))
    return out.select(F.col("k").alias(key), "n_shingles", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))
