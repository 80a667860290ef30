"""Language-model scores from a log-frequency Bloom filter.

Base: unigram probabilities from exact counts. The `vocabulary` most frequent words
(a bounded number) go to the tasks with their counts and settle most tokens there;
the other tokens are joined with the count table by word, once per document and word.

Model: a bigram model over all words, by 64-bit hashes of the words themselves. Bigram
counts are quantised to 1 + floor(log2 c) and kept in a Bloom filter as that many
entries (bigram, level); a count is read back by probing level after level until one
misses. The filter is blocked: a bigram's code picks a group and, in it, a block of
BLOCK_BITS. Tasks count bigrams in runs of their texts and send each group its part as
two arrays; a group adds the parts up and builds its blocks on its own, with a number of
groups that keeps them to GROUP_GRAMS counted grams each. With Dirichlet smoothing
    P(w | p) = (c(p w) + MU * P(w)) / (c(p) + MU)
Word counts c(p) and those in P(w) are exact for the most frequent words and read from
a second filter, of all words, for the others. Begin and end marks frame a text.

The filters have BITS_PER_ENTRY bits for each entry, counted by group first, so about 1 % of
unseen grams read back as seen, at every size. The words' filter is broadcast. The
bigrams' filter is broadcast if it has at most `broadcast_bytes`; a larger one is cut
into shards of that size by block, and one pass per shard adds up the tokens whose
bigrams the shard would hold. Both ways give the same scores.

Defined results: NULL and empty texts are the end mark alone. With nothing to learn
from, every count is 0. Rows that repeat are scored alike, each on its own row. Rows
without a key are learnt from and aren't held out.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.session import cut
from plumbline.llm.common import map_batches, utf8

VOCABULARY = 200_000
BITS_PER_ENTRY = 10.0
BLOCK_BITS = 1 << 19
HASHES = 5
MU = 300.0
ADD = 0.1
BROADCAST_BYTES = 512 << 20
_BEGIN = 1
_BIT = np.array([128 >> i for i in range(8)], np.uint8)
_END = b"\n"  # holds a separator, so no word is the same
GROUP_GRAMS = 1 << 20
_FLUSH = 400_000
_GRAMS_AT_ONCE = 1_000_000
_TEXTS_AT_ONCE = 64
_WORDS_KEPT = 100_000


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(_END)
    return words


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, c) over the column t, counted per task before the shuffle."""

    def run(batches):
        counter: Counter[bytes] = Counter()
        for b in batches:
            for t in b["t"]:
                counter.update(tokens(t))
                if len(counter) > _FLUSH:
                    yield {"w": list(counter), "c": list(counter.values())}
                    counter = Counter()
        yield {"w": list(counter), "c": list(counter.values())}

    return map_batches(texts, run, "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


class Words:
    """The exact counts of the most frequent words, and the filter of all words' counts."""

    def __init__(self, head: dict[bytes, int], n: int, distinct: int, found: Blocks, bits: np.ndarray):
        self.head, self.texts = head, float(head.get(_END, 0))
        self.floor, self.blocks, self.bits = n + ADD * (distinct + 1), found, bits

    def known(self, names: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts, exact for the most frequent words and read from the filter for others, and which are of others."""
        counts = np.fromiter(map(self.head.get, names, repeat(-1)), np.float64, len(names))
        other = counts < 0
        counts[other] = read_counts(hashes[other], self.blocks.of(hashes[other]), self.bits)
        return counts, other


class Index(dict):
    """A number for each different word, and the words by number."""

    def __init__(self):
        self.names: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.names)
        self.names.append(word)
        return at

    def of(self, split: list[list[bytes]]) -> np.ndarray:
        """Each token's number."""
        return np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64)


def hashes_of(words: list[bytes]) -> np.ndarray:
    unsigned = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return (unsigned ^ np.uint64(1 << 63)).view(np.int64)


class Seen:
    """The words that a task has met: hash, count and logarithm of the base, each looked up once."""

    def __init__(self, own: Words):
        self.own, self.index = own, Index()
        self.hashes, self.counts = np.empty(0, np.int64), np.empty(0)
        self.other, self.base = np.empty(0, bool), np.empty(0)

    def of(self, split: list[list[bytes]]) -> np.ndarray:
        every = self.index.of(split)
        new = self.index.names[len(self.hashes) :]
        hashes = hashes_of(new)
        counts, other = self.own.known(new, hashes)
        self.hashes, self.counts = np.append(self.hashes, hashes), np.append(self.counts, counts)
        self.other = np.append(self.other, other)
        self.base = np.append(self.base, np.where(other, 0.0, np.log10((counts + ADD) / self.own.floor)))
        return every


def contexts(split: list[list[bytes]]) -> np.ndarray:
    """Where texts start among their tokens."""
    return np.concatenate(([0], np.cumsum([len(s) for s in split])[:-1])).astype(np.int64)


def bigrams(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit number for each token with its predecessor, from the words themselves; _BEGIN precedes a text."""
    prev = np.empty_like(hashes)
    prev[1:] = hashes[:-1]
    prev[starts] = _BEGIN
    return (_hashed(prev, 99) + hashes.astype(np.uint64)).astype(np.int64)


def _hashed(code: np.ndarray, salt: int) -> np.ndarray:
    x = code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (2 * salt + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def group_of(code: np.ndarray, groups: int) -> np.ndarray:
    """By the upper bits, so that codes sorted as unsigned numbers are sorted by group."""
    return (((code.view(np.uint64) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)


class Blocks:
    """Where a gram's block is: each group has its own number of blocks, one group's after another's."""

    def __init__(self, sizes: list[int]):
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.total = int(self.ends[-1])

    def of(self, code: np.ndarray) -> np.ndarray:
        group = group_of(code, len(self.sizes))
        return self.starts[group] + inside_group(code, self.sizes[group])


def inside_group(code: np.ndarray, size) -> np.ndarray:
    """A block's place among the `size` ones of its group."""
    return (_hashed(code, 0) % np.asarray(size, np.uint64)).astype(np.int64)


def places(code: np.ndarray, level: int) -> np.ndarray:
    """Bit places inside a block, a row of HASHES for the bigrams at a level."""
    h = _hashed(code, level)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h + np.arange(HASHES, dtype=np.uint64)[:, None] * step) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


def leveled(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different bigrams and the levels of their counts; a bigram may come in several parts."""
    order = np.argsort(code)
    code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))
    return code[first], np.frexp(np.add.reduceat(count.astype(np.float64), first))[1] if len(first) else np.empty(0, np.int32)


def bits_of(code: np.ndarray, level: np.ndarray) -> bytes:
    bits = np.zeros(BLOCK_BITS, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        bits[places(code[level >= q], q)] = 1
    return np.packbits(bits).tobytes()


def build_block(code: np.ndarray, count: np.ndarray) -> bytes:
    """The block's bits with all levels of its bigrams."""
    return bits_of(*leveled(code, count))


def read_counts(code: np.ndarray, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Counts from repeated probes; `at` is each bigram's block within `bits`."""
    level = np.zeros(len(code), np.int64)
    live, start, flat, q = np.arange(len(code)), at * bits.shape[1], bits.reshape(-1), 0
    while len(live):
        q += 1
        h = _hashed(code, q)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for _ in range(HASHES):
            place = (h & np.uint64(BLOCK_BITS - 1)).view(np.int64)
            hit = np.flatnonzero(flat[start + (place >> 3)] & _BIT[place & 7])
            if len(hit) < len(live):
                live, start, code, h, step = live[hit], start[hit], code[hit], h[hit], step[hit]
            h = h + step
        level[live] = q
    return np.where(level < 2, level, 1.4 * 2.0 ** (level - 1))


def parts_of(code: np.ndarray, count: np.ndarray, groups: int) -> dict[str, list]:
    """Grams and their counts as one row for each group; `code` is sorted as unsigned numbers."""
    group = group_of(code, groups)
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    ends = [*cuts[1:].tolist(), len(code)]
    count = count.astype(np.int64)
    return {
        "g": group[cuts], "code": [code[i:j].tobytes() for i, j in zip(cuts.tolist(), ends)],
        "n": [count[i:j].tobytes() for i, j in zip(cuts.tolist(), ends)],
    }


def bigram_counts(texts: DataFrame, groups: int) -> DataFrame:
    """(g, code, n) over the column t: arrays of bigrams and their counts, all bigrams."""

    def run(batches):
        held, size, index, hashes = [], 0, Index(), np.empty(0, np.int64)
        for b in batches:
            for at in range(0, len(b["t"]), _TEXTS_AT_ONCE):
                split = [tokens(t) for t in b["t"][at : at + _TEXTS_AT_ONCE]]
                every = index.of(split)
                hashes = np.append(hashes, hashes_of(index.names[len(hashes) :]))
                held.append(bigrams(hashes[every], contexts(split)))
                size += len(every)
                if len(index) > _WORDS_KEPT:
                    index, hashes = Index(), np.empty(0, np.int64)
                if size > _GRAMS_AT_ONCE:
                    yield parts_of(*np.unique(np.concatenate(held).view(np.uint64), return_counts=True), groups)
                    held, size = [], 0
        if held:
            yield parts_of(*np.unique(np.concatenate(held).view(np.uint64), return_counts=True), groups)

    return map_batches(texts, run, "g bigint, code binary, n binary")


def hashed_words(counts: DataFrame, groups: int) -> DataFrame:
    """(g, code, n) of the words in (w, c)."""

    def run(batches):
        for b in batches:
            code = hashes_of(b["w"]).view(np.uint64)
            order = np.argsort(code)
            yield parts_of(code[order], np.array(b["c"], np.int64)[order], groups)

    return map_batches(counts, run, "g bigint, code binary, n binary")


def groups_for(grams: int) -> int:
    return max(1, -(-grams // GROUP_GRAMS))


def build_filter(grams: DataFrame, bits_per_gram: float = 0.0) -> DataFrame:
    """(g, at, bits) of (g, code, n): a group's blocks, with BITS_PER_ENTRY bits for each entry, a level of a gram."""

    def build(t: pa.Table) -> pa.Table:
        code, n = (np.concatenate([np.frombuffer(v.as_py(), np.int64) for v in t[c]]) for c in ("code", "n"))
        code, level = leveled(code, n)
        size = max(1, int(-(-max(level.sum(dtype=np.int64) * BITS_PER_ENTRY, n.sum() * bits_per_gram) // BLOCK_BITS)))
        block = inside_group(code, size)
        bits = [bits_of(code[block == i], level[block == i]) for i in range(size)]
        return pa.table({"g": pa.array(np.full(size, t["g"][0].as_py())), "at": pa.array(np.arange(size)), "bits": pa.array(bits, pa.binary())})

    return grams.groupBy("g").applyInArrow(build, "g bigint, at bigint, bits binary")


def blocks_of(built: DataFrame, groups: int) -> Blocks:
    """A group without grams has one block, empty."""
    sizes = {r["g"]: r["count"] for r in built.groupBy("g").count().toLocalIterator()}
    return Blocks([sizes.get(g, 1) for g in range(groups)])


def _gathered(built: DataFrame, blocks: Blocks, low: int, size: int) -> np.ndarray:
    bits = np.zeros((size, BLOCK_BITS // 8), np.uint8)
    first, last = np.searchsorted(blocks.ends, [low, low + size - 1], side="right")
    for r in built.where(F.col("g").between(int(first), int(last))).toLocalIterator():
        at = int(blocks.starts[r["g"]]) + r["at"] - low
        if 0 <= at < size:
            bits[at] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _score_texts(texts: list[bytes], seen: Seen, low: int, bits: np.ndarray, blocks: Blocks):
    """Per text: tokens, known tokens and base score of the most frequent words, other words, and the shard's part of the score."""
    split = [tokens(t) for t in texts]
    every = seen.of(split)
    starts = contexts(split)
    code = bigrams(seen.hashes[every], starts)
    counts = seen.counts[every]
    context = np.empty(len(every))
    context[1:] = counts[:-1]
    context[starts] = seen.own.texts
    count = np.zeros(len(code))
    block = blocks.of(code) - low
    if len(bits) == blocks.total:
        count, mine = read_counts(code, block, bits), None
    else:
        mine = (block >= 0) & (block < len(bits))
        count[mine] = read_counts(code[mine], block[mine], bits)
    part = np.log10((np.minimum(count, context) + MU * (counts + ADD) / seen.own.floor) / (context + MU))
    if mine is not None:
        part[~mine] = 0.0
    other = seen.other[every]
    known = (~other & (counts > 0)).astype(np.int64)
    rare: list[Counter] = [Counter() for _ in texts]
    found = np.flatnonzero(other)
    names = seen.index.names
    for row, i in zip((np.searchsorted(starts, found, side="right") - 1).tolist(), every[found].tolist()):
        rare[row][names[i]] += 1
    sums = (np.add.reduceat(x, starts) for x in (known, seen.base[every], part))
    return [len(s) for s in split], *sums, rare


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY, bits_per_token: float = 0.0,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    The filter has at least `bits_per_token` bits for each training token.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), utf8(F.col(text)).alias("t"))
    training = rows.where(~is_held_out(F.col("k"))).select("t")
    counts = cut(word_counts(training))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, distinct = int(total["n"] or 0), int(total["v"])
    # at most `vocabulary` words, the end mark among them
    head = {bytes(r["w"]): r["c"] for r in counts.orderBy(F.col("w") != F.lit(_END), F.desc("c"), "w").limit(vocabulary).collect()}
    word_groups = groups_for(distinct)
    built = cut(build_filter(hashed_words(counts, word_groups)))
    found = blocks_of(built, word_groups)
    bits = _gathered(built, found, 0, found.total)
    words = spark.sparkContext.broadcast(Words(head, n, distinct, found, bits))
    del head, bits  # the broadcast has them
    groups = groups_for(n)
    built = cut(build_filter(bigram_counts(training, groups), bits_per_token))
    blocks = blocks_of(built, groups)
    per_pass = max(1, broadcast_bytes // (BLOCK_BITS // 8))
    scored, parts = None, []
    for low in range(0, blocks.total, per_pass):
        size = min(per_pass, blocks.total - low)
        bits = _gathered(built, blocks, low, size)  # at most broadcast_bytes
        shard = spark.sparkContext.broadcast(bits)
        if scored is None:
            scored = cut(_scored(rows, words, shard, low, blocks).withColumn("row", F.monotonically_increasing_id()))
        else:
            # the first pass's table holds no texts; later passes read them again, in the first one's rows
            parts.append(cut(_scored(rows, words, shard, low, blocks).groupBy("k", "h").agg(F.first("part").alias("part"))))
        shard.unpersist()
    for p in parts:
        same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2"))
        more = p.select(F.col("k").alias("k2"), F.col("h").alias("h2"), F.col("part").alias("more"))
        scored = scored.join(more, same, "left").withColumn("part", F.col("part") + F.col("more")).drop("k2", "h2", "more")
    floor = n + ADD * (distinct + 1)
    outside = scored.select("row", F.explode("others").alias("o")).select("row", "o.w", "o.n")
    found = outside.join(counts, "w", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + ADD) / floor)).alias("rest"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"),
    )
    return scored.drop("others").join(found, "row", "left").select(
        F.col("k").alias(key), is_held_out(F.col("k")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), F.col("part").alias("score"),
    )


def _scored(rows: DataFrame, words, shard, low: int, blocks: Blocks) -> DataFrame:
    def run(batches):
        seen = Seen(words.value)
        for b in batches:
            for at in range(0, len(b["t"]), _TEXTS_AT_ONCE):
                some = slice(at, at + _TEXTS_AT_ONCE)
                if len(seen.index) > _WORDS_KEPT:
                    seen = Seen(words.value)
                n_tokens, known, base, part, others = _score_texts(b["t"][some], seen, low, shard.value, blocks)
                yield {
                    "k": b["k"][some], "h": b["h"][some], "n_tokens": n_tokens, "known": known, "base": base, "part": part,
                    "others": [[{"w": w, "n": c} for w, c in o.items()] for o in others],
                }

    keyed = rows.select("k", F.xxhash64("t").alias("h"), "t")
    return map_batches(keyed, run, "k bigint, h bigint, n_tokens bigint, known bigint, base double, part double, others array<struct<w:binary,n:bigint>>")
