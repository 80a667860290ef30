"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of the hashed vectors of the word itself and of its
character n-grams (with word boundary marks); a document's vector is the mean of its
words' vectors; a softmax layer on top gives the class. Both layers are trained by
plain numpy stochastic gradient descent on a bounded sample of labelled rows: at most
`sample` rows of each class, those with the least hash of key and text. All else is
one pass: tasks get the model (two arrays of fixed size) and score whole texts. As the
output layer is linear, a distinct word's share of it is computed once and reused.

The class balance of the sample is undone by the ratio of all labelled rows.

Defined results: texts without words have the score of the label prior. Rows that
repeat are scored alike. Labels other than 0 and 1, or of unknown rows, aren't used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import add, eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, utf8

BUCKETS = 1 << 17
DIMENSION = 8
SIZES = (3, 4, 5)
SAMPLE = 1500
EPOCHS = 4
RATE = 0.5
SEED = 17
STEP = 16
THRESHOLD = 0.3
_CACHED_WORDS = 500_000
_TEXTS_AT_ONCE, _WORDS_AT_ONCE = 256, 50_000
AGAIN = b"\0"


def subwords(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Cells of the word and of its character n-grams; < and > mark its ends."""
    marked = b"<" + word + b">"
    # bytes of plain ASCII are its characters
    whole = marked if word.isascii() else marked.decode("utf-8", "replace")
    grams = {whole, *(whole[i : i + n] for n in SIZES for i in range(len(whole) - n + 1))}
    return sorted({zlib.crc32(g if isinstance(g, bytes) else g.encode("utf-8", "replace")) % buckets for g in grams})


def stream(text: bytes) -> list[bytes]:
    """The text's words; one that repeats the word before is AGAIN, so that stutter is alike in all words."""
    words = text.split()
    if True not in map(eq, words, words[1:]):
        return words
    return [AGAIN if w == before else w for before, w in zip([b"", *words], words)]


def cells_at_once(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(cells, ends): the subwords of each of some ASCII words in turn, and where each word's end; as `subwords` has them.

    The CRC of an n-gram goes on from that of the n-1 characters before its last one, at all places at once.
    """
    marked = [b"<" + w + b">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    letters = np.frombuffer(b"".join(marked), np.uint8)
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))  # letters from here to the word's end
    found = [np.fromiter(map(zlib.crc32, marked), np.uint32, len(marked)).astype(np.int64) % buckets + np.arange(len(marked)) * buckets]
    crc = np.full(len(letters), 0xFFFFFFFF, np.uint32)
    for k in range(max(SIZES)):
        n = len(letters) - k
        crc = _CRC[(crc[:n] ^ letters[k:]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
        if k + 1 in SIZES:
            inside = left[:n] > k
            found.append((~crc[inside]).astype(np.int64) % buckets + owner[:n][inside] * buckets)
    both = np.unique(np.concatenate(found))
    return both % buckets, np.searchsorted(both // buckets, np.arange(len(marked)), "right")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


@dataclass
class Model:
    """Vectors by cell, the two classes' weights, and the log odds of the prior."""

    vectors: np.ndarray
    weights: np.ndarray
    prior: float
    shift: float

    def __post_init__(self):
        self.shares: dict[bytes, float] = {}
        #: each cell's part in the difference of the two classes' outputs
        self.outputs = self.vectors.astype(np.float64) @ (self.weights[1] - self.weights[0]).astype(np.float64)
        self.cells = self.outputs.tolist()

    def share(self, word: bytes) -> float:
        """The word's part in the difference of the two classes' outputs."""
        if word not in self.shares:
            own = subwords(word, len(self.cells))
            self.shares[word] = sum(self.cells[c] for c in own) / len(own)
        return self.shares[word]

    def learn(self, words: Iterable[bytes]) -> None:
        """Shares of new words, those of ASCII all at once."""
        plain = []
        for w in words:
            if w.isascii():
                plain.append(w)
            else:
                self.share(w)
        for at in range(0, len(plain), _WORDS_AT_ONCE):
            some = plain[at : at + _WORDS_AT_ONCE]
            cells, ends = cells_at_once(some, len(self.cells))
            starts = np.concatenate(([0], ends[:-1]))
            self.shares.update(zip(some, (np.add.reduceat(self.outputs[cells], starts) / (ends - starts)).tolist()))

    def scores(self, texts: list[bytes]) -> list[float]:
        """The score of each text."""
        out = []
        for at in range(0, len(texts), _TEXTS_AT_ONCE):
            split = list(map(stream, texts[at : at + _TEXTS_AT_ONCE]))
            if len(self.shares) >= _CACHED_WORDS:
                self.shares.clear()
            self.learn(set().union(*split).difference(self.shares))
            known = self.shares.__getitem__
            out += [reduce(add, map(known, words)) / len(words) + self.shift if words else self.prior for words in split]
        return (1.0 / (1.0 + np.exp(-np.clip(np.array(out, float), -60, 60)))).tolist()

    def score(self, text: bytes) -> float:
        return self.scores([text])[0]


def train(texts: list[bytes], labels: list[int], prior: float, buckets: int = BUCKETS, dimension: int = DIMENSION, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Stochastic gradient descent over documents, the rate falling to nothing. prior: log odds of class 1 among all rows."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / dimension, 1 / dimension, (buckets, dimension)).astype(np.float32)
    weights = np.zeros((2, dimension), np.float32)
    cells: dict[bytes, np.ndarray] = {}
    rows = []
    for text, label in zip(texts, labels):
        words = stream(text)
        if not words:
            continue
        for w in words:
            if w not in cells:
                cells[w] = np.array(subwords(w, buckets), np.int64)
        own = [cells[w] for w in words]
        at, where = np.unique(np.concatenate(own), return_inverse=True)
        each = np.repeat([1.0 / (len(words) * len(c)) for c in own], [len(c) for c in own])
        rows.append((at, np.bincount(where, weights=each).astype(np.float32), label))
    steps, total = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, share, label = rows[i]
            lr = rate * (1 - steps / total)
            steps += 1
            hidden = share @ vectors[at]
            out = weights @ hidden
            p = np.exp(out - out.max())
            p /= p.sum()
            p[label] -= 1.0
            gradient = weights.T @ p
            weights -= lr * np.outer(p, hidden)
            # a mean's gradient is small in every cell; the step is scaled by their number, up to a bound
            vectors[at] -= (lr * min(len(at), STEP)) * np.outer(share, gradient)
    positive = sum(r[2] for r in rows)
    sampled = np.log(max(positive, 0.5) / max(len(rows) - positive, 0.5))
    return Model(vectors, weights, prior, prior - float(sampled))


def is_held_out(key: Column, folds: int = 5) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, folds: int = 5) -> Model:
    """Learns from the labelled rows that aren't held out; at most `sample` rows of a class reach the driver."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and k is not null")
    known = known.where(~is_held_out(F.col("k"), folds)).groupBy("k").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)))
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])  # at most 2 * sample rows
    rows = (
        docs.select(F.col(key).alias("k"), utf8(F.col(text)).alias("t")).join(F.broadcast(ids), "k")
        .orderBy(F.xxhash64("k"), "k", "t").limit(2 * sample).collect()
    )
    return train([bytes(r["t"]) for r in rows], [r["y"] for r in rows], prior)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """(key, held_out, score, predicted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vectors, model.weights, model.prior, model.shift))

    def run(batches):
        own = Model(*shared.value)
        for b in batches:
            yield {"k": b["k"], "score": own.scores(b["t"])}

    out = map_batches(docs.select(F.col(key).alias("k"), utf8(F.col(text)).alias("t")), run, "k bigint, score double")
    return out.select(
        F.col("k").alias(key), F.coalesce(is_held_out(F.col("k"), folds), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
