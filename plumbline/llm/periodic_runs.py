"""Periodic runs in word sequences by an online sparse diagonal DP.

A run is a stretch of consecutive words with smallest period q and at least
max(least, times * q) words that no neighbouring word extends. On the diagonal of lag q
(words i and i - q) it shows as length - q matches in a row. Word by word, the earlier
occurrences of a word increment the match lengths of their lags; a diagonal that ends
long enough emits its run at once.

Frequent words have so many earlier occurrences that following all of them would be
quadratic. A diagonal of lag q must reach (times - 1) * q matches to count, so an
occurrence is followed only where the k words up to it agree as well, k being the first
of k0, 2 * k0, 4 * k0, ... that is not below q; the diagonal then starts with k matches.
Among the occurrences in the same k words, only the latest can be a run's lag: one nearer
than q would, by Fine and Wilf, give the run a smaller period. So each word is visited
once for each k, no lag is opened that isn't a smallest period, and nothing is missed.
Agreement of k words comes from names of word windows, doubled from level to level;
windows that occur once in their text are left out, so the levels stay sparse.

Texts are worked in their own rows, in chunks of bounded words; nothing is shuffled.

Defined results: NULL, empty and blank texts have no words and no runs, their collapsed
text is empty. Repeated rows are judged alike. Other columns pass through; one that
clashes with a result column is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import add_columns, utf8

LEAST = 24
TIMES = 3
#: Texts are worked together up to so many words; a longer text alone.
_CHUNK_WORDS = 400_000

Run = tuple[int, int, int]


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys occur more than once, and numbers for those, equal for equal keys."""
    _, name, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[name] > 1)
    return again, name[again]


def _wider(at: np.ndarray, name: np.ndarray, shift: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `at` joined with those `shift` words on: where they start and their names, if they occur again."""
    index = np.full(total + shift + 1, -1)
    index[at] = np.arange(len(at))
    other = index[at + shift]
    both = np.flatnonzero(other >= 0)
    again, names = _named(name[both] * np.int64(len(at) + 1) + name[other[both]])
    return at[both[again]], names


def _followed(words: np.ndarray, least: int, times: int, longest: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """By level k: words (by the end of their k-word context) that have an earlier occurrence to follow, its lag, and k."""
    first = least * (times - 1) // times
    again, name = _named(words)
    at, size = again, 1
    while size < first and len(at):
        shift = min(size, first - size)
        at, name = _wider(at, name, shift, len(words))
        size += shift
    out, above = [], 0
    while len(at) and times * (above + 1) <= longest:
        order = np.argsort(name, kind="stable")
        same = np.flatnonzero(name[order[1:]] == name[order[:-1]])
        later, earlier = at[order[same + 1]], at[order[same]]
        lag = later - earlier
        use = (lag > above) & (lag <= size)
        out.append((later[use] + size - 1, lag[use], size))
        at, name = _wider(at, name, size, len(words))
        above, size = size, 2 * size
    return out


def find_runs(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """For each text its runs (start, length, period), by start, then period."""
    if times < 3:
        raise ValueError("the context rule needs times >= 3")
    ids: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    text_of = np.repeat(np.arange(len(texts)), sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    # a word is a word of its text, so that no window occurs in two texts or across their border
    found = _followed(text_of * np.int64(len(ids) + 1) + flat, least, times, int(sizes.max(initial=0)))
    runs: list[list[Run]] = [[] for _ in texts]
    if not found:
        return runs
    end, lag = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    context = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
    order = np.argsort(end, kind="stable")
    active: dict[int, tuple[int, int]] = {}

    def emit(q: int, last: int, matches: int) -> None:
        length = matches + q
        if length >= max(least, times * q):
            text = int(text_of[last])
            runs[text].append((last + 1 - length - int(starts[text]), length, q))

    for i, q, k in zip(end[order].tolist(), lag[order].tolist(), context[order].tolist()):
        last, matches = active.get(q, (-1, 0))
        if last == i - 1 and matches:
            active[q] = (i, matches + 1)
        else:
            if matches:
                emit(q, last, matches)
            active[q] = (i, k)
    for q, (last, matches) in active.items():
        emit(q, last, matches)
    for r in runs:
        r.sort(key=lambda x: (x[0], x[2]))
    return runs


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept.tolist()) if k)


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Every row of `docs` with n_words, runs (by start, then period) and collapsed (the text with runs cut to one period)."""

    def judged(chunk: list[list[bytes]], out: dict[str, list]) -> None:
        for words, runs in zip(chunk, find_runs(chunk, least, times)):
            out["n_words"].append(len(words))
            out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            out["collapsed"].append(collapsed(words, runs).decode())

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"n_words": [], "runs": [], "collapsed": []}
        chunk: list[list[bytes]] = []
        held = 0
        for raw in b["t"]:
            words = raw.split()
            if chunk and held + len(words) > _CHUNK_WORDS:
                judged(chunk, out)
                chunk, held = [], 0
            chunk.append(words)
            held += len(words)
        judged(chunk, out)
        return out

    schema = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return add_columns(docs, run, schema, utf8(F.col(text)).alias("t"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones. NULL without runs."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def written(runs: Column) -> Column:
    """A line `start,length,period` for each run."""
    parts = ("start", "length", "period")
    line = lambda r: F.concat(F.concat_ws(",", *[r[p].cast("string") for p in parts]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
