"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items are normalised to word ids and put into one automaton per block of at most
`block_words` item words; blocks bound what is broadcast, however many items there
are. Documents are streamed through it: the automaton's state after a word is the
longest suffix of the words so far that some item contains. Where that length
reaches the window (or a whole shorter item ends), the matched words are hit.

Only runs of words that items know can match, so the walk starts anew at each
unknown word and runs shorter than the shortest window are skipped.

Defined results: NULL and empty texts have no words and no hits. Items without words
match nothing. Items with equal texts all count. Repeated rows are judged alike.
Other columns pass through; a clashing one is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import add_columns, utf8

WINDOW = 10
BLOCK_WORDS = 200_000

#: Bytes to lower-case bytes; what is neither an ASCII letter or digit nor part of a longer character is a blank.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences, with what each match ends."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[int]] = []
        self.names = [name for name, _ in items]
        for _, item in items:
            at, path = 0, []
            for w in item:
                at = self._extend(at, self.ids.setdefault(w, len(self.ids)))
                path.append(at)
            ends.append(path)
        self._mark([len(item) for _, item in items], ends)

    def _extend(self, last: int, c: int) -> int:
        """The state of the sequence that `last` spells, and c."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(-1)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The part of q's strings that p and c reach, as a state of its own."""
        part = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[part], self.link[q] = self.link[q], part
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = part
            p = self.link[p]
        return part

    def _mark(self, sizes: list[int], ends: list[list[int]]) -> None:
        """By state: the items that hold its longest string of WINDOW words or, if short, are that string."""
        held: list[set[int]] = [set() for _ in self.link]
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for item, path in enumerate(ends):
            for state in path:
                held[state].add(item)
            if 0 < sizes[item] < self.window:
                self.whole[path[-1]].append((sizes[item], item))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            held[self.link[state]] |= held[state]
        self.held = [tuple(h) if n >= self.window else () for h, n in zip(held, self.length)]
        #: nearest state on the chain of suffixes, itself included, that is a whole short item
        self.short = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[state] = state if self.whole[state] else self.short[self.link[state]]
        self.least = min([self.window, *(n for n in sizes if n)])

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [start, end) of words, which may overlap, and the numbers of the items found."""
        known = np.fromiter(map(self.ids.get, text, repeat(-1)), np.int64, len(text))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= self.least:
                self._walk(known[start:end].tolist(), start, spans, found)
        return spans, found

    def _walk(self, run: list[int], offset: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        follow, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i, c in enumerate(run, offset + 1):
            while c not in follow[state]:
                state = link[state]
                matched = length[state]
            state = follow[state][c]
            matched += 1
            if matched >= window:
                spans.append((i - matched, i))
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found.update(self.held[at])
            at = self.short[state]
            if at == state and matched < length[at]:
                at = self.short[link[at]]
            while at > 0:
                for n, item in self.whole[at]:
                    spans.append((i - n, i))
                    found.add(item)
                at = self.short[link[at]]


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, key: str, text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as words, in lists of at most block_words words (or one item), block by block."""
    block: list[tuple[str, list[bytes]]] = []
    total = 0
    for row in items.select(F.col(key).cast("string").alias("k"), utf8(F.col(text)).alias("t")).toLocalIterator():
        item = words(bytes(row["t"]))
        if not item:
            continue
        if block and total + len(item) > block_words:
            yield block
            block, total = [], 0
        block.append((row["k"], item))
        total += len(item)
    if block:
        yield block


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Every row of `docs` with n_words, hit_spans (merged word spans, end exclusive), n_hit and item_ids (those found, sorted as strings)."""
    blocks = _blocks(items, item_key, item_text, block_words)
    names = [c for c in docs.columns if c not in ("n_words", "hit_spans", "n_hit", "item_ids")]
    out = _scanned(docs.select(*names), next(blocks, []), text, window, first=True)
    for block in blocks:
        out = _scanned(out, block, text, window, first=False)
    return (
        out.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"])))
        .withColumn("item_ids", F.array_sort(F.array_distinct("item_ids")))
    )


def _scanned(docs: DataFrame, block: list[tuple[str, list[bytes]]], text: str, window: int, first: bool) -> DataFrame:
    """One block's automaton over all documents; what earlier blocks found is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))

    def run(b):
        auto = shared.value
        n, spans_out, items_out = [], [], []
        for i, raw in enumerate(b["t"]):
            ws = words(raw)
            spans, found = auto.scan(ws)
            before = [] if first else [(s["start"], s["end"]) for s in b["spans"][i]]
            n.append(len(ws))
            spans_out.append([{"start": s, "end": e} for s, e in _merged([*spans, *before])])
            items_out.append([*([] if first else b["items"][i]), *(auto.names[k] for k in found)])
        return {"n_words": n, "hit_spans": spans_out, "item_ids": items_out}

    inputs = [utf8(F.col(text)).alias("t")] + ([] if first else [F.col("hit_spans").alias("spans"), F.col("item_ids").alias("items")])
    return add_columns(docs, run, "n_words bigint, hit_spans array<struct<start:int,end:int>>, item_ids array<string>", *inputs)


def remove_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS, max_coverage: float = 0.5,
) -> DataFrame:
    """`docs` without what test items cover.

    Hit spans are cut out of the text, until none is left; a document of which more
    than `max_coverage` of the words were hit goes. Untouched texts stay as they are.
    """
    out = docs
    for block in _blocks(items, item_key, item_text, block_words):
        out = _removed(out, block, text, window)
    return out.where(F.col("_hit") <= max_coverage * F.col("_n")).drop("_hit", "_n") if "_hit" in out.columns else out


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, raw[at:]])


def _removed(docs: DataFrame, block: list[tuple[str, list[bytes]]], text: str, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))
    first = "_hit" not in docs.columns

    def run(b):
        auto = shared.value
        hit, total, texts = [], [], []
        for i, (original, raw) in enumerate(zip(b["text"], b["t"])):
            ws = words(raw)
            n, gone = len(ws), 0
            spans, _ = auto.scan(ws)
            while spans:
                merged = _merged(spans)
                gone += sum(e - s for s, e in merged)
                raw = cut_spans(raw, merged)
                spans, _ = auto.scan(words(raw))
            hit.append(gone + (0 if first else b["hit"][i]))
            total.append(n if first else b["n"][i])
            texts.append(raw.decode() if gone else original)
        return {text: texts, "_hit": hit, "_n": total}

    inputs = [F.col(text).alias("text"), utf8(F.col(text)).alias("t")] + ([] if first else [F.col("_hit").alias("hit"), F.col("_n").alias("n")])
    return add_columns(docs, run, f"`{text}` string, _hit bigint, _n bigint", *inputs)
