"""Token counts per section, from one encoding of each whole document.

The text is encoded once. Its tokens' bytes joined are the text, so their spans come
from running sums of token sizes and are then mapped to characters. Sections are
given as character spans (here: headings, paragraphs, tables and list lines of a
text); an interval join inside the row gives each token to sections.

The rule for tokens that cross a boundary: a token belongs to the section that holds
its first character; `crossing` counts those that end beyond it. A token that starts
in no section (the line feeds between) goes to the section it ends in, if any, else
to `between`. So the counts of a document's sections and `between` sum to its tokens.
A token inside a character (a part of its bytes) starts where the character starts.

Defined results: NULL and empty texts have no sections and no tokens.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, utf8

KINDS = ("blank", "paragraph", "table", "heading")
HEADING_WORDS = 8


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def line_sections(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the lines that are not empty, without their line feeds.

    A line with a bar between words is a table line; a short one without a closing mark is a heading.
    """
    out, at = [], 0
    for line in text.split("\n"):
        if line:
            if not line.strip(" \t\r\v\f"):
                kind = KINDS[0]
            elif " | " in line:
                kind = KINDS[2]
            elif line.rstrip()[-1] not in ".!?:;,…»\"'" and len(line.split()) <= HEADING_WORDS:
                kind = KINDS[3]
            else:
                kind = KINDS[1]
            out.append((at, at + len(line), kind))
        at += len(line) + 1
    return out


def token_starts(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character start and end (exclusive) of each token."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    if len(raw) == len(text):
        return starts, ends
    first = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with each byte
    return first[starts] - 1, first[ends - 1]


def attribute(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and crossing tokens of each section (sorted, disjoint), and the tokens of none."""
    n = len(sections)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), len(starts)
    s = np.array([x[0] for x in sections])
    e = np.array([x[1] for x in sections])
    holder = np.searchsorted(s, starts, side="right") - 1
    held = (holder >= 0) & (starts < e[np.maximum(holder, 0)])
    last = np.searchsorted(s, ends - 1, side="right") - 1
    late = ~held & (last >= 0) & (ends - 1 < e[np.maximum(last, 0)])
    owner = np.where(held, holder, np.where(late, last, n))
    crossing = held & (ends > e[np.maximum(holder, 0)]) | late
    return np.bincount(owner, minlength=n + 1)[:n], np.bincount(owner[crossing], minlength=n)[:n], int((owner == n).sum())


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, between, sections) for every row; sections: array of (section, kind, start, end, n_tokens, crossing)."""

    def run(batches):
        encoder, sizes = _encoder(tokenizer)
        for b in batches:
            out = {"k": b["k"], "n_tokens": [], "between": [], "sections": []}
            for raw in b["t"]:
                t = raw.decode()
                ids = np.array(encoder.encode_ordinary(t), np.int64)
                sections = line_sections(t)
                counts, crossing, between = attribute(*token_starts(t, ids, sizes), sections) if len(ids) else attribute(ids, ids, sections)
                out["n_tokens"].append(len(ids))
                out["between"].append(between)
                out["sections"].append([
                    {"section": i, "kind": kind, "start": s, "end": e, "n_tokens": int(n), "crossing": int(c)}
                    for i, ((s, e, kind), n, c) in enumerate(zip(sections, counts, crossing))
                ])
            yield out

    sections = "array<struct<section:int,kind:string,start:int,end:int,n_tokens:bigint,crossing:bigint>>"
    counted = map_batches(docs.select(F.col(key).alias("k"), utf8(F.col(text)).alias("t")), run, f"k bigint, n_tokens bigint, between bigint, sections {sections}")
    return counted.withColumnRenamed("k", key)
