"""License scans by diagonal voting.

Templates are phrases and notices as word sequences with a label. The rolling hashes of
all word k-grams of all texts are joined in Spark with the templates' k-grams; a match
at text word p and template word t is a vote for the diagonal p - t. Votes are counted
by diagonal; neighbouring diagonals (the template with words added or lost) are merged,
and a merged span is verified: the words of its k-grams are compared with the template's
themselves, and enough of the template must be covered, closely enough. Phrases must be
covered wholly on one diagonal.

Spread: texts leave their row in pieces of at most PIECE words, so no row grows with its
text. The template table is as large as TEMPLATES. Only votes are shuffled, keyed by a
128-bit hash of the text: each distinct text is judged once, and because a diagonal's
votes are a set of template words, copies of a text add nothing to a group. Verdicts
return to the rows by that hash, salted, since a third of all rows may share a text.

Defined results: NULL, empty and wordless texts have no words and no spans. Repeated
rows are judged alike. Other columns pass through; one that clashes with a result column
is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import add_columns, utf8
from plumbline.llm.decontaminate import words

#: Phrases whose places are counted, with their labels. Fixed values.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Longer names of licenses and notices that stand at the head of sources, with their labels. Fixed values.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "apache license version 2 0": "apache-2.0",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
}
#: Templates of at least so many words may differ from the text; shorter ones are phrases.
LONG = 12
K_PHRASE, K_LONG = 2, 4
#: Diagonals of a long template at most so far apart belong to one span.
GAP = 8
#: Shares a long template's span needs: of the template's words, and of the span's words.
COVERAGE, DENSITY = 0.6, 0.5
PIECE = 4096

_SALTS = 16
_WORD_BASE, _GRAM_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD_INVERSE = np.uint64(pow(int(_WORD_BASE), -1, 1 << 64))


def word_hashes(joined: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of words that stand without gaps in a byte array and end at `ends`."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(joined) + 1, _WORD_BASE, np.uint64))
        prefix = np.concatenate(([np.uint64(0)], np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(joined), _WORD_INVERSE, np.uint64))))
        h = (prefix[ends] - prefix[starts]) * back[starts]
        h = (h ^ (h >> np.uint64(31))) * _GRAM_BASE
        return h ^ (h >> np.uint64(29))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all k-grams, as signed 64-bit numbers that also depend on k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(k))
        for i in range(k):
            h = h * _GRAM_BASE + hashes[i : i + n]
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _hashes(ws: list[bytes]) -> np.ndarray:
    return word_hashes(np.frombuffer(b"".join(ws), np.uint8), np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws))))


def template_table(spark: SparkSession, templates: list[tuple[str, str]], base: int = 0) -> DataFrame:
    """A row for each k-gram of each template: gram, its words, template number, place t, k, the template's size, label; the first `base` are base phrases."""
    rows = []
    for number, (phrase, label) in enumerate(templates):
        ws = words(phrase.encode())
        if len(ws) < K_PHRASE:
            raise ValueError(f"template {phrase!r} has fewer than {K_PHRASE} words")
        k = K_LONG if len(ws) >= LONG else K_PHRASE
        for t, gram in enumerate(grams(_hashes(ws), k).tolist()):
            rows.append((gram, [w.decode() for w in ws[t : t + k]], number, t, k, len(ws), label, number < base))
    return spark.createDataFrame(rows, "gram bigint, words array<string>, template int, t int, k int, size int, label string, base boolean")


def _pieces(texts: DataFrame) -> DataFrame:
    """(h1, h2, at, words, gram_k...): each text's words in pieces, with the grams that start in a piece."""
    sizes = (K_PHRASE, K_LONG)
    schema = T._parse_datatype_string("h1 bigint, h2 bigint, at int, words array<string>, " + ", ".join(f"gram_{k} array<bigint>" for k in sizes))
    arrow = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32()), ("words", pa.list_(pa.string()))] + [(f"gram_{k}", pa.list_(pa.int64())) for k in sizes])

    def listed(values: pa.Array, sizes: list[int]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)

    def pieces(h1: list[int], h2: list[int], texts: list[bytes]) -> Iterator[tuple[int, int, int, list[bytes], int]]:
        for a, b, raw in zip(h1, h2, texts):
            ws = words(raw)
            for at in range(0, len(ws) - K_PHRASE + 1, PIECE):
                yield a, b, at, ws[at : at + PIECE + K_LONG - 1], min(PIECE, len(ws) - at)

    def batch(rows: list[tuple[int, int, int, list[bytes], int]]) -> pa.RecordBatch:
        flat = [w for r in rows for w in r[3]]
        raw, ends = b"".join(flat), np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))
        hashes = word_hashes(np.frombuffer(raw, np.uint8), ends)
        text = pa.StringArray.from_buffers(len(flat), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(raw))
        counts = [len(r[3]) for r in rows]
        first = np.concatenate(([0], np.cumsum(counts)))
        columns = [pa.array([r[i] for r in rows], arrow[i].type) for i in range(3)] + [listed(text, counts)]
        for k in sizes:
            found = [grams(hashes[first[i] : first[i + 1]], k)[: r[4]] for i, r in enumerate(rows)]
            columns.append(listed(pa.array(np.concatenate(found)), [len(f) for f in found]))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list = []
            n = 0
            for piece in pieces(*(b.column(i).to_pylist() for i in range(3))):
                held.append(piece)
                n += len(piece[3])
                if n >= 8 * PIECE:
                    yield batch(held)
                    held, n = [], 0
            if held:
                yield batch(held)

    return texts.mapInArrow(run, schema)


def votes(texts: DataFrame, table: DataFrame) -> DataFrame:
    """(h1, h2, template, p, t, ...): every place of a template's k-gram in a text, its words compared."""
    pieces = _pieces(texts)
    per_k = []
    for k in (K_PHRASE, K_LONG):
        grams_k = F.broadcast(table.where(F.col("k") == k).withColumnRenamed("words", "same"))
        placed = pieces.select("h1", "h2", "at", "words", F.posexplode(f"gram_{k}").alias("i", "gram"))
        per_k.append(
            placed.join(grams_k, "gram").where(F.slice("words", F.col("i") + 1, k) == F.col("same"))
            .select("h1", "h2", "template", "t", (F.col("at") + F.col("i")).alias("p"), "k", "size", "label", "base")
        )
    return per_k[0].unionByName(per_k[1])


def spans(votes: DataFrame) -> DataFrame:
    """(h1, h2, label, base, start, end, score): verified spans, merged from the diagonals of each text and template."""
    diagonals = votes.groupBy("h1", "h2", "template", "size", "k", "label", "base", (F.col("p") - F.col("t")).alias("d")).agg(F.collect_set("t").alias("ts"))
    phrases = (
        diagonals.where(F.col("size") < LONG).where(F.size("ts") == F.col("size") - F.col("k") + 1)
        .select("h1", "h2", "label", "base", F.col("d").alias("start"), (F.col("d") + F.col("size")).alias("end"), F.lit(1.0).alias("score"))
    )
    by_place = Window.partitionBy("h1", "h2", "template").orderBy("d")
    merged = (
        diagonals.where(F.col("size") >= LONG)
        .withColumn("new", F.when(F.col("d") - F.lag("d").over(by_place) <= GAP, 0).otherwise(1))
        .withColumn("span", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("h1", "h2", "template", "span", "size", "k", "label", "base")
        .agg(
            F.min(F.col("d") + F.array_min("ts")).alias("start"), F.max(F.col("d") + F.array_max("ts") + F.col("k")).alias("end"),
            F.collect_list("ts").alias("ts"),
        )
        .withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform(F.flatten("ts"), lambda t: F.sequence(t, t + F.col("k") - 1))))))
    )
    notices = merged.where((F.col("covered") >= COVERAGE * F.col("size")) & (F.col("covered") >= DENSITY * (F.col("end") - F.col("start"))))
    return phrases.unionByName(notices.select("h1", "h2", "label", "base", "start", "end", (F.col("covered") / F.col("size")).alias("score")))


def scan(docs: DataFrame, text: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Every row of `docs` with n_words, n_base (places of base phrases), first_word and last_word (their smallest and largest start),
    base_labels and labels (arrays, sorted) and score (the best span's covered share of its template, 0 without spans)."""
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(F.xxhash64(raw).alias("h1"), F.xxhash64(F.lit("second"), raw).alias("h2"), utf8(F.col(f"`{text}`")).alias("t"))
    table = template_table(docs.sparkSession, [*base.items(), *notices.items()], len(base))
    by_text = spans(votes(texts, table)).groupBy("h1", "h2").agg(
        F.count_if("base").alias("n_base"),
        *[f(F.when(F.col("base"), F.col("start"))).cast("bigint").alias(f"{name}_word") for name, f in (("first", F.min), ("last", F.max))],
        F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("score").alias("score"),
    )
    found = by_text.select(
        F.struct("n_base", "first_word", "last_word", "base_labels", "labels", "score").alias("v"), "h1", "h2",
        F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"),
    )
    counted = add_columns(docs, lambda b: {"n_words": [len(words(t)) for t in b["t"]]}, "n_words bigint", utf8(F.col(f"`{text}`")).alias("t"))
    plain = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    # numbered names can't clash, and columns that nobody reads aren't shuffled
    kept = [c for c in docs.columns if c not in new]
    keyed = counted.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], "n_words", F.xxhash64(raw).alias("h1"),
        F.xxhash64(F.lit("second"), raw).alias("h2"), F.pmod(F.xxhash64(*[F.col(c) for c in plain if c.strip("`") in kept]), F.lit(_SALTS)).cast("int").alias("salt"),
    )
    none = F.array().cast("array<string>")
    return keyed.join(found, ["h1", "h2", "salt"], "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "n_words", F.coalesce("v.n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("v.first_word").alias("first_word"), F.col("v.last_word").alias("last_word"),
        F.coalesce("v.base_labels", none).alias("base_labels"), F.coalesce("v.labels", none).alias("labels"),
        F.coalesce("v.score", F.lit(0.0)).alias("score"),
    )
