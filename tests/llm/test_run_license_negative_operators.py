"""Periodic runs, license scans and hard negatives beside brute force, and their defined results of odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives, license_scan, periodic_runs
from plumbline.llm.queries import QUERIES, looped

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(least, times * q):
                part = w[start:j]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts(seed: int, n: int) -> list[list[bytes]]:
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        size, letters = rng.randint(0, 260), rng.choice([1, 2, 2, 3, 5, 50])
        w = [str(rng.randrange(letters)) for _ in range(size)]
        for _ in range(rng.randint(0, 3)):
            if size > 30:
                at, p = rng.randrange(size), rng.randint(1, 40)
                for i in range(max(at, p), min(size, at + rng.randint(10, 200))):
                    w[i] = w[i - p]
                if rng.random() < 0.3:
                    w[rng.randrange(size)] = "x"
        texts.append([x.encode() for x in w])
    return texts


def test_runs_are_those_of_brute_force():
    texts = periodic_texts(1, 600)
    got = [r for at in range(0, len(texts), 50) for r in periodic_runs.find_runs(texts[at : at + 50])]
    assert got == [brute_runs(t) for t in texts]
    assert sum(map(len, got)) > 300 and max(map(len, got)) > 4
    for least, times in ((10, 3), (30, 4), (5, 5)):
        assert periodic_runs.find_runs(texts[:100], least, times) == [brute_runs(t, least, times) for t in texts[:100]]


def test_runs_of_words_with_many_occurrences():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 2000:
        a, b = b, b + a
    assert periodic_runs.find_runs([b, [b"z"] * 23]) == [brute_runs(b), []]
    one = periodic_runs.find_runs([[b"w"] * 300_000])
    assert one == [[(0, 300_000, 1)]]
    rng = np.random.default_rng(4)
    hot = [b"the" if x < 0.5 else b"w%d" % int(1000 * x) for x in rng.random(200_000)]
    assert all(n >= 24 for _, n, _ in periodic_runs.find_runs([hot])[0])


def test_run_query_is_that_of_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    with_runs = 0
    for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect():
        w = WORD.findall(docs[r.doc_id] or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w) if n < 1500 else periodic_runs.find_runs([w])[0]
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        expected = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *expected)
        assert r.runs_sha256 == digest("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r.collapsed_sha256 == digest(" ".join(x for i, x in enumerate(w) if i not in dropped))
        with_runs += bool(runs)
    assert with_runs > 10


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows, and columns with the names of results and of inner columns."""
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "go " * 100_000 + "MIT license"), (5, "Apache License, cc-by 4.0"), (5, "Apache License, cc-by 4.0"),
        (None, "GNU General Public License, version 3"), (6, "mit"), (7, "\U0001f600 é " * 30), (8, "mit license " * 40),
    ]
    names = "n_words n_runs runs collapsed best start length period h1 h2 at words gram gram_2 i t v salt c0 score labels first_word __in".split()
    schema = "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names)
    return spark.createDataFrame([(*r, *range(len(names))) for r in texts], schema)


def test_runs_on_odd_and_missing_rows(odd_rows):
    found = periodic_runs.periodic_runs(odd_rows)
    assert sorted(found.columns) == sorted({*odd_rows.columns, "n_words", "runs", "collapsed"})
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed[:8], r.h1) for r in found.collect()), key=repr)
    by_id = {r[0]: r[1:4] for r in got}
    assert len(got) == 10 and by_id[1] == by_id[2] == by_id[3] == (0, [], "")
    assert by_id[4] == (100_002, [(0, 100_000, 1)], "go MIT l") and by_id[8][1] == [(0, 80, 2)] and by_id[7][1] == [(0, 60, 2)]
    assert {r[4] for r in got} == {8}
    assert periodic_runs.periodic_runs(odd_rows.where("doc_id < 0")).count() == 0
    assert looped(odd_rows).count() == 10


def brute_scan(text: str | None) -> tuple:
    """Base places and, for phrases, labels."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    base, labels = [], set()
    for templates in (license_scan.BASE, license_scan.NOTICES):
        for phrase, label in templates.items():
            p = phrase.split()
            if len(p) < license_scan.LONG:
                places = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
                labels |= {label} if places else set()
                base += [(i, label) for i in places] if templates is license_scan.BASE else []
    starts = [i for i, _ in base]
    return len(w), len(base), min(starts, default=None), max(starts, default=None), sorted({x for _, x in base}), sorted(labels)


def test_phrases_are_those_of_brute_force(spark, odd_rows):
    rng = random.Random(7)
    pool = "gnu general public license apache cc by mit license license version 3 2 0 nc sa lake".split()
    rows = [(100 + i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 400))).replace("cc by", "CC-BY")) for i in range(60)]
    rows.append((1000, " ".join(rng.choice(pool) for _ in range(3 * license_scan.PIECE))))
    docs = odd_rows.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = license_scan.scan(docs).collect()
    assert len(got) == len(rows) + 10
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute_scan(r.text)
        assert r.score == (1.0 if r.labels else 0.0)


def test_notices_with_edits_are_found_and_others_are_not(spark):
    notice = next(t for t in license_scan.NOTICES if t.startswith("permission is hereby"))
    w = notice.split()
    edited = w[:10] + ["really"] + w[10:30] + w[32:]
    texts = [
        (1, "lake " * 50 + notice), (2, "lake " * 5000 + " ".join(edited)), (3, " ".join(w[:20])), (4, " ".join(reversed(w))), (5, " ".join(w[:12] + ["lake"] * 300 + w[12:])),
        (6, " ".join([*w, *w])),
    ]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.n_base, r.score) for r in license_scan.scan(docs).collect()}
    assert got[1] == (["mit"], 0, 1.0) and got[6] == (["mit"], 0, 1.0)
    assert got[2][0] == ["mit"] and 0.8 < got[2][2] < 1
    assert got[3] == got[4] == ([], 0, 0.0)
    assert got[5][0] == ["mit"] and 0.6 < got[5][2] < 1  # the part behind the gap suffices


def test_scan_on_odd_and_missing_rows(odd_rows):
    found = license_scan.scan(odd_rows)
    new = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    assert sorted(found.columns) == sorted({*odd_rows.columns, *new})
    by_id = {r.doc_id: r for r in found.collect()}
    assert found.count() == 10 and by_id[8].n_base == 40 and by_id[8].last_word == 78 and by_id[None].labels == ["gpl", "gpl-3.0"]
    assert {r.h1 for r in by_id.values()} == {8} and by_id[4].first_word == 100_000
    assert license_scan.scan(odd_rows.where("doc_id < 0")).count() == 0


def brute_negatives(rows: list[tuple]) -> set[tuple]:
    """rows (id, label, integer vector), distinct."""
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, label, v in rows:
        if a % 50:
            continue
        same = sorted((-dot(v, w), i) for i, l, w in rows if l == label and i != a and len(w) == len(v))[:5]
        other = sorted((-dot(v, w), i) for i, l, w in rows if l != label and len(w) == len(v))
        for s, p in same:
            s = -s
            fit = [(-t, i) for t, i in other if 50 * s <= 100 * -t <= 95 * s][:3]
            out |= {(a, p, rank, i, s, t) for rank, (t, i) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("block_rows", [hard_negatives.BLOCK_ROWS, 7])
def test_negatives_are_those_of_brute_force(spark, block_rows):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 4)) if i % 3 else 1, (rng.normal(size=6) + 0.4).round(1).tolist()) for i in range(400)]  # rounded: many ties
    rows += [(400 + i, 2, rng.normal(size=3).tolist()) for i in range(60)]  # another length
    odd = [
        (1000, None, [1.0] * 6), (1050, 1, None), (1100, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1150, 1, [float("nan")] * 6), (None, 1, [9.0] * 6),
        (1200, 1, [float("inf")] * 6), (1250, 77, [1.0] * 6), (1300, 1, [0.0] * 6), (1350, 2, []),
    ]
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows + odd + rows[:50] + rows[:1] * 30)], "vec_id bigint, label int, embedding array<double>, id int, v string")
    got = [tuple(r) for r in hard_negatives.mine(hard_negatives.prepare(df), block_rows=block_rows).collect()]
    kept = rows + [r for r in odd if r[0] in (1250, 1300, 1350)]
    expected = brute_negatives([(i, l, np.floor(256 * np.array(v)).astype(int).tolist()) for i, l, v in kept])
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 60
    assert hard_negatives.mine(hard_negatives.prepare(df.where("vec_id < 0"))).count() == 0


def test_threshold_stops_before_all_rows_and_is_exact():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-300, 300, (4000, 4))
    block = hard_negatives.Block(list(range(4000)), vectors)
    for anchor in rng.integers(-300, 300, (20, 4)):
        scores = vectors @ anchor
        top = int(np.sort(scores)[-40])
        needs = [(-(1 << 63), (1 << 63) - 1, 5), (0, top, 3)]
        got = block.best(anchor, needs, without=17)
        for found, (low, high, k) in zip(got, needs):
            assert found == [(s, i) for s, i in sorted(((int(s), i) for i, s in enumerate(scores) if i != 17 and low <= s <= high), key=lambda x: (-x[0], x[1]))[:k]]
    assert block.reads < 20 * 4000 * 0.8
    big = hard_negatives.Block([1, 2], np.array([[1 << 40, 1], [-(1 << 40), 1]]))
    assert big.best(np.array([1 << 40, 0]), [(-(1 << 63), (1 << 63) - 1, 2)]) == [[((1 << 63) - 1, 1), (1 - (1 << 63), 2)]]


def test_odd_columns_of_embeddings_are_ignored(spark):
    df = spark.range(120).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 5 + 0.5, F.lit(1.0)).alias("embedding"), (F.col("id") % 3).cast("int").alias("label"), F.lit(1).alias("block"), F.lit("k").alias("kind"))
    assert hard_negatives.mine(hard_negatives.prepare(df)).count() > 0
