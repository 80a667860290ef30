"""Operators on documents: brute force on small tables, and the defined results of odd rows."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import decontaminate, lm_scoring, near_dedup, packing, pii, quality_classifier, quality_rules, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = "the of and to ride lake stone river hollow market garden winter copper signal orbit velvet".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS) + str(rng.integers(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, wide characters, and columns with clashing names."""
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, prose(4, 20_000)), (5, prose(5, 60)), (6, prose(5, 60)), (5, prose(5, 60)), (7, "a"), (8, "A b"),
        (None, prose(9, 40)), (9, prose(9, 40)), (10, "x" * 50_000), (11, "é\U0001f600 ñ " * 30), (12, "one line\n" * 40), (13, prose(4, 20_000) + " end"),
    ]
    rows = [(i, t, "en", 7, "k", 1.5, 0) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_words int, kept string, score double, row int")


@pytest.fixture(scope="module")
def no_rows(odd_rows):
    return odd_rows.where("doc_id < 0").cache()


# quality rules


def brute_base(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    places = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if places[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_are_those_of_brute_force(spark, odd_rows):
    more = [(20 + i, t) for i, t in enumerate([
        " ".join(WORDS[:8]) + " x " + " ".join(WORDS[:8]), " ".join(["go"] * 9), " ".join(["go"] * 8), "# a | b\r\n# a | b\n\n# a | b", "w " * 30,
    ])]
    docs = odd_rows.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = quality_rules.quality_rules(docs, docs.where("doc_id % 2 = 0")).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    assert len(got) == docs.count()


def test_ratio_rejects_what_the_target_lacks(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(WORDS, 60)) for _ in range(70)]
    clean = list(enumerate(texts[:60]))
    junk = [(100 + i, t.replace(" ", "%%% ")) for i, t in enumerate(texts[60:])]
    docs = spark.createDataFrame(clean + junk, "doc_id bigint, text string")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs, docs.where("doc_id < 40"), buckets=4096).where("kept").collect()}
    assert kept == set(range(60))


def test_rules_on_odd_and_missing_rows(odd_rows, no_rows):
    judged = quality_rules.quality_rules(odd_rows, odd_rows.where("doc_id = 4"))
    assert judged.count() == odd_rows.count()
    assert [r.kept for r in judged.where("doc_id in (1, 2, 3)").collect()] == [False] * 3
    assert quality_rules.quality_rules(no_rows, no_rows).count() == 0
    assert not [c for c in judged.columns if judged.columns.count(c) > 1]


def cell_of(gram: tuple, buckets: int) -> int:
    """Spark's xxhash64 of a word, or of the hashes of two, modulo the cells."""
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in gram]
    if len(h) == 2:
        seed = xxhash.xxh64(h[0].to_bytes(8, "little"), seed=42).intdigest()
        h = [xxhash.xxh64(h[1].to_bytes(8, "little"), seed=seed).intdigest()]
    return (h[0] - (1 << 64 if h[0] >> 63 else 0)) % buckets


@pytest.mark.parametrize("buckets", [1, 64, 16_384])
def test_ratios_are_those_of_the_other_documents(spark, buckets, monkeypatch):
    monkeypatch.setattr(quality_rules, "_PACK", 64)
    texts = [prose(i, 40) for i in range(30)] + [prose(3, 40), prose(31, 40) + " " + prose(31, 40), "a", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    cells = []
    for w in (WORD.findall(t or "") for t in texts):
        cells.append(Counter(cell_of(g, buckets) for g in [*((x,) for x in w), *zip(w, w[1:])]))
    got = {r.doc_id: r.llr for r in quality_rules.quality_rules(docs, docs.where("doc_id < 12"), buckets=buckets).collect()}
    assert len(got) == len(texts)
    for i, own in enumerate(cells):
        raw, target = sum((g for j, g in enumerate(cells) if j != i), Counter()), sum((g for j, g in enumerate(cells) if j != i and j < 12), Counter())
        share, prior = target.total() / raw.total(), quality_rules.PRIOR
        mean = sum(m * math.log((target[g] + prior * share) / ((raw[g] + prior) * share)) for g, m in own.items()) / max(own.total(), 1)
        assert got[i] == pytest.approx(mean, abs=1e-9)


def test_rules_keep_columns_of_any_name(spark):
    names = "row id own _w _h1 _h2 _h4 _h8 _windows _cells _share _starts _trusted _tid _own result x r t llr".split()
    docs = spark.createDataFrame([(i, prose(i, 40), *range(len(names))) for i in range(4)], "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    got = quality_rules.quality_rules(docs, docs.where("doc_id < 2"))
    assert sorted(got.columns) == sorted({*docs.columns, *quality_rules.STATISTICS})
    assert {r.row for r in got.collect()} == {0} and {r._starts for r in got.collect()} == {names.index("_starts")}


def test_verdicts_agree_at_three_sizes(spark):
    table = lambda size, name: spark.read.parquet(f"/root/testdata/{size}/{name}.parquet")
    shares = {}
    for size in ("sf0.001", "sf0.01", "sf0.1"):
        labels = table(size, "labels").select("doc_id", "quality")
        judged = quality_rules.quality_rules(table(size, "documents").select("doc_id", "text"), labels.where("quality = 1"))
        rows = judged.where("not base_failed").join(labels, "doc_id", "left").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
        shares[size] = {r.quality: r.k for r in rows}
    for s in shares.values():
        assert s[1] >= 0.98 and s[None] >= 0.9 and s[0] < 0.5
    assert max(s[None] for s in shares.values()) - min(s[None] for s in shares.values()) < 0.1


# near duplicates


def brute_components(rows: list[tuple], size: int = 3, percent: int = 85) -> dict:
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    name = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if name[a] > name[b] and sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    name[a] = name[b]
                    changed = True
    return {i: (len(sets[i]), name[i]) for i in sets}


def test_components_are_those_of_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for group in range(6):
        base = prose(100 + group, 120).split()
        for _ in range(12):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 6)):
                words[at] = "edit" + str(rng.integers(0, 1000))
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, prose(7, 50).upper() if i else prose(7, 50)) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, size=size, percent=percent).collect()}
        assert got == brute_components(rows, size, percent)


def test_texts_a_little_below_the_similarity_dont_become_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]

    def copy(i: int, changes: int) -> tuple[int, str]:
        words = list(base)
        for at in rng.sample(range(150), changes):
            words[at] = f"x{i}at{at}"
        return i, " ".join(words)

    # most pairs of three changes each have a similarity of about 0.78; 8 copies of one change link with each other
    rows = [copy(i, 3) for i in range(120)] + [copy(1000 + i, 1) for i in range(8)]
    tested, confirm = [], near_dedup.confirm

    def counted(pairs, *rest):
        tested.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(near_dedup, "confirm", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(tested) < 8 * len(rows)  # of 8128 pairs
    sets = {i: {tuple(w[k : k + 3]) for k in range(148)} for i, t in rows for w in [t.split()]}
    own = {i: i for i in sets}
    for _ in sets:  # least ids spread over links
        for i, j in itertools.combinations(sorted(sets), 2):
            if own[i] != own[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                own[i] = own[j] = min(own[i], own[j])
        if all(own[own[i]] == own[i] for i in own) and not any(
            own[i] != own[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for i, j in itertools.combinations(sets, 2)
        ):
            break
    assert got == own


def test_bits_of_sets_never_hide_a_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "shingles", lambda t, size: np.array([int(x) for x in t.split()], np.uint64))
    # 1 and 2**32 + 1 coincide in their bits, in both sets
    rows = [(b"a", f"1 {2**32 + 1} 2 3"), (b"b", f"1 {2**32 + 1} 2 4"), (b"c", "1 5 6 7")]
    texts = spark.createDataFrame([(c, t.encode()) for c, t in rows], "c binary, t binary")
    low = near_dedup.low_bits(texts, 3).withColumn("n", F.lit(4).cast("long")).cache()
    pairs = low.alias("x").join(low.alias("y"), (F.col("x.c") < F.col("y.c")) & near_dedup._similar("x", "y", 60)).select("x.c", F.col("y.c").alias("d")).collect()
    assert [(bytes(r.c), bytes(r.d)) for r in pairs] == [(b"a", b"b")]


def test_near_duplicates_of_odd_rows(odd_rows, no_rows):
    got = near_dedup.near_duplicates(odd_rows.select("doc_id", "text", F.lit(1).alias("n_shingles"), F.lit(2).alias("c"))).collect()
    assert len(got) == odd_rows.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (1, 2, 3))
    assert by[6].component_id == 5 and not by[6].kept and by[13].component_id == 4
    assert by[None].component_id == 9 and not by[None].kept
    assert [r.kept for r in got if r.doc_id == 5] == [True, True]
    assert near_dedup.near_duplicates(no_rows).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    a, b = x[:2000], x[1000:]
    assert (np.maximum(near_dedup.registers(a), near_dedup.registers(b)) == near_dedup.registers(np.union1d(a, b))).all()
    assert abs((near_dedup.registers(a) == near_dedup.registers(b)).mean() - 1000 / len(x)) < 0.1


def test_likelihood_drops_only_what_is_far_below():
    n = np.array([500.0, 500.0])
    equal = np.array([0.85, 0.4]) * near_dedup.M
    larger = (near_dedup.M - equal) / 2
    assert near_dedup.likely(n, n, larger, larger, 0.85).tolist() == [True, False]


# decontamination


def brute_hits(text: str | None, items: list[tuple], window: int = 10) -> tuple:
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for name, item in items:
        w = split(item)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == w[p : p + k]:
                    hit.update(range(i, i + k))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


ITEMS = [
    (1, " ".join(WORDS[:14])), (2, "Lake, STONE river"), (3, None), (4, ""), (5, " ".join(WORDS[2:14])), (10, "stone river"), (11, "stone river"),
    (12, " ".join((WORDS * 3)[5:40])), (13, "ñandú é"),
]


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_hits_are_those_of_brute_force(spark, odd_rows, block_words):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(rng.choice(WORDS, 30)) + " " + " ".join((WORDS * 4)[s : s + rng.integers(3, 40)]) + " Ñandú ñandú é") for i, s in enumerate(rng.integers(0, 16, 40))]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd_rows.where("length(text) < 2000 or text is null").select("doc_id", "text"))
    for r in decontaminate.decontaminate(docs, items, block_words=block_words).collect():
        assert (r.n_words, r.n_hit, r.item_ids) == brute_hits(r.text, ITEMS)


def test_removal_leaves_no_hit_and_clean_texts_alone(spark, odd_rows, no_rows):
    items = spark.createDataFrame(ITEMS[:1], "item_id bigint, text string")
    clean = prose(1, 50)
    docs = spark.createDataFrame([(1, clean), (2, clean + " " + ITEMS[0][1] + ". " + clean), (3, ITEMS[0][1])], "doc_id bigint, text string")
    left = {r.doc_id: r.text for r in decontaminate.remove_items(docs, items).collect()}
    assert left[1] == clean and set(left) == {1, 2} and brute_hits(left[2], ITEMS[:1])[1] == 0
    assert len(left[2].split()) == 100 + left[2].count(" . ")
    assert decontaminate.remove_items(odd_rows, items).count() == odd_rows.count()
    assert decontaminate.remove_items(no_rows, items).count() == 0
    assert decontaminate.decontaminate(odd_rows, items.where("item_id < 0")).where("n_hit > 0").count() == 0


# personal data


def brute_spans(text: str | None) -> str:
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])[::-1]
        if 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


ODD_TEXTS = [
    "a@b.c_d@e.f x", "..a@b..c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111-", "+1 (974) 555-3436 +12345678901234567 +1 2",
    "x" * 5000 + "@", "9" * 3000, "1 " * 4000, "a@b.c@d.e-f.g", "é\U0001f600 a@b.co \U0001f600+49 (30) 1234567.", "5--4111111111111111 1-4111111111111111",
    "1.1.1.1 " * 500, "u@h.org," * 400,
]


def test_base_spans_are_those_of_brute_force(spark, odd_rows, no_rows):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS, 100)), "doc_id bigint, text string").unionByName(odd_rows.select("doc_id", "text"))
    found = pii.find(docs).select("doc_id", pii.written(F.col("base")).alias("b"), F.col("h"))
    expected = Counter((r.doc_id, brute_spans(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.b) for r in found.collect()) == expected
    assert pii.find(no_rows).count() == 0


def test_contexts_of_many_seeds_find_what_the_patterns_miss(spark):
    seeds = [(i, f"please reach us under handle: u{i}x@host{i}.org. thanks") for i in range(60)]
    hidden = [(100, "please reach us under handle: someone@intranet. thanks"), (101, "the total was someone@intranet2 then")]
    plain = [(200 + i, f"the total was {1234567 + i} then") for i in range(20)]
    found = pii.find(spark.createDataFrame(seeds + hidden + plain, "doc_id bigint, text string"))
    added = {r.doc_id: r.spans for r in found.where("size(spans) > size(base)").collect()}
    assert set(added) == {100} and [(s.rank, s.start, s.end) for s in added[100]] == [(0, 30, 46)]


def test_redaction_replaces_spans_and_nothing_else(spark, odd_rows):
    docs = spark.createDataFrame([(1, "é a@b.co, 1.2.3.4 end"), (2, "clean text"), (3, "+1 (974) 555-3436"), (3, "+1 (974) 555-3436"), (4, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.text) for r in pii.redact(docs).where("text is not null").collect())
    assert got == [(1, "é <EMAIL>, <IP> end"), (2, "clean text"), (3, "<PHONE>"), (3, "<PHONE>")]
    assert pii.redact(odd_rows).exceptAll(odd_rows).count() == 0


# packing


def test_pieces_and_places(spark, odd_rows, no_rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    extra = [(50, "It's <|endoftext|> don't, 'tis THE--end ÀÉß ﬁn x1y2 ½ ² Σίσυφος İstanbul"), (51, "tab\tvt\x0bnb\xa0sp em")]
    docs = odd_rows.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string")).where("doc_id is not null and doc_id <> 10").dropDuplicates(["doc_id"])
    got = packing.pack_documents(docs, path, group_pieces=8).collect()
    expected = set()
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        expected |= {(r.doc_id, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == expected and len(got) == len(expected)
    ends: dict = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert packing.pack_documents(no_rows, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bound_and_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [100, 60, 34, 20][seed], 300)
    bins, offsets = packing.best_fit_decreasing(lengths, 100)
    assert np.bincount(bins, weights=lengths).max() <= 100
    for b in np.unique(bins):
        order = np.argsort(offsets[bins == b])
        assert (offsets[bins == b][order] == np.cumsum(lengths[bins == b][order]) - lengths[bins == b][order]).all()
    bound = packing.lower_bound(lengths, 100)
    assert -(-lengths.sum() // 100) <= bound <= bins.max() + 1 <= bound + 1 + bound // 20


def test_bound_proves_more_than_the_sum():
    assert packing.lower_bound(np.array([60] * 10), 100) == 10
    assert packing.lower_bound(np.array([40] * 9), 100) == 5  # three never fit: 40 is over a third


def test_exchange_saves_bins(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(50, 900, 4000))]
    found = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    sequences = packing.pack(found, group_pieces=200).select("sequence_id").distinct().count()
    assert sequences <= packing.lower_bound(np.array([r[3] for r in rows]), 2048) * 1.01


# language model


@pytest.mark.parametrize("limits", [{}, {"vocabulary": 20}, {"vocabulary": 20, "broadcast_bytes": 1 << 16, "bits_per_token": 40.0}])
def test_base_scores_are_those_of_brute_force(odd_rows, limits):
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    rows = [(r.doc_id, r.text) for r in odd_rows.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
    got = lm_scoring.score(odd_rows, **limits).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2], round(x[3], 6))
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key) == [
        (x[0], x[1], x[2], pytest.approx(x[3])) for x in sorted(((i, len(words(t)), sum(counts[w] > 0 for w in words(t)), base(t)) for i, t in rows), key=key)
    ]
    assert all(r.held_out == held(r.doc_id) and r.train_tokens == n and r.score < 0 for r in got)


def test_shards_give_the_same_scores(odd_rows, no_rows):
    whole = {(r.doc_id, r.n_tokens): r.score for r in lm_scoring.score(odd_rows, bits_per_token=40.0).collect()}
    parts = {(r.doc_id, r.n_tokens): r.score for r in lm_scoring.score(odd_rows, bits_per_token=40.0, broadcast_bytes=1 << 16).collect()}
    assert parts == {k: pytest.approx(v) for k, v in whole.items()}
    assert lm_scoring.score(no_rows).count() == 0


def test_counts_come_back_from_the_filter():
    rng = np.random.default_rng(2)
    code = np.unique(rng.integers(0, 2**40, 20_000))
    count = rng.geometric(0.3, len(code))
    bits = np.frombuffer(lm_scoring.build_block(np.repeat(code, 2), np.repeat(count, 2) / 2), np.uint8)[None, :]
    got = lm_scoring.read_counts(code, np.zeros(len(code), np.int64), bits)
    exact = np.where(count < 2, 1, 1.4 * 2.0 ** np.floor(np.log2(count)))
    assert (got >= exact).all() and (got == exact).mean() > 0.9
    unseen = lm_scoring.read_counts(code + 2**41, np.zeros(len(code), np.int64), bits)
    assert (unseen == 0).mean() > 0.9


@pytest.mark.parametrize("vocabulary", [20, lm_scoring.VOCABULARY])
def test_scores_follow_exact_counts_of_all_words(spark, vocabulary):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, 200), 10**6))) for i in range(400)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words = {i: [b"^", *t.encode().split(), b"\n"] for i, t in rows}
    one, two = (Counter(g for i, w in words.items() if not held(i) for g in f(w)) for f in (lambda w: w, lambda w: zip(w, w[1:])))
    n, floor = one.total() - one[b"^"], one.total() - one[b"^"] + lm_scoring.ADD * len(one)
    level = lambda c: c if c < 2 else 1.4 * 2.0 ** (c.bit_length() - 1)
    mu = lm_scoring.MU
    exact = lambda w: sum(math.log10((min(level(two[p, x]), one[p]) + mu * (one[x] + lm_scoring.ADD) / floor) / (one[p] + mu)) for p, x in zip(w, w[1:]))
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id bigint, text string"), vocabulary=vocabulary).collect()
    errors = [abs(r.score - exact(words[r.doc_id])) / r.n_tokens for r in got]
    assert max(errors) < 0.1 and np.mean(errors) < 0.04 and got[0].train_tokens == n


def test_bigrams_leave_a_task_as_one_row_for_each_group(spark):
    texts = [b"A b a b c", b"", b"c a b " * 50, b"b a"]
    df = spark.createDataFrame([(t,) for t in texts], "t binary").coalesce(1)
    grams = Counter(g for t in texts for g in zip([None, *lm_scoring.tokens(t)], lm_scoring.tokens(t)))
    code = lambda w: int(lm_scoring.hashes_of([w])[0])
    codes = {int(lm_scoring.bigrams(np.array([code(p), code(w)] if p else [code(w)]), np.array([0]))[-1]): c for (p, w), c in grams.items()}
    rows = lm_scoring.bigram_counts(df, 3).collect()
    assert len(rows) == len({r["g"] for r in rows}) <= 3
    got = {}
    for r in rows:
        part = np.frombuffer(r["code"], np.int64)
        assert (lm_scoring.group_of(part, 3) == r["g"]).all()
        got.update(zip(part.tolist(), np.frombuffer(r["n"], np.int64).tolist()))
    assert got == codes


def test_groups_of_the_filter_give_the_same_scores(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, 40), 10**6))) for i in range(200)] + [(None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    one = sorted(lm_scoring.score(docs, vocabulary=20, bits_per_token=40.0).collect(), key=key)
    monkeypatch.setattr(lm_scoring, "GROUP_GRAMS", 900)
    monkeypatch.setattr(lm_scoring, "_WORDS_KEPT", 50)
    for limit in (1 << 29, 3 << 16):
        many = sorted(lm_scoring.score(docs, vocabulary=20, bits_per_token=40.0, broadcast_bytes=limit).collect(), key=key)
        assert [key(r) for r in many] == [key(r) for r in one]
        assert [(r.n_known, r.base_score) for r in many] == [(r.n_known, pytest.approx(r.base_score)) for r in one]
        assert [r.score for r in many] == [pytest.approx(r.score, rel=1e-6) for r in one]


# classifier


def test_classifier_on_held_out_rows(spark):
    rows = [(i, prose(i, 30) if i % 3 else " ".join([prose(i, 1)] * 30)) for i in range(240)]
    docs = spark.createDataFrame(rows + [(None, None), (500, ""), (1, prose(1, 30))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows] + [(2, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_classifier.fit(docs, labels, "quality", sample=60)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.held_out for r in got if r.doc_id == 1} == {zlib.crc32(b"1") % 5 == 0}


def test_classifier_without_labels_or_rows(spark, odd_rows, no_rows):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality_classifier.fit(odd_rows, labels, "quality")
    assert {r.score for r in quality_classifier.score(odd_rows, model).collect()} == {0.5}
    assert quality_classifier.score(no_rows, model).count() == 0


# token counts


def test_tokens_go_to_sections_by_the_rule(spark, odd_rows, no_rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder, _ = token_counts._encoder(path)
    docs = odd_rows.select("doc_id", "text").unionByName(spark.createDataFrame([(60, "\n\nTitle\né\U0001f600 line | two.\n \nend\n\n")], "doc_id bigint, text string"))
    for r in token_counts.count_tokens(docs, path).collect():
        assert r.n_tokens == r.between + sum(s.n_tokens for s in r.sections)
    text = "\n\nTitle\né\U0001f600 line | two.\n \nend\n\n"
    got = next(r for r in token_counts.count_tokens(docs, path).collect() if r.doc_id == 60)
    ids = encoder.encode_ordinary(text)
    raw, at, starts = text.encode(), 0, []
    for i in ids:
        size = len(encoder.decode_single_token_bytes(i))
        first = len(raw[: at + 1].decode("utf-8", "ignore"))
        while first and len(text[:first].encode()) > at:
            first -= 1
        last = len(raw[: at + size].decode("utf-8", "replace"))
        starts.append((first, max(last, first + 1)))
        at += size
    sections = token_counts.line_sections(text)
    counts = [0] * len(sections)
    for s, e in starts:
        own = [k for k, (a, b, _) in enumerate(sections) if a <= s < b] or [k for k, (a, b, _) in enumerate(sections) if a <= e - 1 < b]
        if own:
            counts[own[0]] += 1
    assert [s.n_tokens for s in got.sections] == counts and got.n_tokens == len(ids)
    assert token_counts.count_tokens(no_rows, path).count() == 0


def test_crossing_tokens():
    sections = [(0, 3, "a"), (3, 6, "b"), (8, 9, "c")]
    starts, ends = np.array([0, 2, 5, 6, 7, 8]), np.array([2, 4, 6, 7, 9, 9])
    counts, crossing, between = token_counts.attribute(starts, ends, sections)
    assert counts.tolist() == [2, 1, 2] and crossing.tolist() == [1, 0, 1] and between == 1


def test_personal_data_in_a_very_long_text(spark):
    text = " ".join(f"w{i} 10.0.{i % 300}.{i % 7} a{i}@b.org" if i % 10 == 0 else f"id{i}23456" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    start = time.perf_counter()
    read = pii.read_spans(docs, "doc_id", "text").select("k", "base", F.size("seen").alias("n_seen")).collect()
    found = {r.k: r.base for r in read}
    assert max(r.n_seen for r in read) > 200_000
    assert time.perf_counter() - start < 60
    places = [(m.start(), 0, m.end()) for m in re.finditer(r"a\d+@b\.org", text)]
    places += [(m.start(), 1, m.end()) for m in re.finditer(r"10\.0\.(\d+)\.\d", text) if int(m[1]) <= 255]
    assert [tuple(x) for x in found[1]] == sorted(places) and found[2] == []


def test_redaction_keeps_columns_of_any_name(spark):
    names = "_k _h spans blocks k h k2 h2 row id t clean base added m start end rank".split()
    texts = ["mail a@b.org or 10.0.0.1.", "none", None, "a@b.org"]
    docs = spark.createDataFrame([(i, x, *range(len(names))) for i, x in enumerate(texts)], "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names))
    got = sorted(pii.redact(docs).collect(), key=lambda r: r.doc_id)
    assert pii.redact(docs).columns == docs.columns and {r.spans for r in got} == {2}
    assert [r.text for r in got] == ["mail <EMAIL> or <IP>.", "none", None, "<EMAIL>"]


def test_cells_of_many_words_are_those_of_each():
    words = [b"a", b"aaaaaaaaaa", b"subword", b"\0", b"x-y.z", b"<>", bytes(range(33, 127))]
    cells, ends = quality_classifier.cells_at_once(words, 1 << 10)
    assert [cells[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [quality_classifier.subwords(w, 1 << 10) for w in words]


def test_scoring_cuts_no_ascii_word_alone(monkeypatch):
    rng = np.random.default_rng(1)
    model = quality_classifier.Model(rng.normal(size=(1 << 10, 4)).astype(np.float32), rng.normal(size=(2, 4)).astype(np.float32), 0.1, 0.2)
    texts = [b"", b"some words and some more", b"again again again", "straße naïve é".encode(), b" \n "]
    alone, subwords = [], quality_classifier.subwords
    monkeypatch.setattr(quality_classifier, "subwords", lambda w, n: alone.append(w) or subwords(w, n))
    got = [model.score(t) for t in texts]
    assert sorted(alone) == sorted("straße naïve é".encode().split())
    for text, score in zip(texts, got):
        odds = [np.mean([model.cells[c] for c in subwords(w, 1 << 10)]) for w in quality_classifier.stream(text)]
        assert score == pytest.approx(1 / (1 + np.exp(-(np.mean(odds) + 0.2 if odds else 0.1))))
