"""One registered query for each operator of the subpackage, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    capture_index, decontaminate, hard_negatives, html_extract, license_scan, lm_scoring, near_dedup, packing, periodic_runs, pii, quality_classifier,
    quality_rules, token_counts,
)
from plumbline.llm.common import read_table, words_of

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that `labels` marks with quality 1 are the trusted target."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.quality_rules(docs, trusted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("llr", 6).alias("llr"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op5_near_dedup", f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS x
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (
        SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
        WHERE 100 * m >= 85 * (na.n + nb.n - m)
    ),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


_ITEM_WORDS = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"


@query("op6_decontaminate", f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ITEM_WORDS}) AS ws FROM documents),
    i AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ITEM_WORDS}) AS ws FROM benchmark),
    sizes AS (SELECT DISTINCT least(len(ws), 10) AS k FROM i WHERE len(ws) > 0),
    iw AS (
        SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS x
        FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM i WHERE len(ws) > 0)
    ),
    dw AS (
        SELECT doc_id, k, p, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS x
        FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d JOIN sizes ON len(ws) >= k)
    ),
    m AS (SELECT doc_id, item_id, p, k FROM dw JOIN iw USING (k, x)),
    hits AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS w FROM m) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(F.col("base"), rank).alias(f"n_{kind}") for rank, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its tokens, those of each kind of section, and the allocation to single sections."""
    counted = token_counts.count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def total(kind: str) -> Column:
        return F.aggregate(F.filter("sections", lambda s: s["kind"] == kind), F.lit(0).cast("bigint"), lambda a, s: a + s["n_tokens"])

    return counted.select(
        "doc_id", "n_tokens", "between", *[total(k).alias(f"{k}_tokens") for k in token_counts.KINDS],
        F.aggregate("sections", F.lit(0).cast("bigint"), lambda a, s: a + s["crossing"]).alias("crossing"),
        F.size("sections").cast("bigint").alias("n_sections"), "sections",
    )


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.score(docs, quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"), "quality"))


@query("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_capture_index", """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM p),
    f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY s, n) ELSE page_id END AS first FROM d)
    SELECT page_id, n::BIGINT AS payload_bytes, s AS payload_digest,
        CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
    FROM f
""")
def op8_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = capture_index.archive_and_read(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )


@query("op1_html_extract")
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def looped(docs: DataFrame) -> DataFrame:
    """The contract's texts: those of some documents repeat a part of their words from a place on, both drawn from the id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i))), " ")).otherwise("")

    # the words are bound once, as the only element of an array
    again = F.element_at(F.transform(F.array(words_of(F.col("text"))), repeated), 1)
    return docs.withColumn("text", F.when(h % 10 == 0, again).otherwise(F.col("text")))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = looped(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs).withColumn("best", periodic_runs.strongest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(periodic_runs.written(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _template_rows() -> str:
    """The templates' k-grams as SQL rows."""
    rows = []
    for number, (phrase, label) in enumerate([*license_scan.BASE.items(), *license_scan.NOTICES.items()]):
        ws = phrase.split()
        k = license_scan.K_LONG if len(ws) >= license_scan.LONG else license_scan.K_PHRASE
        rows += [f"({number}, '{label}', {number < len(license_scan.BASE)}, {len(ws)}, {k}, {t}, '{' '.join(ws[t : t + k])}')" for t in range(len(ws) - k + 1)]
    return ", ".join(rows)


@query("op12_license_scan", f"""
    WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ITEM_WORDS}) AS ws FROM documents),
    t(template, label, base, size, k, t, gram) AS (VALUES {_template_rows()}),
    g AS (
        SELECT doc_id, p, array_to_string(list_slice(ws, p + 1, p + k), ' ') AS gram, k
        FROM (SELECT doc_id, ws, k, unnest(range(0, len(ws) - k + 1)) AS p FROM w, (SELECT DISTINCT k FROM t) WHERE len(ws) >= k)
    ),
    d AS (
        SELECT doc_id, template, label, base, size, k, p - t AS d, list(DISTINCT t) AS ts, min(t) AS low, max(t) AS high
        FROM g JOIN t USING (gram, k) GROUP BY ALL
    ),
    s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY d) AS span FROM (
        SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, template ORDER BY d) <= {license_scan.GAP} THEN 0 ELSE 1 END AS new
        FROM d WHERE size >= {license_scan.LONG})),
    m AS (
        SELECT doc_id, label, size, min(d + low) AS a, max(d + high + k) AS b,
            len(list_distinct(flatten(list_transform(flatten(list(ts)), lambda x: range(x, x + k))))) AS covered
        FROM s GROUP BY doc_id, template, span, label, size, k
    ),
    f AS (
        SELECT doc_id, label, base, d AS a, 1.0::DOUBLE AS score FROM d WHERE size < {license_scan.LONG} AND len(ts) = size - k + 1
        UNION ALL
        SELECT doc_id, label, false, a, covered::DOUBLE / size FROM m WHERE covered >= {license_scan.COVERAGE} * size AND covered >= {license_scan.DENSITY} * (b - a)
    ),
    r AS (
        SELECT doc_id, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
        FROM f GROUP BY doc_id
    )
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM w LEFT JOIN r USING (doc_id)
""")
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *names, "score")


@query("op13_hard_negatives", """
    WITH e AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
        FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    ),
    p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
    n AS (
        SELECT p.a, p.b, p.score AS positive_score, s.b AS c, s.score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
    )
    SELECT a AS anchor_id, b AS positive_id, rank::INT AS rank, c AS negative_id, positive_score, score AS negative_score FROM n WHERE rank <= 3
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(hard_negatives.prepare(moved))
