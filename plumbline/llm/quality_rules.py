"""Quality rules: base text statistics and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted, one over a
trusted target and one over the raw corpus. A document's verdict is the mean of
log(p_target / p_raw) over its n-grams, held against a fixed threshold. The model
has a cell for every CELL_CHARS characters of the corpus, up to MODEL_WIDTH cells:
a hashed model's width, all n-grams of all texts are counted in it. Own n-grams
are taken out of both multinomials, so being labelled or not doesn't move a verdict,
and a cell without other counts has ratio 0.

Counts are combined where the rows are and packed into one row of two arrays. These
are literals of the judging expression (subqueries can't stand in lambdas, and as
columns they would be copied into every row). Each text is judged inside its row: its
sorted cells give its own counts, and the arrays the others'. Nothing is exploded or
joined for a verdict, and what passes the driver is bounded by the width. No Python.

Defined results: a NULL or blank text has no words, fails the base rules and is
not kept; its ratio is 0. Repeated rows are judged alike, each on its own row.
Other columns pass through, whatever their names; a clashing one is replaced by the
operator's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.session import cut
from plumbline.llm.common import words_of

#: characters of the corpus for one cell (85 to 170 n-grams, as cells are a power of two), and the most cells
CELL_CHARS = 264
MODEL_WIDTH = 1 << 17
#: cells that are packed together before all are
_PACK = 1 << 12
#: counts at the raw corpus's ratio that each cell has beside its own, so sparse cells have a ratio near 0
PRIOR = 2.0
THRESHOLD = -0.15
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"
#: Trusted ids up to this number are broadcast; a larger set is joined by a shuffle.
BROADCAST_IDS = 4_000_000


def _dup_count(items: Column) -> Column:
    return F.size(items) - F.size(F.array_distinct(items))


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _paired(hashes: str, step: int) -> Column:
    """Hash of each entry with the one `step` places on; the last `step` entries are of no use."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(F.col(hashes), i + step)))


def with_hashes(df: DataFrame, text: str) -> DataFrame:
    """Adds `_w` (words) and 64-bit hashes: `_h1` of words, `_h2` of bigrams.

    Each is a column of its own, so that a later use reads it and doesn't compute it anew.
    """
    return (
        df.withColumn("_w", words_of(F.col(text)))
        .withColumn("_h1", F.transform("_w", lambda w: F.xxhash64(w)))
        .withColumn("_h2", _paired("_h1", 1))
    )


def repeated_window_words(hashes: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more, first occurrences included.

    `hashes` holds a window hash (64 bits, compared inside one document only) by
    start. If some repeat, they are sorted with their places; a window repeats if a
    neighbour has its hash. Repeated starts cover min(WINDOW, gap to the next) words.
    """

    def repeats(p: Column) -> Column:
        same = F.filter(p, lambda x, k: F.coalesce(x["h"] == F.get(p, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, k + 1)["h"], F.lit(False)))
        return _bound(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(_dup_count(hashes) > 0, _bound(placed, repeats)).otherwise(0)


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Adds the base statistics to rows that have `_w`, `_h1` and `_h2`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    n = F.size("_w")
    return (
        df.withColumn("_h4", _paired("_h2", 2)).withColumn("_h8", _paired("_h4", 4))
        .withColumn("_windows", F.slice("_h8", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))))
        .withColumns({
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": _bound(lines, _dup_count).cast("long"),
            "n_repeat_words": repeated_window_words(F.col("_windows")).cast("long"),
        })
        .drop("_h4", "_h8", "_windows")
    )


#: what the operator adds
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")


def _bigrams(h2: str) -> Column:
    return F.slice(h2, F.lit(1), F.greatest(F.size(h2) - 1, F.lit(0)))


def _cells(buckets: int) -> Column:
    # a bit mask is never NULL, so that sorting takes Java's sort of plain integers
    return F.transform(F.concat("_h1", _bigrams("_h2")), lambda h: h.bitwiseAND(F.lit(buckets - 1).cast("bigint")).cast("int"))


def model_width(docs: DataFrame, text: str) -> int:
    """Cells for a corpus: a power of two, at most one for every CELL_CHARS characters and at most MODEL_WIDTH."""
    chars = docs.agg(F.sum(F.length(text).cast("bigint")).alias("n")).first()["n"] or 0
    return 1 << min(MODEL_WIDTH, max(1, chars // CELL_CHARS)).bit_length() - 1


def packed_counts(marked: DataFrame, text: str, buckets: int) -> tuple[str, str, int, int]:
    """The counts by cell of all n-grams and of those of rows with `own`, as text, and the sums of both."""
    every = marked.sparkSession.range(buckets).select(F.col("id").cast("int").alias("cell"), F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("t"))
    found = with_hashes(marked.select(F.col(text).alias("_text"), F.col("own").cast("bigint").alias("t")), "_text")
    grams = found.select(F.explode(_cells(buckets)).alias("cell"), F.lit(1).cast("bigint").alias("r"), "t")
    # every cell occurs, so that a cell's number is its place
    counts = cut(grams.unionByName(every).groupBy("cell").agg(F.sum("r").alias("r"), F.sum("t").alias("t")))
    rows = counts.groupBy(F.floor(F.col("cell") / _PACK).alias("part")).agg(F.array_sort(F.collect_list(F.struct("cell", "r", "t"))).alias("x"))
    parts = rows.agg(F.array_sort(F.collect_list(F.struct("part", F.col("x.r").alias("r"), F.col("x.t").alias("t")))).alias("x"))
    text_of = lambda name: F.array_join(F.flatten(F.col(f"x.{name}")).cast("array<string>"), " ").alias(name)
    packed = parts.select(text_of("r"), text_of("t")).first()
    sums = counts.agg(F.sum("r").alias("r"), F.sum("t").alias("t")).first()
    return packed["r"], packed["t"], sums["r"], sums["t"]


def with_log_ratio(df: DataFrame, model: tuple[str, str, int, int], buckets: int) -> DataFrame:
    """Adds `llr` to rows that have `own`, `_h1` and `_h2`: a text is judged on the counts of the others."""
    raw, target = (F.split(F.lit(m), " ").cast("array<bigint>") for m in model[:2])  # each folded to one literal
    n_raw, n_target = model[2:]
    n, own = F.size("_cells"), F.col("own").cast("bigint")
    share = (n_target - own * n) / F.nullif((n_raw - n).cast("double"), F.lit(0.0))
    cells = df.withColumn("_cells", F.sort_array(_cells(buckets)))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    runs = cells.withColumn("_share", share).withColumn("_starts", F.filter(places, lambda i: (i == 0) | (F.get("_cells", i) != F.get("_cells", i - 1))))

    def term(i: Column, k: Column) -> Column:
        m = F.coalesce(F.get("_starts", k + 1), n) - i
        cell = F.get("_cells", i)
        trusted, others = F.get(target, cell) - own * m, F.get(raw, cell) - m
        return m * F.log((trusted + PRIOR * F.col("_share")) / ((others + PRIOR) * F.col("_share")))

    total = F.aggregate(F.transform("_starts", term), F.lit(0.0), lambda a, x: a + x)
    ratio = F.when((F.col("_share") > 0) & (n > 0), total / n).otherwise(0.0)
    return runs.withColumn("llr", ratio).drop("_cells", "_share", "_starts")


def mark_trusted(rows: DataFrame, trusted_ids: DataFrame, key: str) -> DataFrame:
    """`rows` (with `id`) with boolean `own`: whether `trusted_ids` holds the id."""
    ids = trusted_ids.select(F.col(key).alias("_tid")).where("_tid is not null").distinct().withColumn("_own", F.lit(True))
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = rows.join(F.broadcast(ids) if small else ids, F.col("id") == F.col("_tid"), "left")
    return marked.withColumn("own", F.coalesce("_own", F.lit(False))).drop("_tid", "_own")


def quality_rules(
    docs: DataFrame, trusted_ids: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int | None = None,
    min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """Every row of `docs` with its statistics, `llr`, `base_failed` and `kept`; fitted on `docs` with the ids of the trusted target."""
    # the caller's columns travel in one struct, so that none can clash with the inner ones
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    marked = mark_trusted(rows, trusted_ids, key)
    buckets = buckets or model_width(rows, "text")
    if buckets & (buckets - 1):
        raise ValueError("the number of cells must be a power of two")
    model = packed_counts(marked.select("text", "own"), "text", buckets)
    stated = with_log_ratio(with_base(with_hashes(marked, "text"), "text"), model, buckets)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = stated.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    # A row number (never negative) makes the result indeterminate to the optimizer. Else a later filter
    # on a statistic would be pushed down, with the statistic's whole computation at each of its uses.
    result = F.when(F.monotonically_increasing_id() >= 0, F.struct(*STATISTICS)).alias("result")
    kept = [c for c in docs.columns if c not in STATISTICS]
    return judged.select("row", result).select(*[F.col("row").getField(c).alias(c) for c in kept], "result.*")
