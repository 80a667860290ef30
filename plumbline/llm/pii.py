"""Personal data: base patterns, and contexts bootstrapped from what they find.

Base spans come from four expressions. A span's context is the word before and the
word after it; the pairs (context, identifier) form a bipartite graph. Base spans
seed it; identifier-like words that no base span covers are candidates. Rounds of
    pattern score  = mean confidence of its distinct identifiers (smoothed)
    identifier confidence = 1 - product of (1 - score) over its patterns; 1 for seeds
run as joins and aggregations over distinct edges. Patterns with a high score and
enough distinct seeds name the kind of the candidates that they surround.

Only DataFrame functions are used. Texts are read once, inside their row; what is
shuffled are identifiers and their contexts.

Defined results: a NULL or empty text has no spans. Rows equal in key and text share
their result. Spans of one kind don't overlap, added spans overlap no base span.
Positions are code points, the end is exclusive. The work on a text grows with its
length. Other columns pass through redact(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.session import cut

KINDS = ("email", "ip", "card", "phone")

# The contract's expressions, written so that a failing start never scans a run again:
# possessive runs, and starts only where a run (or the last match) allows a leftmost one.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: runs of digits with single blanks or hyphens between; shorter and longer runs than 14 to 19 digits aren't matched at all
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_VALID = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: words with a digit or an at sign
CANDIDATE = r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+"

#: entries of an array that are folded at once
CHUNK = 256
#: characters of a text from block to block
BLOCK = 1 << 14
ROUNDS = 3
MIN_SEEDS = 5
MIN_SCORE = 0.8
#: Patterns up to this number are broadcast; more are joined by a shuffle. So are documents with added spans.
BROADCAST_ROWS = 200_000


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running combination (sum, maximum) of non-negative integers, in chunks.

    Appending copies an array, so one fold over n values would copy n^2 / 2; chunks of
    CHUNK and a fold over their totals copy n * CHUNK / 2 + (n / CHUNK)^2 / 2.
    """
    nothing = F.array().cast("array<int>")

    def scan(part: Column, before: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            return F.struct(combine(a["at"], x).alias("at"), F.array_append(a["out"], combine(a["at"], x)).alias("out"))

        return F.aggregate(part, F.struct(before.alias("at"), nothing.alias("out")), step, lambda a: a["out"])

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), combine))
        return _bound(scan(totals, F.lit(0)), lambda t: F.flatten(F.transform(parts, lambda part, i: scan(part, F.coalesce(F.get(t, i - 1), F.lit(0))))))

    def cut_up(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        parts = F.transform(numbers, lambda c: F.slice(v, c * CHUNK + 1, CHUNK))
        return F.when(F.size(v) > 0, _bound(parts, whole)).otherwise(nothing)

    return _bound(values, cut_up)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, m) of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(ms: Column) -> Column:
        # what lies before a match, and the match: their lengths run up to the matches' ends
        lengths = F.zip_with(ms, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(ms)), lambda m, b: F.length(m) + F.length(b))
        ends = running(lengths, lambda a, x: a + x)
        return F.zip_with(ms, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("m")))

    nothing = F.array().cast("array<struct<start:int,end:int,m:string>>")
    return _bound(found, lambda ms: F.when(F.size(ms) > 0, placed(ms)).otherwise(nothing))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of up to 19 digits passes the check: every second digit from the right doubled."""
    digits = F.transform(F.filter(F.split(F.reverse(number), ""), lambda d: d != ""), lambda d: d.cast("int"))
    parts = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d) % 10 == 0


def _kept(found: Column, valid: Callable[[Column], Column], rank: int) -> Column:
    kept = F.filter(found, lambda s: valid(s["m"]))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["m"].alias("m")))


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, m) over all kinds, by start, then kind."""
    valid = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m.rlike(IP_VALID),
        "card": lambda m: luhn(_digits(m)),
        "phone": lambda m: F.length(_digits(m)).between(10, 15),
    }
    guard = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.contains("+")}
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    kinds = []
    for rank, kind in enumerate(KINDS):
        kept = _kept(matches(text, pattern[kind]), valid[kind], rank)
        kinds.append(F.when(guard[kind], kept).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,m:string>>")))
    return F.array_sort(F.concat(*kinds))


def _trimmed(s: Column) -> Column:
    """The span without punctuation at its ends."""
    lead = F.length(F.regexp_extract(s["m"], r"^[^\p{L}0-9+]*", 0))
    tail = F.length(F.regexp_extract(s["m"], r"[^\p{L}0-9]*$", 0))
    return F.struct((s["start"] + lead).alias("start"), (s["end"] - tail).alias("end"), F.substring(s["m"], lead + 1, F.length(s["m"]) - lead - tail).alias("m"))


def candidate_spans(text: Column, base: Column) -> Column:
    """Identifier-like words (an at sign between letters, or six digits and more) that meet no base span."""
    found = F.transform(matches(text, CANDIDATE), _trimmed)
    alike = F.filter(found, lambda s: s["m"].rlike("[A-Za-z0-9]@[A-Za-z0-9]") | (F.length(_digits(s["m"])) >= 6))

    def free(far: Column) -> Column:
        # far: by base span, the farthest end so far; of the spans that start before a candidate's end, none may reach into it
        def steps(s: Column) -> Column:
            def farther(n: Column, step: Column) -> Column:
                inside = (n + step <= F.size(base)) & (F.get(base, n + step - 1)["start"] < s["end"])
                return F.when(inside, n + step).otherwise(n)

            return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(28))]), F.lit(0), farther)

        return F.filter(alike, lambda s: F.coalesce(F.get(far, steps(s) - 1) <= s["start"], F.lit(True)))

    ends = running(F.transform(base, lambda b: b["end"]), lambda a, x: F.greatest(a, x))
    return F.when(text.rlike("[0-9@]"), _bound(ends, free)).otherwise(F.array().cast("array<struct<start:int,end:int,m:string>>"))


def blocks_of(text: Column) -> Column:
    """The text from every BLOCK-th character on, 2 * BLOCK characters each: a piece is found there without counting from the text's start."""
    numbers = F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int"))
    return F.when(F.length(text) > BLOCK, F.transform(numbers, lambda i: F.substring(text, i * BLOCK + 1, F.lit(2 * BLOCK)))).otherwise(F.array(text))


def piece(blocks: Column, text: Column, at: Column, length: Column) -> Column:
    """`length` characters from `at` (from 0) on."""
    near = F.substring(F.get(blocks, F.floor(at / BLOCK).cast("int")), at % BLOCK + 1, length)
    return F.when(length <= BLOCK, near).otherwise(F.substring(text, at + 1, length))


def _context(blocks: Column, text: Column, start: Column, end: Column) -> Column:
    """The lower-case words before and after, of at most 40 characters each; empty at the text's ends."""
    before = piece(blocks, text, F.greatest(start - 64, F.lit(0)), F.least(start, F.lit(64)))
    after = piece(blocks, text, end, F.lit(64))
    left = F.regexp_extract(before, r"([^ \t-\r]{1,40})[ \t-\r]*$", 1)
    right = F.regexp_extract(after, r"^[^ \t-\r]?[ \t-\r]*([^ \t-\r]{1,40})", 1)
    return F.array(F.concat(F.lit("<"), F.lower(left)), F.concat(F.lit(">"), F.lower(right)))


def read_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, h, base, seen) for every row: base spans, and base and candidate spans with their contexts."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), t.alias("t"))
    rows = rows.withColumn("base", base_spans(F.col("t")))
    rows = rows.withColumn("free", candidate_spans(F.col("t"), F.col("base"))).withColumn("blocks", blocks_of(F.col("t")))

    def placed(rank: Column, s: Column) -> Column:
        return F.struct(rank.alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), _context(F.col("blocks"), F.col("t"), s["start"], s["end"]).alias("patterns"))

    seen = F.concat(
        F.transform("base", lambda s: placed(s["rank"], s)), F.transform("free", lambda s: placed(F.lit(None).cast("int"), s)),
    )
    return rows.select("k", "h", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))).alias("base"), seen.alias("seen"))


def bootstrap(rows: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """(pattern, rank, score) of the patterns to trust, from rows as read_spans gives them."""
    seen = rows.select(F.explode("seen").alias("s")).select("s.m", "s.rank", F.explode("s.patterns").alias("pattern")).where("length(pattern) > 1")
    edges = cut(seen.groupBy("pattern", "m").agg(F.max("rank").alias("rank")))
    seeds = edges.where("rank is not null").groupBy("m").agg(F.max("rank").alias("rank")).withColumn("confidence", F.lit(1.0))
    hopeful = edges.where("rank is not null").groupBy("pattern", "rank").agg(F.count("*").alias("n_seeds")).where(F.col("n_seeds") >= min_seeds)
    total = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    pairs = cut(hopeful.join(total, "pattern"))
    known = seeds
    scored = None
    for _ in range(rounds):
        held = edges.select("pattern", "m").join(known, "m").groupBy("pattern", "rank").agg(F.sum("confidence").alias("mass"))
        scored = cut(pairs.join(held, ["pattern", "rank"]).select("pattern", "rank", "n_seeds", (F.col("mass") / (F.col("n") + 1)).alias("score")))
        good = scored.where(F.col("score") >= min_score)
        induced = (
            edges.where("rank is null").select("pattern", "m").join(good, "pattern").groupBy("m", "rank")
            .agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("confidence"))
            .join(seeds.select("m"), "m", "left_anti")
        )
        known = cut(seeds.unionByName(induced))
    return scored.where(F.col("score") >= min_score).select("pattern", "rank", "score")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def added_spans(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(k, h, added): candidate spans with a trusted pattern, of the best-scored kind, for the rows that have any."""
    free = (
        rows.select("k", "h", F.explode(F.filter("seen", lambda s: s["rank"].isNull())).alias("s"))
        .select("k", "h", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    )
    best = free.join(_small(cut(patterns)), "pattern").groupBy("k", "h", "start", "end").agg(F.max(F.struct("score", -F.col("rank"))).alias("b"))
    return best.groupBy("k", "h").agg(F.collect_list(F.struct("start", (-F.col("b.col2")).alias("rank"), "end")).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start, then kind."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, base, spans) for every row; spans holds base and added ones as (start, rank, end)."""
    rows = cut(read_spans(docs, key, text))
    added = cut(added_spans(rows, bootstrap(rows)))
    same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2"))
    joined = rows.join(_small(added.select(F.col("k").alias("k2"), F.col("h").alias("h2"), "added")), same, "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))
    return joined.select(F.col("k").alias(key), "h", "base", spans.alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with every span of the text replaced by its kind in angle brackets."""
    found = cut(find(docs, key, text).where("size(spans) > 0").select(F.col(key).alias("k"), "h", "spans")).dropDuplicates(["k", "h"])
    # the caller's columns travel in one struct, so that none can clash with the inner ones
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t"))
    same = F.col("id").eqNullSafe(F.col("k")) & (F.xxhash64("t") == F.col("h"))
    labels = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    t = F.col("t")

    def cleaned(far: Column) -> Column:
        def before(s: Column, i: Column) -> Column:
            # a span inside an earlier one leaves nothing of its own
            at = F.coalesce(F.get(far, i - 1), F.lit(0))
            kept = piece(F.col("blocks"), t, at, F.greatest(s["start"] - at, F.lit(0)))
            return F.concat(kept, F.when(s["end"] > at, F.get(labels, s["rank"])).otherwise(""))

        last = F.get(far, F.size(far) - 1)
        return F.concat(F.array_join(F.transform("spans", before), ""), F.substring(t, last + 1, F.length(t)))

    clean = _bound(running(F.transform("spans", lambda s: s["end"]), lambda a, x: F.greatest(a, x)), cleaned)
    out = rows.join(_small(found), same, "left").withColumn("blocks", F.when(F.col("spans").isNotNull(), blocks_of(t))).withColumn("clean", F.when(F.col("spans").isNotNull(), clean).otherwise(t))
    return out.select(*[F.col("clean").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def count_of(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("bigint")
