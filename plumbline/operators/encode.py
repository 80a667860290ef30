"""Projections, cleaning, encoders, binning and coded rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordering import exact_quantiles
from plumbline.operators.contracts import ContractError, levels
from plumbline.roles import require

UNKNOWN_CODE = -1.0


def recode_disguised_missing(df: DataFrame, mapping: Mapping[str, str], label: str = "unknown") -> DataFrame:
    """Replace a column's placeholder answer by ``label``; columns that are absent are skipped."""
    present = {c: v for c, v in mapping.items() if c in df.columns}
    return df.withColumns({c: F.when(F.col(c) == v, F.lit(label)).otherwise(F.col(c)) for c, v in present.items()})


def flag_above(df: DataFrame, column: str, threshold: float, flag: str) -> DataFrame:
    """Add a boolean flag for values strictly above the threshold; keeps every row."""
    return df.withColumn(flag, F.col(column) > F.lit(threshold))


def vocabulary(fit_df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted levels per column with ``idx`` 1..n. Grows with the number of levels, not rows."""
    order = Window.partitionBy("column").orderBy("level")
    return levels(fit_df, columns).withColumn("idx", F.row_number().over(order))


def vocabulary_map(fit_df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Fitted vocabulary as metadata: sorted level lists. The level count is bounded by the schema."""
    rows = levels(fit_df, columns).groupBy("column").agg(F.array_sort(F.collect_set("level")).alias("ls")).collect()
    found = {row["column"]: list(row["ls"]) for row in rows}
    return {c: found.get(c, []) for c in columns}


def one_hot(df: DataFrame, vocab: Mapping[str, Sequence[str]], keep: bool = False) -> DataFrame:
    """``<column>_<level>`` 0/1 columns from a fitted vocabulary; an unseen level is all zeros."""
    outputs = {
        f"{c}_{level}": F.coalesce((F.col(c) == F.lit(level)).cast("int"), F.lit(0))
        for c, ls in vocab.items()
        for level in ls
    }
    encoded = df.withColumns(outputs) if outputs else df
    return encoded if keep else encoded.drop(*vocab)


def index_levels(df: DataFrame, vocab: DataFrame, columns: Sequence[str], suffix: str = "_idx") -> DataFrame:
    """Level -> 1..n from a fitted vocabulary table; unseen or NULL -> 0."""
    out = df
    for c in columns:
        lookup = vocab.where(F.col("column") == c).select(F.col("level").alias(f"__l_{c}"), F.col("idx").alias(f"__i_{c}"))
        out = out.join(lookup, F.col(c).cast("string") == F.col(f"__l_{c}"), "left")
        out = out.withColumn(f"{c}{suffix}", F.coalesce(f"__i_{c}", F.lit(0))).drop(f"__l_{c}", f"__i_{c}")
    return out


def one_hot_sparse(df: DataFrame, vocab: DataFrame, columns: Sequence[str], out: str = "hot") -> DataFrame:
    """One-hot codes from a vocabulary table as ``struct<size, indices>``: the places that are 1, columns side by side.

    For vocabularies too large for a column per level: levels are joined, never
    listed on the driver; what is a scalar are the columns' sizes. Unseen and NULL
    levels have no place.
    """
    indexed = index_levels(df, vocab, columns, "__at")
    sizes = vocab.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    known = sizes.agg(F.map_from_entries(F.collect_list(F.struct("column", "n"))).alias("m")).scalar()
    width = [F.coalesce(F.try_element_at(F.col("__sizes"), F.lit(c)), F.lit(0)) for c in columns]
    before = F.lit(0).cast("bigint")
    places = []
    for c, n in zip(columns, width):
        places.append(F.when(F.col(f"{c}__at") > 0, before + F.col(f"{c}__at") - 1))
        before = before + n
    coded = indexed.withColumn("__sizes", known).withColumn(out, F.struct(before.alias("size"), F.array_compact(F.array(*places)).alias("indices")))
    return coded.drop("__sizes", *[f"{c}__at" for c in columns])


def codes_from_table(df: DataFrame, vocab: DataFrame, columns: Sequence[str], numeric: Sequence[str], out: str = "codes") -> DataFrame:
    """:func:`to_codes` with the vocabulary as a joined table: 0-based level positions, then numerics. Unseen levels fail the job."""
    indexed = index_levels(df, vocab, columns, "__at")

    def code(c: str) -> Column:
        message = F.concat(F.lit(f"unseen level in {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))
        return F.when(F.col(f"{c}__at") == 0, F.raise_error(message).cast("double")).otherwise((F.col(f"{c}__at") - 1).cast("double"))

    coded = indexed.withColumn(out, F.array(*[code(c) for c in columns], *[F.col(c).cast("double") for c in numeric]))
    return coded.drop(*[f"{c}__at" for c in columns])


def levels_from_table(df: DataFrame, vocab: DataFrame, columns: Sequence[str], codes: str = "codes") -> DataFrame:
    """The levels of :func:`codes_from_table`; a code that the table lacks gives NULL."""
    out = df
    for j, c in enumerate(columns):
        known = vocab.where(F.col("column") == c).select((F.col("idx") - 1).alias(f"__k_{c}"), F.col("level").alias(f"__v_{c}"))
        out = out.join(known, F.element_at(codes, j + 1).cast("int") == F.col(f"__k_{c}"), "left").withColumn(c, F.col(f"__v_{c}")).drop(f"__k_{c}", f"__v_{c}")
    return out


def vocabulary_sizes(vocab: DataFrame) -> DataFrame:
    """Index space per column: the number of levels plus one for unknown."""
    return vocab.groupBy("column").agg((F.count(F.lit(1)) + 1).alias("size"))


def standardize(df: DataFrame, fit_df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population std of the fitted part; a zero std scales by 1."""
    stats = fit_df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        ).alias("s")
    ).scalar()
    out = df.withColumn("__s", stats)
    scaled = {}
    for c in columns:
        std = F.col("__s")[f"s_{c}"]
        scaled[c] = (F.col(c) - F.col("__s")[f"m_{c}"]) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    return out.withColumns(scaled).drop("__s")


def tree_branch(
    df: DataFrame, fit_df: DataFrame, categorical: Sequence[str], placeholders: Mapping[str, str],
    outlier: tuple[str, float, str],
) -> DataFrame:
    """Clean, flag the outlier, one-hot encode with the fitted part's vocabulary."""
    column, threshold, flag = outlier

    def clean(part: DataFrame) -> DataFrame:
        return flag_above(recode_disguised_missing(part, placeholders), column, threshold, flag)

    return one_hot(clean(df), vocabulary_map(clean(fit_df), categorical))


def index_branch(
    df: DataFrame, fit_df: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
    placeholders: Mapping[str, str], outlier: tuple[str, float, str],
) -> DataFrame:
    """Clean, flag the outlier, index levels and scale numerics with the fitted part's state."""
    column, threshold, flag = outlier

    def clean(part: DataFrame) -> DataFrame:
        return flag_above(recode_disguised_missing(part, placeholders), column, threshold, flag)

    fitted = clean(fit_df)
    indexed = index_levels(clean(df), vocabulary(fitted, categorical), categorical)
    return standardize(indexed, fitted, numeric)


def stratify_key(group: str, target: str | None = None) -> Column:
    """``group_target`` text, or the group alone."""
    if target is None:
        return F.col(group).cast("string")
    return F.concat(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit("_"), F.coalesce(F.col(target).cast("string"), F.lit("")))


def encode_strict(df: DataFrame, vocab: Mapping[str, Sequence[str]], numeric: Sequence[str]) -> DataFrame:
    """One-hot and pass numerics; an unknown level or a NULL number fails the job."""
    overlap = set(vocab) & set(numeric)
    if overlap:
        raise ContractError(f"features encoded twice: {sorted(overlap)}")
    missing = [c for c in (*vocab, *numeric) if c not in df.columns]
    if missing:
        raise ContractError(f"features are missing: {missing}")
    guarded = {}
    for c, ls in vocab.items():
        known = F.coalesce(F.col(c).isin(list(ls)), F.lit(False))
        message = F.concat(F.lit(f"unknown level in {c}: "), F.coalesce(F.col(c), F.lit("NULL")))
        guarded[c] = F.when(known, F.col(c)).otherwise(F.raise_error(message).cast("string"))
    for c in numeric:
        guarded[c] = F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"missing number in {c}")).cast("double"))
    return one_hot(df.withColumns(guarded), vocab)


def to_codes(df: DataFrame, vocab: Mapping[str, Sequence[str]], numeric: Sequence[str], out: str = "codes") -> DataFrame:
    """One ``array<double>`` per row: 0-based level positions, then numerics. Unseen levels fail the job."""
    cells = []
    for c, ls in vocab.items():
        position = F.array_position(F.array(*[F.lit(level) for level in ls]), F.col(c))
        bad = F.coalesce(position, F.lit(0)) == 0
        message = F.concat(F.lit(f"unseen level in {c}: "), F.coalesce(F.col(c), F.lit("NULL")))
        cells.append(F.when(bad, F.raise_error(message).cast("double")).otherwise((position - 1).cast("double")))
    cells += [F.col(c).cast("double") for c in numeric]
    return df.withColumn(out, F.array(*cells))


def from_codes(df: DataFrame, vocab: Mapping[str, Sequence[str]], numeric: Sequence[str], codes: str = "codes") -> DataFrame:
    """Inverse of :func:`to_codes`; code -1 gives a NULL level."""
    outputs = {}
    for j, (c, ls) in enumerate(vocab.items()):
        code = F.element_at(codes, j + 1).cast("int")
        outputs[c] = F.when(code >= 0, F.element_at(F.array(*[F.lit(level) for level in ls]), code + 1))
    for j, c in enumerate(numeric):
        outputs[c] = F.element_at(codes, len(vocab) + j + 1)
    return df.withColumns(outputs)


def baseline_point(df: DataFrame, vocab: DataFrame, categorical: Sequence[str], numeric: Sequence[str], kind: str) -> DataFrame:
    """Reference point as ``(feature, value)``: modal or unknown level codes, numeric means.

    Modal ties go to the lowest code.
    """
    require(kind in ("unknown", "modal"), f"unknown baseline {kind!r}")
    means = df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(c).alias("value")) for c in numeric]).alias("a"))
    numbers = means.select(F.inline("a"))
    if kind == "unknown":
        unknown = vocab.where(F.col("column").isin(list(categorical))).select(F.col("column").alias("feature")).distinct()
        return unknown.withColumn("value", F.lit(UNKNOWN_CODE)).unionByName(numbers)
    from plumbline.functions.scalars import unpivot_text

    counted = unpivot_text(df, [], categorical).groupBy("column", "level").agg(F.count(F.lit(1)).alias("c"))
    coded = counted.join(vocab, ["column", "level"])
    modal = coded.groupBy("column").agg(F.max_by((F.col("idx") - 1).cast("double"), F.struct(F.col("c"), -F.col("idx"))).alias("value"))
    return modal.withColumnRenamed("column", "feature").unionByName(numbers)


def select_scenario(df: DataFrame, conditions: Mapping[str, Sequence[str]], group: tuple[str, str] | None = None, must_match: bool = False) -> DataFrame:
    """Rows whose columns take the listed values, optionally of one group. ``must_match`` raises on none."""
    out = df
    for c, values in conditions.items():
        out = out.where(F.col(c).isin(list(values)))
    if group is not None:
        out = out.where(F.col(group[0]) == group[1])
    if must_match and out.limit(1).count() == 0:
        raise ContractError("no row matches the scenario")
    return out


def right_closed_bin(value: Column, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """0-based bin of ``(e0, e1], (e1, e2], ...``; NULL outside the edges."""
    require(len(edges) >= 2 and all(a < b for a, b in zip(edges[:-1], edges[1:])), "edges must increase")
    first = (value >= edges[0]) if include_lowest else (value > edges[0])
    expr: Column | None = None
    for i, high in enumerate(edges[1:]):
        inside = (value <= high) & first if i == 0 else value <= high
        expr = F.when(~first, F.lit(None)).when(inside, F.lit(i)) if expr is None else expr.when(inside, F.lit(i))
    return expr


def cut(df: DataFrame, column: str, edges: Sequence[float], out: str = "bin", include_lowest: bool = False) -> DataFrame:
    """Right-closed fixed bins."""
    return df.withColumn(out, right_closed_bin(F.col(column), edges, include_lowest))


def qcut_edges(df: DataFrame, column: str, q: int) -> DataFrame:
    """One row with ``edges``: deduplicated linear quantiles 0, 1/q, ..., 1."""
    require(q >= 2, "q must be at least 2")
    names = {f"q{i}": i / q for i in range(q + 1)}
    found = exact_quantiles(df, column, names)
    return found.select(F.array_distinct(F.array(*names)).alias("edges"))


def qcut(df: DataFrame, column: str, q: int, out: str = "bin") -> DataFrame:
    """Quantile bins, right-closed with the lowest value included. At most ``q`` edges travel."""
    with_edges = df.withColumn("__e", qcut_edges(df, column, q).scalar())
    below = F.size(F.filter("__e", lambda e: e < F.col(column)))
    binned = F.when(F.col(column).isNull(), F.lit(None)).otherwise(F.greatest(below - 1, F.lit(0)))
    return with_edges.withColumn(out, binned.cast("int")).drop("__e")


def nudge(df: DataFrame, columns: Sequence[str], bounds: Mapping[str, tuple[float, float]], step: float = 1.0) -> DataFrame:
    """-step and +step copies of each row per numeric column, marked valid inside the bounds."""
    moves = F.explode(F.array(*[F.struct(F.lit(c).alias("nudged"), F.lit(d).alias("delta")) for c in columns for d in (-step, step)]))
    moved = df.withColumn("__m", moves).withColumns({"nudged": F.col("__m.nudged"), "delta": F.col("__m.delta")}).drop("__m")
    shifted = {c: F.col(c) + F.when(F.col("nudged") == c, F.col("delta")).otherwise(F.lit(0.0)) for c in columns}
    valid: Column = F.lit(True)
    for c in columns:
        low, high = bounds[c]
        valid = valid & ((F.col("nudged") != c) | F.col(c).between(low, high))
    return moved.withColumns(shifted).withColumn("valid", valid)


def standardize_vectors(df: DataFrame, fit_df: DataFrame, vector: str = "embedding", row_id: str = "row_id") -> DataFrame:
    """Long ``(row_id, dim, value)`` scaled per dimension by the fitted part's mean and population std."""
    def long(part: DataFrame) -> DataFrame:
        return part.select(row_id, F.posexplode(vector).alias("dim", "x"))

    stats = long(fit_df).groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    joined = long(df).join(stats, "dim")
    return joined.select(row_id, "dim", ((F.col("x") - F.col("m")) / (F.col("s") + 1e-8)).alias("value"))


def score_to_label(df: DataFrame, threshold: float, positive: str = "Yes", negative: str = "No") -> DataFrame:
    """Label at ``score >= threshold`` and the confidence of that label."""
    hit = F.col("score") >= F.lit(threshold)
    return df.withColumn("label", F.when(hit, positive).otherwise(negative)).withColumn(
        "confidence", F.when(hit, F.col("score")).otherwise(1 - F.col("score"))
    )


def drop_features(df: DataFrame, always: Sequence[str], group: str, use_group: bool) -> DataFrame:
    """Remove id, year and target columns, and the group when it is held out."""
    return df.drop(*always, *([] if use_group else [group]))


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Chain DataFrame transformations."""
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run
