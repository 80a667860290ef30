"""Data contracts: schemas, keys, vocabularies, records, alignment and parity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import unpivot_text
from plumbline.roles import require


class ContractError(ValueError):
    """The data do not satisfy the stated contract."""


def check_schema(df: DataFrame, expected: Mapping[str, T.DataType]) -> DataFrame:
    """Return ``df`` unchanged, or raise on a missing column, then on a wrong type. Runs no job."""
    actual = {field.name: field.dataType for field in df.schema.fields}
    missing = sorted(set(expected) - set(actual))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    wrong = {c: (actual[c].simpleString(), t.simpleString()) for c, t in expected.items() if actual[c] != t}
    if wrong:
        raise ContractError(f"column types differ (actual, expected): {wrong}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows read and rows beyond the first of each key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def check_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``df``, or raise when a key repeats. Runs one aggregate."""
    duplicates = duplicate_keys(df, keys).first()["duplicate_rows"]
    if duplicates:
        raise ContractError(f"{duplicates} rows repeat the key {list(keys)}")
    return df


def key_report(df: DataFrame, candidates: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows and duplicates for each candidate key, from one scan."""
    names = list(candidates)
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.countDistinct(F.struct(*candidates[n])).alias(f"d{i}") for i, n in enumerate(names)],
    )
    entries = F.array(
        *[F.struct(F.lit(n).alias("candidate"), F.col(f"d{i}").alias("d")) for i, n in enumerate(names)]
    )
    return counted.select("n_rows", F.explode(entries).alias("e")).select(
        F.col("e.candidate").alias("candidate"), "n_rows", (F.col("n_rows") - F.col("e.d")).alias("duplicate_rows")
    )


def levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct ``(column, level)`` pairs, NULL excluded."""
    return unpivot_text(df, [], columns).where(F.col("level").isNotNull()).distinct()


def unseen_levels(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Levels found in ``test`` but not in ``train``."""
    return levels(test, columns).join(levels(train, columns), ["column", "level"], "left_anti")


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-NULL levels per column, largest first."""
    found = levels(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_levels"))
    return found.orderBy(F.desc("n_levels"), "column")


def null_counts(df: DataFrame, columns: Sequence[str], group: str, total: str = "ALL") -> DataFrame:
    """NULL cells per column and group, and over all rows."""
    counted = df.rollup(group).agg(
        F.grouping(group).alias("__g"), *[F.sum(F.col(c).isNull().cast("bigint")).alias(f"n{i}") for i, c in enumerate(columns)]
    )
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)])
    named = F.when(F.col("__g") == 1, F.lit(total)).otherwise(F.col(group))
    return counted.select(named.alias(group), F.explode(entries).alias("e")).select(
        F.col("e.column").alias("column"), group, F.col("e.n").alias("n_null")
    )


def validate_records(
    df: DataFrame,
    record: str,
    enums: Mapping[str, Sequence[str]],
    ranges: Mapping[str, tuple[int, int]],
) -> DataFrame:
    """Check JSON records against closed enums, strict integer ranges and no extra fields.

    Adds ``errors`` (one message per offending field) and ``is_valid``. A
    number in quotes, a fraction or a boolean is not an integer here.
    """
    parsed = F.try_parse_json(F.col(record))
    allowed = [*enums, *ranges]

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))

    checks: list[Column] = []
    for field, values in enums.items():
        text = F.try_variant_get(parsed, f"$.{field}", "string")
        bad = text.isNull() | ~text.isin(list(values)) | (kind(field) != "STRING")
        checks.append(F.when(F.coalesce(bad, F.lit(True)), F.lit(f"{field}: not an allowed value")))
    for field, (low, high) in ranges.items():
        number = F.try_variant_get(parsed, f"$.{field}", "bigint")
        bad = (kind(field) != "BIGINT") | number.isNull()
        outside = ~number.between(low, high)
        checks.append(
            F.when(F.coalesce(bad, F.lit(True)), F.lit(f"{field}: not an integer")).when(
                outside, F.lit(f"{field}: outside {low}..{high}")
            )
        )
    keys = F.map_keys(F.from_json(F.col(record), T.MapType(T.StringType(), T.StringType())))
    extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(a) for a in allowed])))
    extra_messages = F.transform(F.coalesce(extra, F.array().cast("array<string>")), lambda k: F.concat(k, F.lit(": unknown field")))
    errors = F.when(parsed.isNull(), F.array(F.lit("record: not valid JSON"))).otherwise(
        F.concat(F.array_compact(F.array(*checks)), extra_messages)
    )
    return df.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and quarantined rows of :func:`validate_records`."""
    return checked.where("is_valid").drop("errors", "is_valid"), checked.where("NOT is_valid")


def vocabulary_diff(schema_levels: DataFrame, data_levels: DataFrame) -> DataFrame:
    """Levels on one side only, from two ``(column, level)`` tables."""
    left = schema_levels.select("column", "level", F.lit(True).alias("__a"))
    right = data_levels.select("column", "level", F.lit(True).alias("__b"))
    joined = left.join(right, ["column", "level"], "full_outer")
    side = F.when(F.col("__b").isNull(), "schema_only").otherwise("data_only")
    return joined.where(F.col("__a").isNull() | F.col("__b").isNull()).select("column", "level", side.alias("side"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free content hash: row count and two sums of 60-bit row hashes as text.

    A value counts with its length in front and NULL as a mark of its own, so that
    neither separators nor empty texts make different rows alike.
    """
    cells = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("N")) for c in columns]
    key = F.md5(F.concat(*cells))

    def total(start: int) -> Column:
        return F.coalesce(F.sum(F.conv(F.substring(key, start, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")

    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", total(1), total(17)).alias("content_hash"))


def check_fingerprint(df: DataFrame, columns: Sequence[str], stored: tuple[int, str]) -> DataFrame:
    """Return ``df``, or raise when its content is not what the artifact was built from."""
    row = fingerprint(df, columns).first()
    if (row["n_rows"], row["content_hash"]) != tuple(stored):
        raise ContractError(f"data fingerprint {tuple(row)} differs from the stored {tuple(stored)}")
    return df


def ood_warnings(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``warnings``: one message for each integer column above its training maximum."""
    limits = train.agg(F.struct(*[F.max(c).cast("bigint").alias(c) for c in columns]).alias("m")).scalar()
    with_limits = df.withColumn("__max", limits)
    messages = [
        F.when(
            F.col(c) > F.col("__max")[c],
            F.concat(
                F.lit(f"{c}="),
                F.col(c).cast("string"),
                F.lit(" exceeds the training maximum of "),
                F.col("__max")[c].cast("string"),
                F.lit("; prediction is an extrapolation"),
            ),
        )
        for c in columns
    ]
    return with_limits.withColumn("warnings", F.array_compact(F.array(*messages))).drop("__max")


def alignment_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of two attribution tables present on both sides or on one side only."""
    left = a.select("row_id", "feature", F.lit(1).alias("__a"))
    right = b.select("row_id", "feature", F.lit(1).alias("__b"))
    joined = left.join(right, ["row_id", "feature"], "full_outer")
    return joined.agg(
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("aligned"),
        F.count_if(F.col("__b").isNull()).alias("only_a"),
        F.count_if(F.col("__a").isNull()).alias("only_b"),
    )


def check_aligned(a: DataFrame, b: DataFrame) -> None:
    """Raise unless both attribution tables cover the same rows and features."""
    row = alignment_report(a, b).first()
    if row["only_a"] or row["only_b"]:
        raise ContractError(f"attributions are not aligned: {row.asDict()}")


def score_parity(a: DataFrame, b: DataFrame, atol: float, threshold: float, by: Sequence[str] = ("row_id",)) -> DataFrame:
    """Differences between two scorings of the same rows, and decision flips.

    A flip is borderline when either score lies within ``atol`` of the threshold.
    """
    require(atol > 0, "atol must be positive")
    joined = a.select(*by, F.col("score").alias("__s")).join(b.select(*by, F.col("score").alias("__t")), list(by))
    diff = F.abs(F.col("__s") - F.col("__t"))
    flip = (F.col("__s") >= threshold) != (F.col("__t") >= threshold)
    near = (F.abs(F.col("__s") - threshold) <= atol) | (F.abs(F.col("__t") - threshold) <= atol)
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(diff).alias("max_abs_diff"),
        F.avg(diff).alias("mean_abs_diff"),
        F.count_if(diff > atol).alias("n_beyond_atol"),
        F.count_if(flip).alias("n_flips"),
        F.count_if(flip & ~near).alias("n_flips_outside_band"),
    )


def reproduction_gate(new: DataFrame, reported: DataFrame, tol: float) -> DataFrame:
    """Per arm and metric: difference of fold means, largest fold difference, within tolerance."""
    require(tol > 0, "tol must be positive")
    keys = ["arm", "fold", "metric"]
    joined = new.select(*keys, F.col("value").alias("__new")).join(
        reported.select(*keys, F.col("value").alias("__old")), keys
    )
    gate = joined.groupBy("arm", "metric").agg(
        F.count(F.lit(1)).alias("folds"),
        (F.avg("__new") - F.avg("__old")).alias("mean_difference"),
        F.max(F.abs(F.col("__new") - F.col("__old"))).alias("max_fold_difference"),
    )
    return gate.withColumn("within", F.abs("mean_difference") <= tol)


def completion_report(grid: DataFrame, manifest: DataFrame, keys: Sequence[str], arm: str = "arm") -> DataFrame:
    """Finished and expected work per arm, with hours and devices from the manifest."""
    done = manifest.select(*keys, "seconds", "device", F.lit(1).alias("__done"))
    joined = grid.select(*keys).join(done, list(keys), "left")
    return joined.groupBy(arm).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("__done").alias("finished"),
        (F.count(F.lit(1)) - F.count("__done")).alias("missing"),
        (F.coalesce(F.sum("seconds"), F.lit(0)) / 3600.0).alias("hours"),
        F.array_join(F.array_sort(F.collect_set("device")), ",").alias("devices"),
    )


def attribution_report(df: DataFrame, header: DataFrame) -> DataFrame:
    """Per attribution set: non-finite values, repeated cells and header rows."""
    cells = df.groupBy("set_id", "row_id", "feature").agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).alias("bad"),
    )
    body = cells.groupBy("set_id").agg(
        F.sum("c").alias("n_values"),
        F.sum("bad").alias("n_not_finite"),
        F.sum(F.col("c") - 1).alias("n_repeated"),
        F.countDistinct("feature").alias("n_features"),
    )
    heads = header.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_headers"))
    return body.join(heads, "set_id", "left").withColumn("n_headers", F.coalesce("n_headers", F.lit(0)))


def check_attribution(df: DataFrame, header: DataFrame) -> DataFrame:
    """Return ``df``, or raise when a set has bad values, repeated cells or not exactly one header."""
    bad = attribution_report(df, header).where("n_not_finite > 0 OR n_repeated > 0 OR n_headers <> 1")
    row = bad.first()
    if row is not None:
        raise ContractError(f"attribution set is malformed: {row.asDict()}")
    return df


def finite_score_gate(df: DataFrame, score: str = "score") -> DataFrame:
    """Fail the job on a NULL, NaN or infinite score; otherwise pass rows through."""
    value = F.col(score)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return df.withColumn(score, F.when(bad, F.raise_error(F.lit("non-finite score"))).otherwise(value))
