"""Survey tables: CSV scans with an enforced schema, and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.contracts import ContractError, check_unique_key
from plumbline.operators.encode import vocabulary

# The survey's columns in file order.
SURVEY_INTEGERS = ("year", "household_size", "age_of_respondent")
SURVEY_COLUMNS = (
    "country", "year", "uniqueid", "location_type", "cellphone_access", "household_size", "age_of_respondent",
    "gender_of_respondent", "relationship_with_head", "marital_status", "education_level", "job_type",
)
SURVEY_TARGET = "bank_account"
SURVEY_KEY = ("uniqueid", "country", "year")


def survey_schema(with_target: bool) -> T.StructType:
    fields = [T.StructField(c, T.LongType() if c in SURVEY_INTEGERS else T.StringType()) for c in SURVEY_COLUMNS]
    if with_target:
        fields.insert(3, T.StructField(SURVEY_TARGET, T.StringType()))
    return T.StructType(fields)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV table; reads one line."""
    return spark.read.option("header", True).csv(path).columns


def read_survey(
    spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], target: str | None = None
) -> DataFrame:
    """CSV scan by column name with strict types and a unique key.

    Missing columns, cells of the wrong type and repeated keys raise. ``target``
    names the column that must be present in a training table.
    """
    header = read_header(spark, path)
    expected = [*schema.fieldNames(), *([target] if target and target not in schema.fieldNames() else [])]
    missing = [c for c in expected if c not in header]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    by_name = {f.name: f for f in schema.fields}
    full = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in header])
    df = spark.read.schema(full).options(header=True, mode="FAILFAST", enforceSchema=False).csv(path)
    return check_unique_key(df.select(*expected), key)


def read_raw_records(spark: SparkSession, path: str, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Only the named columns of a CSV; a missing column or a number that is not an integer fails."""
    header = read_header(spark, path)
    missing = [c for c in (*categorical, *numeric) if c not in header]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    text = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).option("header", True).csv(path)

    def integer(c: str):
        value = F.col(c).try_cast("bigint")
        strict = F.col(c).rlike("^-?[0-9]+$") & value.isNotNull()
        message = F.concat(F.lit(f"{c} is not an integer: "), F.coalesce(F.col(c), F.lit("NULL")))
        return F.when(F.coalesce(strict, F.lit(False)), value).otherwise(F.raise_error(message).cast("bigint")).alias(c)

    return text.select(*categorical, *[integer(c) for c in numeric])


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write a result table as CSV or JSON."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown report format {fmt!r}")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)
    return path


def write_checkpoints(train: DataFrame, test: DataFrame, columns: Sequence[str], path: str) -> str:
    """Write the cleaned or encoded parts and the training vocabulary with its sizes."""
    train.write.mode("overwrite").parquet(f"{path}/train")
    test.write.mode("overwrite").parquet(f"{path}/test")
    vocabulary(train, columns).write.mode("overwrite").parquet(f"{path}/vocabulary")
    return path


def training_metadata(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """One row: levels and ranges per feature, row count and a content-addressed version."""
    aggregates = [F.array_join(F.array_sort(F.collect_set(c)), "|").alias(f"levels_{c}") for c in categorical]
    aggregates += [F.min(c).cast("bigint").alias(f"min_{c}") for c in numeric]
    aggregates += [F.max(c).cast("bigint").alias(f"max_{c}") for c in numeric]
    found = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggregates)
    content = [c for c in found.columns]
    return found.withColumn("version", F.substring(F.sha2(F.concat_ws(";", *[F.col(c).cast("string") for c in content]), 256), 1, 12))


def data_version(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Content-addressed version of a table: sha-256 over its order-free fingerprint."""
    from plumbline.operators.contracts import fingerprint

    return fingerprint(df, columns).withColumn("version", F.substring(F.sha2(F.concat_ws(";", F.col("n_rows").cast("string"), "content_hash"), 256), 1, 12))
