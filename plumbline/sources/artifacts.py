"""Score files, attribution sets and sample sets as Parquet with commit marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.session import cut
from plumbline.operators.contracts import ContractError, check_attribution

UNIT = ["design", "arm", "seed", "fold"]
ATTRIBUTION_VERSION = 1


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Finished units; empty before the first commit."""
    schema = "design string, arm string, seed int, fold int, seconds double, device string, val_rows bigint"
    if not path_exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/manifest")


def pending(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned units that have no commit mark yet."""
    return plan.join(done.select(*UNIT), UNIT, "left_anti")


def write_oof(scores: DataFrame, path: str, seconds: float = 0.0, device: str = "cpu") -> None:
    """Write score rows of one or more units, then their commit marks.

    A lost job leaves no mark, so its units stay pending; rewriting a unit
    replaces its partition and its mark.
    """
    stored = cut(scores)  # scored once: for the rows and for the marks
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*UNIT).parquet(f"{path}/scores")
    marks = stored.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("val_rows")).select(
        F.col("design").cast("string"), F.col("arm").cast("string"), F.col("seed").cast("int"), F.col("fold").cast("int"),
        F.lit(float(seconds)).alias("seconds"), F.lit(device).alias("device"), "val_rows",
    )
    marks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*UNIT).parquet(f"{path}/manifest")


def read_oof(
    spark: SparkSession, path: str, design: str, arms: Sequence[str], n_seeds: int, n_folds: int, row_ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(scores, excluded arms): only arms with every fold committed, covering every row exactly once per seed.

    Rows of units without a mark are not read. Wrong coverage raises.
    """
    done = manifest(spark, path).where((F.col("design") == design) & F.col("arm").isin(list(arms)))
    counted = done.select(*UNIT).distinct().groupBy("arm").agg(F.count(F.lit(1)).alias("n_folds"))
    wanted = spark.createDataFrame([(a,) for a in arms], "arm string")
    listed = wanted.join(counted, "arm", "left").withColumn("n_folds", F.coalesce("n_folds", F.lit(0)))
    complete = listed.where(F.col("n_folds") == n_seeds * n_folds).select("arm")
    marked = done.join(complete, "arm", "left_semi").select(*UNIT).distinct()
    scores = spark.read.parquet(f"{path}/scores").where(F.col("design") == design).join(marked, UNIT, "left_semi")
    return check_coverage(scores, row_ids), listed.where(F.col("n_folds") != n_seeds * n_folds)


def coverage_report(scores: DataFrame, row_ids: DataFrame) -> DataFrame:
    """Per arm and seed: rows seen more than once, missing rows and unknown rows."""
    per_row = scores.groupBy("arm", "seed", "row_id").agg(F.count(F.lit(1)).alias("c"))
    known = row_ids.select("row_id", F.lit(1).alias("__k"))
    joined = per_row.join(known, "row_id", "left")
    expected = row_ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = joined.groupBy("arm", "seed").agg(
        F.count_if(F.col("c") > 1).alias("repeated"), F.count_if(F.col("__k").isNull()).alias("unknown"),
        F.count("__k").alias("__seen"),
    )
    return found.withColumn("missing", expected - F.col("__seen")).drop("__seen")


def check_coverage(scores: DataFrame, row_ids: DataFrame) -> DataFrame:
    """Return ``scores``, or raise unless each arm and seed covers every row exactly once."""
    bad = coverage_report(scores, row_ids).where("repeated > 0 OR unknown > 0 OR missing > 0").first()
    if bad is not None:
        raise ContractError(f"out-of-fold rows do not cover every row exactly once: {bad.asDict()}")
    return scores


def save_attributions(values: DataFrame, header: DataFrame, path: str) -> str:
    """Long values partitioned by set, then the header with its format version."""
    check_attribution(values, header)
    values.write.mode("overwrite").partitionBy("set_id").parquet(f"{path}/values")
    header.withColumn("format_version", F.lit(ATTRIBUTION_VERSION)).write.mode("overwrite").parquet(f"{path}/header")
    return path


def load_attributions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    header = spark.read.parquet(f"{path}/header")
    other = header.where(F.col("format_version") != ATTRIBUTION_VERSION).first()
    if other is not None:
        raise ContractError(f"unsupported attribution format {other['format_version']}")
    return spark.read.parquet(f"{path}/values"), header


def save_sample_sets(sets: DataFrame, data_fingerprint: DataFrame, path: str) -> str:
    """Row selections, and the fingerprint of the data they were drawn from."""
    sets.write.mode("overwrite").partitionBy("set_name").parquet(f"{path}/rows")
    data_fingerprint.write.mode("overwrite").parquet(f"{path}/fingerprint")
    return path


def load_sample_sets(spark: SparkSession, path: str, data_fingerprint: DataFrame) -> DataFrame:
    """The selections, or raise when the data have changed since."""
    stored = spark.read.parquet(f"{path}/fingerprint").first()
    current = data_fingerprint.first()
    if (stored["n_rows"], stored["content_hash"]) != (current["n_rows"], current["content_hash"]):
        raise ContractError("sample sets were drawn from other data")
    return spark.read.parquet(f"{path}/rows")
