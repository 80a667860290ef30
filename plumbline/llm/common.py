"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word separators of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\u000b\f\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Runs of characters that are none of BLANKS, in order; NULL text has none."""
    spaced = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(text: Column) -> Column:
    """The text's bytes, empty for NULL."""
    return F.coalesce(text, F.lit("")).cast("binary")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, longer if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow with columns as lists: fn gets and yields dicts of equally long lists."""
    target = T._parse_datatype_string(schema)
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in target.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def add_columns(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, *inputs: Column) -> DataFrame:
    """df with the columns of `schema` added; fn gets the inputs by alias, as lists, a batch at a time.

    Other columns pass as Arrow data, whatever their types; a clashing one is replaced.
    """
    new = T._parse_datatype_string(schema)
    kept = [c for c in df.columns if c not in new.names]
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(len(kept)).flatten()
            got = fn({f.name: v.to_pylist() for f, v in zip(b.schema.field(len(kept)).type, values)})
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(kept))] + [pa.array(got[f.name], f.type) for f in arrow],
                names=kept + arrow.names,
            )

    source = df.select(*[df[f"`{c}`"] for c in kept], F.struct(*inputs).alias(free_name(df, "inputs")))
    return source.mapInArrow(run, T.StructType([df.schema[c] for c in kept] + new.fields))


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in t.fields])
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "smallint": pa.int16(),
    }[t.simpleString()]
