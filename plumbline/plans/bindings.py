"""Role bindings: the given tables seen as surveys, score files, logs and attributions.

Every binding exists twice, as a DataFrame and as SQL text, so that a query and
its check read the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import hash_int


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_key(seed: str, *values: str) -> str:
    """SQL text of :func:`plumbline.functions.hashing.hash_key`."""
    return "md5('" + seed + "'" + "".join(f" || '|' || CAST({v} AS VARCHAR)" for v in values) + ")"


def sql_int(seed: str, *values: str) -> str:
    return f"CAST('0x' || substr({sql_key(seed, *values)}, 1, 15) AS BIGINT)"


def r6(col: Column | str) -> Column:
    """Six decimals, so that both engines print the same digits."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


# --- documents with labels ---------------------------------------------------

DOCS = """docs AS (
  SELECT d.doc_id AS row_id, d.lang AS grp, d.source AS source, d.n_chars AS n_chars,
         l.quality AS y, l.toxic AS toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("grp"), "source", "n_chars", F.col("quality").alias("y"), "toxic"
    )


# --- orders as a survey -------------------------------------------------------

SALES = """sales AS (
  SELECT o.o_orderkey AS row_id, r.r_name AS grp, n.n_name AS nation,
         CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
         o.o_orderpriority AS priority, c.c_mktsegment AS segment,
         o.o_totalprice AS price, c.c_acctbal AS balance, o.o_orderdate AS order_date,
         year(o.o_orderdate) AS order_year
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def sales(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    joined = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
    )
    return joined.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("r_name").alias("grp"),
        F.col("n_name").alias("nation"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("balance"),
        F.col("o_orderdate").alias("order_date"),
        F.year("o_orderdate").alias("order_year"),
    )


# --- scores: a hash draw that leans towards the target -------------------------

def arm_score(arm: str, lean: int = 300, seed: Column | str | None = None) -> Column:
    extra = [] if seed is None else [seed]
    return (hash_int(f"score-{arm}", *extra, "row_id") % (1000 - lean) + lean * F.col("y")) / F.lit(1000.0)


def sql_arm_score(arm: str, lean: int = 300, seed: str | None = None, prefix: str = "") -> str:
    extra = [] if seed is None else [seed]
    return f"(({sql_int(f'score-{arm}', *extra, prefix + 'row_id')} % {1000 - lean}) + {lean} * {prefix}y) / 1000.0"


def with_cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- events as a prediction log -------------------------------------------------

EVENTS = """ev AS (
  SELECT event_id AS row_id, ts, user_id, event_type, value,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         CAST(ts AS DATE) AS day
  FROM events)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("row_id"), "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.to_date("ts").alias("day"),
    )


# --- embeddings as attributions ---------------------------------------------------

def attribution(spark: SparkSession, sf: str, first: int, last: int, set_id: str) -> DataFrame:
    """Vector positions first..last (1-based) as features f1..fn of one attribution set."""
    e = table(spark, sf, "embeddings")
    part = F.slice(F.col("embedding"), first, last - first + 1)
    long = e.select(F.lit(set_id).alias("set_id"), F.col("vec_id").alias("row_id"), F.col("label").alias("grp"), F.posexplode(part).alias("pos", "v"))
    return long.select(
        "set_id", "row_id", "grp", (F.col("pos") + 1).alias("pos"),
        F.concat(F.lit("f"), F.lpad((F.col("pos") + 1).cast("string"), 2, "0")).alias("feature"), F.col("v").cast("double").alias("value"),
    )


def sql_attribution(name: str, first: int, last: int, set_id: str) -> str:
    n = last - first + 1
    return f"""{name} AS (
  SELECT '{set_id}' AS set_id, e.vec_id AS row_id, e.label AS grp, CAST(i.pos AS INTEGER) AS pos,
         'f' || lpad(CAST(i.pos AS VARCHAR), 2, '0') AS feature, CAST(e.embedding[{first - 1} + i.pos] AS DOUBLE) AS value
  FROM embeddings e, (SELECT unnest(range(1, {n + 1})) AS pos) i)"""
