"""Seeded hash draws.

Random draws come from ``md5(seed|value|...)`` instead of a generator, so a
draw depends on the row and the seed only, never on how Spark partitioned the
rows or how often a task was retried.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 15  # 60 bits: fits a BIGINT, and the modulo bias is negligible


def _text(value: Column | str) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.coalesce(col.cast("string"), F.lit(""))


def hash_key(seed: object, *values: Column | str) -> Column:
    """Hex md5 of ``seed|v1|v2...``; its string order is the draw order."""
    parts: list[Column] = [F.lit(str(seed))]
    for value in values:
        parts += [F.lit("|"), _text(value)]
    return F.md5(F.concat(*parts))


def hash_int(seed: object, *values: Column | str) -> Column:
    """Non-negative 60-bit integer from :func:`hash_key`."""
    return F.conv(F.substring(hash_key(seed, *values), 1, HEX_DIGITS), 16, 10).cast("bigint")


def hash_unit(seed: object, *values: Column | str) -> Column:
    """Uniform draw in [0, 1) with a resolution of one millionth."""
    return (hash_int(seed, *values) % F.lit(1_000_000)) / F.lit(1_000_000.0)
