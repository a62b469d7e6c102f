"""Sizes of tables, looked at before one is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes up to which a table is broadcast.
SMALL_ROWS, SMALL_BYTES = 100_000, 1 << 25


def _row_bytes(df: DataFrame) -> Column:
    """About what a row takes: characters of strings, eight bytes for each number and element."""
    total = F.lit(0).cast("long")
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        size = F.octet_length(c) if kind in ("string", "binary") else 8 * F.size(c) if kind in ("array", "map") else F.lit(8)
        total = total + F.coalesce(size.cast("long"), F.lit(8))
    return total


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    n, size = df.limit(rows + 1).agg(F.count("*"), F.sum(_row_bytes(df))).first()
    return n <= rows and (size or 0) <= SMALL_BYTES


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small."""
    return F.broadcast(df) if is_small(df, rows) else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys over the session's shuffle width, however few bytes it has: rows that shrink well may be many, or dear to work on."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def merge_joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by sorting. Spark weighs a side by its shuffled bytes, and repeated strings that take few there may not fit when broadcast."""
    return dealt(a, *on).hint("merge").join(dealt(b, *on), on, how)
