"""Column expressions and size checks that several operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Rows of two or three numbers and a short text that one executor holds easily.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    `lower` does just that on a text of ASCII only, and is several times faster.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def count_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if its counted `rows` are within the limit.

    Both ways give the same rows; beyond the limit the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once. A column that is named inside the lambda
    of `transform` or `aggregate` would be computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def give_back() -> None:
    """Memory that Arrow keeps for later goes back to the system, so that a worker which stays
    for the next stage is small."""
    pa.default_memory_pool().release_unused()
