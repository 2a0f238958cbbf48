"""Finding the keys that are too large for one task."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalog.session import cut_lineage

MAX_ROWS_PER_TASK = 1_000_000
MAX_BROADCAST_BYTES = 32 << 20
_MIN_ROW_BYTES = 16  # on disk, compressed


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: file sizes for scans, products for joins, so it errs
    on the large side."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:  # a product of many joins, too long to convert
        return sys.maxsize


def crowded_keys(df: DataFrame, key: Sequence[str], limit: int) -> DataFrame | None:
    """The values of `key` with more than `limit` rows, or None if there are none.

    At most count(df) / limit values, whatever the data: small enough to broadcast.
    They are found by a count that combines map-side and reads only `key`, and
    stored in the shared folder so that a plan can use them several times. Inputs
    too small to hold such a key are not counted.
    """
    if estimated_bytes(df) < limit * _MIN_ROW_BYTES:
        return None
    return stored_keys(df, key, limit)


def stored_keys(df: DataFrame, key: Sequence[str], limit: int) -> DataFrame | None:
    """`crowded_keys` without the size shortcut; one pass over the key columns."""
    crowded = cut_lineage(
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > limit)
        .select(*key)
    )
    return None if crowded.isEmpty() else crowded


def is_small(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> bool:
    return estimated_bytes(df) <= limit


def small_side(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast if Catalyst's estimate proves it small, else as it is:
    the join then shuffles both sides."""
    return F.broadcast(df) if is_small(df) else df
