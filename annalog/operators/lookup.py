"""Many-to-one joins that stay balanced when many rows ask for one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalog.operators.skew import MAX_ROWS_PER_TASK, crowded_keys, small_side
from annalog.session import cut_lineage


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    found: str,
    limit: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Left-join `rows` to `table`, whose key `on` is unique; result struct in `found`.

    Keys asked for by more than `limit` rows are answered apart: there are at most
    count(rows) / `limit` of them, stored, and broadcast if their stored size is small,
    so their rows are not shuffled at all. All other rows, usually every row, take the
    ordinary shuffle join. Key columns must not be NULL.
    """
    on = list(on)
    rest = [c for c in table.columns if c not in on]
    packed = table.select(*on, F.struct(*rest, F.lit(True).alias("hit")).alias(found))
    columns = [*rows.columns, found]
    busy = crowded_keys(rows, on, limit)
    if busy is None:
        return rows.join(packed, on, "left").select(*columns)
    answers = cut_lineage(busy.join(packed.join(small_side(busy), on), on, "left"))
    crowded = rows.join(small_side(answers), on).select(*columns)
    others = rows.join(small_side(busy), on, "left_anti").join(packed, on, "left")
    return others.select(*columns).unionByName(crowded)
