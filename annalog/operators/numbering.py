"""Running totals and row numbers inside a key, safe when one key is huge.

`row_number() over (partition by key order by …)` sorts a whole key in one task.
A stream that holds a third of the log would end there. Here a key with more
than `limit` rows is cut into order-preserving cells (hour, instant, id prefix …);
each cell is numbered on its own and starts at the total of the cells before it.
Keys below the limit, usually all, take the plain window.

The cells are functions of the row alone, so a recomputed task lands on the same
numbers: no sampling, no materialised layout of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalog.operators.skew import MAX_ROWS_PER_TASK, crowded_keys, small_side
from annalog.session import cut_lineage

_UNCUT = -(2**63)


def hour_digit(time: Column) -> Column:
    return F.floor(F.unix_seconds(time) / 3600).cast("bigint")


def instant_digit(time: Column) -> Column:
    return F.unix_micros(time)


def text_digit(text: Column, chars: int = 3) -> Column:
    """The first characters as one number (21 bits each): keeps the order of any text."""
    digit = F.lit(0).cast("bigint")
    for i in range(chars):
        digit = digit * (1 << 21) + F.ascii(F.substring(text, i + 1, 1)).cast("bigint")
    return digit


def version_digit(version: Column, width: int = 100_000) -> Column:
    return F.floor(version / width).cast("bigint")


def event_digits(time: str = "occurred_at", event_id: str = "id") -> list[Column]:
    """Cells for the order (time, id): hours, then instants, then id prefixes.

    The later digits are only read for cells that are still too large, e.g. a
    bulk import that stamped a whole stream with one instant.
    """
    return [
        hour_digit(F.col(time)),
        instant_digit(F.col(time)),
        text_digit(F.col(event_id)),
    ]


def running_total(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[Column],
    digits: Sequence[Column],
    weight: Column | None = None,
    name: str = "row_no",
    limit: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """Add `name`: the sum of `weight` over the key's rows up to this one.

    Without `weight` this is the row number. `order` must be a total order inside
    the key, and each of `digits` a BIGINT that never decreases along `order`
    within equal values of the digits before it.

    A broadcast holds only keys (or cells) above `limit`, so at most
    rows / `limit` entries.
    """
    key = list(key)
    raws = [f"_raw{i}" for i in range(len(digits))]
    rows = df.withColumns(
        {"_weight": F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")}
        | dict(zip(raws, digits))
    )
    crowd = rows.select(*key, "_weight", *raws)  # rows of groups still too large

    group, starts = key, None
    for i, raw in enumerate(raws):
        large = crowded_keys(crowd, group, limit)
        if large is None:
            break
        cut = f"_cut{i}"
        rows = (
            rows.join(small_side(large.withColumn("_large", F.lit(True))), group, "left")
            .withColumn(cut, F.when(F.col("_large"), F.col(raw)).otherwise(F.lit(_UNCUT)))
            .drop("_large")
        )
        crowd = crowd.join(small_side(large), group).withColumn(cut, F.col(raw))
        starts = _add_level(crowd, group, cut, starts)
        group = [*group, cut]

    inside = Window.partitionBy(*group).orderBy(*order)
    if weight is None:
        local = F.row_number().over(inside).cast("bigint")
    else:
        local = F.sum("_weight").over(
            inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
    rows = rows.withColumn(name, local)
    if starts is not None:
        # Same partitioning as the window above: the rows are not shuffled again.
        rows = rows.join(starts, group, "left").withColumn(
            name, F.col(name) + F.coalesce("_start", F.lit(0))
        )
    return rows.select(*[c for c in df.columns if c != name], name)


def _add_level(
    crowd: DataFrame, group: list[str], cut: str, outer: DataFrame | None
) -> DataFrame:
    """The total before each cell of the groups in `crowd`, with the cells of the
    outer levels. The window sees one row per cell, not one per event."""
    before = Window.partitionBy(*group).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        crowd.groupBy(*group, cut)
        .agg(F.sum("_weight").alias("_sum"))
        .select(*group, cut, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    )
    if outer is not None:
        parents = outer.select(*group, F.col("_start").alias("_outer"))
        cells = cells.join(parents, group).select(
            *group, cut, (F.col("_start") + F.col("_outer")).alias("_start")
        )
        cells = outer.withColumn(cut, F.lit(_UNCUT)).unionByName(cells)
    return cut_lineage(cells)
