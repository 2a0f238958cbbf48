"""Pages with totals."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.operators.numbering import running_total
from annalog.operators.skew import MAX_ROWS_PER_TASK
from annalog.schema import PAGE_LIMIT_DEFAULT, PAGE_LIMIT_MAX

# Top-k keeps offset + limit rows per task and on the last one; past this depth
# the page is found by row numbers instead.
TOP_K_DEPTH = 10_000


def clamp(limit: int | None, offset: int | None) -> tuple[int, int]:
    """Default 20 for nothing or <= 0, at most 100; negative offsets start at 0."""
    limit = PAGE_LIMIT_DEFAULT if limit is None or limit <= 0 else min(limit, PAGE_LIMIT_MAX)
    return limit, max(offset or 0, 0)


def text_param(text: str | None, default: int) -> int:
    """A page argument given as text: absent, not a whole number or negative -> default."""
    if not re.fullmatch(r"[+-]?[0-9]+", text or ""):
        return default
    value = int(text)
    return value if value >= 0 else default


def page(
    df: DataFrame,
    order: Sequence[Column],
    limit: int | None = None,
    offset: int | None = None,
    key: Sequence[str] = ("tenant_id",),
    digits: Sequence[Column] = (),
    task_limit: int = MAX_ROWS_PER_TASK,
) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one-row summary with the total of all matches).

    `df` holds the matches; `order` must be total. The total is its own aggregate:
    a window count would move every match into one task, and would be lost past
    the last page. Deep pages use `key` (constant over the matches) and `digits`
    as `running_total` does.
    """
    limit, offset = clamp(limit, offset)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    summary = total.withColumns({"limit": F.lit(limit), "offset": F.lit(offset)})
    if offset + limit <= TOP_K_DEPTH or not digits:
        return df.orderBy(*order).offset(offset).limit(limit), summary
    numbered = running_total(df, key, order, digits, name="_row", limit=task_limit)
    rows = numbered.filter(F.col("_row").between(offset + 1, offset + limit)).orderBy("_row")
    return rows.drop("_row"), summary
