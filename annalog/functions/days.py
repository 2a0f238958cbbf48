"""Days of instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_day(at: Column) -> Column:
    """The UTC date of an instant, in any session zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(at) / 86_400_000_000).cast("int"))
