"""Comparing the log with its read model by digests.

Per tenant and hour both sides keep a count of their ids and a hash that no order changes.
Hours whose digests agree hold the same ids and are not read again; only the hours that
differ are joined. Digests of disjoint sets of ids add up, so a table of them can be kept
beside each side and brought up to date batch by batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.functions.days import utc_day
from annalog.operators.skew import small_side
from annalog.session import cut_lineage

MAX_DAYS = 5_000  # days that are named to the scan; more are found by the join alone
_SECONDS = 3600


def _hour() -> Column:
    return F.floor(F.unix_seconds("occurred_at") / _SECONDS).cast("bigint").alias("hour")


def hour_digests(events: DataFrame) -> DataFrame:
    """(tenant_id, hour, n, mixed, total) of events with unique ids: hours since 1970 in UTC,
    the count of ids and two hashes of them that any order gives alike."""
    return events.groupBy("tenant_id", _hour()).agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("id")).alias("mixed"),
        F.sum(F.pmod(F.xxhash64("id", F.lit("total")), F.lit(1 << 31))).alias("total"),
    )


def merge_digests(parts: DataFrame) -> DataFrame:
    """Digests of the union of disjoint sets of ids."""
    return parts.groupBy("tenant_id", "hour").agg(
        F.sum("n").alias("n"), F.bit_xor("mixed").alias("mixed"), F.sum("total").alias("total")
    )


def differing_hours(log_digests: DataFrame, model_digests: DataFrame) -> DataFrame:
    """(tenant_id, hour) where the digests differ or one side has none."""
    x = log_digests.select("tenant_id", "hour", F.struct("n", "mixed", "total").alias("x"))
    y = model_digests.select("tenant_id", "hour", F.struct("n", "mixed", "total").alias("y"))
    return x.join(y, ["tenant_id", "hour"], "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("tenant_id", "hour")


def reconcile(
    log: DataFrame, model: DataFrame, log_digests: DataFrame | None = None, model_digests: DataFrame | None = None
) -> DataFrame:
    """Events that one side lacks: side (`missing` in the model, `extra` in it), tenant_id, id,
    stream_id, type, occurred_at.

    Without stored digests they are made from the ids of all events. With them, only hours
    that differ are read; where a side has `occurred_date`, only those days' folders. Ids are
    unique on each side; one that stands in differing hours of both sides is no difference.
    """
    differing = cut_lineage(
        differing_hours(
            hour_digests(log) if log_digests is None else log_digests,
            hour_digests(model) if model_digests is None else model_digests,
        )
    )
    bounds = differing.agg(F.min("hour"), F.max("hour")).first()
    day = utc_day(F.timestamp_seconds(F.col("hour") * _SECONDS))
    days = [r.day for r in differing.select(day.alias("day")).distinct().limit(MAX_DAYS + 1).collect()]

    def asked(df: DataFrame) -> DataFrame:
        if bounds[0] is None:
            return df.filter(F.lit(False))
        low, high = (F.timestamp_seconds(F.lit(h * _SECONDS)) for h in (bounds[0], bounds[1] + 1))
        df = df.filter((F.col("occurred_at") >= low) & (F.col("occurred_at") < high))
        if "occurred_date" in df.columns and len(days) <= MAX_DAYS:
            df = df.filter(F.col("occurred_date").isin(days))
        named = df.select("tenant_id", "id", "stream_id", "type", "occurred_at", _hour())
        return named.join(small_side(differing), ["tenant_id", "hour"], "left_semi").drop("hour")

    def lacking(here: DataFrame, there: DataFrame, side: str) -> DataFrame:
        rows = asked(here).join(asked(there).select("tenant_id", "id"), ["tenant_id", "id"], "left_anti")
        return rows.select(F.lit(side).alias("side"), "tenant_id", "id", "stream_id", "type", "occurred_at")

    return lacking(log, model, "missing").union(lacking(model, log, "extra"))
