"""Audit queries over the log and the read model. Tenant scope is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.functions.days import utc_day
from annalog.operators.lookup import lookup
from annalog.operators.numbering import (
    event_digits,
    hour_digit,
    instant_digit,
    version_digit,
)
from annalog.operators.paging import page
from annalog.operators.skew import MAX_ROWS_PER_TASK, small_side
from annalog.schema import (
    CONSISTENCY_EVENTUAL,
    CONSISTENCY_STRONG,
    EVENT_ID_MISSING,
    READ_MODEL_LOG,
    READ_MODEL_PROJECTION,
    STREAM_MISSING,
    TENANT_MISSING,
)

Page = tuple[DataFrame, DataFrame]


def newest_first() -> list[Column]:
    return [F.col("occurred_at").desc(), F.col("id").desc()]


def oldest_first() -> list[Column]:
    return [F.col("occurred_at").asc(), F.col("id").asc()]


def _newest_digits() -> list[Column]:
    time = F.col("occurred_at")
    return [-hour_digit(time), -instant_digit(time)]


def _of_tenant(df: DataFrame, tenant: str) -> DataFrame:
    if not tenant:
        raise ValueError(TENANT_MISSING)
    return df.filter(F.col("tenant_id") == tenant)


def by_id(df: DataFrame, tenant: str, event_id: str) -> DataFrame:
    """The event, or no row when it is unknown or another tenant's."""
    return _of_tenant(df, tenant).filter(F.col("id") == event_id.lower())


def by_ids(df: DataFrame, tenant: str, ids: DataFrame) -> DataFrame:
    """Events of a table of ids. Few ids go to the log by broadcast, many by shuffle."""
    wanted = ids.select(F.lower("id").alias("id")).distinct()
    return _of_tenant(df, tenant).join(small_side(wanted), "id", "left_semi")


def stream(
    df: DataFrame, stream_id: str, tenant: str | None = None, from_version: int = 0
) -> DataFrame:
    """A stream in version order, from `from_version` on (inclusive, 0 = all)."""
    rows = df.filter(F.col("stream_id") == stream_id)
    if tenant:
        rows = rows.filter(F.col("tenant_id") == tenant)
    if from_version:
        rows = rows.filter(F.col("version") >= from_version)
    return rows.orderBy("version")


def stream_page(df: DataFrame, tenant: str, stream_id: str, limit=None, offset=None) -> Page:
    if not stream_id:
        raise ValueError(STREAM_MISSING)
    rows = _of_tenant(df, tenant).filter(F.col("stream_id") == stream_id)
    order = [F.col("version").asc(), F.col("id").asc()]
    return page(rows, order, limit, offset, digits=[version_digit(F.col("version"))])


def feed_page(df: DataFrame, tenant: str, limit=None, offset=None) -> Page:
    return page(_of_tenant(df, tenant), newest_first(), limit, offset, digits=_newest_digits())


def by_correlation(df: DataFrame, tenant: str, correlation_id: str, limit=None, offset=None) -> Page:
    rows = _of_tenant(df, tenant).filter(F.col("correlation_id") == correlation_id)
    return page(rows, newest_first(), limit, offset, digits=_newest_digits())


def effects(df: DataFrame, tenant: str, cause: str, limit=None, offset=None) -> Page:
    """Direct effects of one event."""
    if not cause:
        raise ValueError(EVENT_ID_MISSING)
    rows = _of_tenant(df, tenant).filter(F.col("causation_id") == cause)
    return page(rows, oldest_first(), limit, offset, digits=event_digits())


def children(df: DataFrame, limit: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """Every effect with its cause of the same tenant, for all events at once.

    An event may have caused a third of the log: the join spreads such causes.
    """
    caused = df.filter(F.col("causation_id") != "").select(
        "tenant_id", "causation_id", "id", "stream_id", "type", "occurred_at"
    )
    causes = df.select(
        "tenant_id",
        F.col("id").alias("causation_id"),
        F.col("stream_id").alias("cause_stream_id"),
        F.col("type").alias("cause_type"),
        F.col("occurred_at").alias("cause_occurred_at"),
    )
    joined = lookup(caused, causes, ["tenant_id", "causation_id"], "cause", limit=limit)
    return joined.filter(F.col("cause").isNotNull()).select(
        *caused.columns, "cause.cause_stream_id", "cause.cause_type", "cause.cause_occurred_at"
    )


def in_window(
    from_time: dt.datetime | Column | None = None, to_time: dt.datetime | Column | None = None
) -> Column:
    """Both bounds inclusive; no bound where None. from > to matches nothing."""
    keep = F.lit(True)
    if from_time is not None:
        keep = keep & (F.col("occurred_at") >= (from_time if isinstance(from_time, Column) else F.lit(from_time)))
    if to_time is not None:
        keep = keep & (F.col("occurred_at") <= (to_time if isinstance(to_time, Column) else F.lit(to_time)))
    return keep


def _prune_days(df: DataFrame, from_time, to_time) -> DataFrame:
    """On a log read with its layout, restrict the date folders as well."""
    if "occurred_date" not in df.columns:
        return df
    if from_time is not None:
        df = df.filter(F.col("occurred_date") >= utc_day(F.lit(from_time).cast("timestamp")))
    if to_time is not None:
        df = df.filter(F.col("occurred_date") <= utc_day(F.lit(to_time).cast("timestamp")))
    return df


def timeline(
    df: DataFrame, tenant: str, from_time=None, to_time=None, limit=None, offset=None
) -> Page:
    """Newest-first page of a tenant's events in an optional inclusive window."""
    rows = _prune_days(_of_tenant(df, tenant), from_time, to_time).filter(
        in_window(from_time, to_time)
    )
    return page(rows, newest_first(), limit, offset, digits=_newest_digits())


def route(
    log: DataFrame, projection: DataFrame, correlation_id: str = ""
) -> tuple[DataFrame, str, str]:
    """(table to read, read model, consistency): a correlation filter needs the log."""
    if correlation_id:
        return log, READ_MODEL_LOG, CONSISTENCY_STRONG
    return projection, READ_MODEL_PROJECTION, CONSISTENCY_EVENTUAL


def list_events(
    log: DataFrame, projection: DataFrame, tenant: str, correlation_id="", limit=None, offset=None
) -> Page:
    """The routed list: page, and summary tagged with its read model."""
    source, model, consistency = route(log, projection, correlation_id)
    if correlation_id:
        rows, summary = by_correlation(source, tenant, correlation_id, limit, offset)
    else:
        rows, summary = feed_page(source, tenant, limit, offset)
    tags = {"read_model": F.lit(model), "consistency": F.lit(consistency)}
    return rows, summary.withColumns(tags)


def replay_batch(df: DataFrame, tenant: str, replay_id: str) -> DataFrame:
    rows = _of_tenant(df, tenant).filter((F.col("replay_id") == replay_id) & (F.col("replay_id") != ""))
    return rows.orderBy("occurred_at", "stream_id", "version")


def actor_feed(df: DataFrame, tenant: str, actor_id: str, limit=None, offset=None) -> Page:
    rows = _of_tenant(df, tenant).filter((F.col("actor_id") == actor_id) & (F.col("actor_id") != ""))
    return page(rows, newest_first(), limit, offset, digits=_newest_digits())


def actor_summary(df: DataFrame) -> DataFrame:
    """Per tenant and actor: events, distinct types, first and last time."""
    return (
        df.filter(F.col("actor_id") != "")
        .groupBy("tenant_id", "actor_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.countDistinct("type").alias("types"),
            F.min("occurred_at").alias("first_at"),
            F.max("occurred_at").alias("last_at"),
        )
    )


def replay_feed(df: DataFrame, tenant: str, limit=None, offset=None) -> Page:
    rows = _of_tenant(df, tenant).filter("is_replay")
    return page(rows, newest_first(), limit, offset, digits=_newest_digits())
