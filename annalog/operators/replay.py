"""Replay: selection, limits, and new rows that carry their lineage."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.functions.envelope import stable_uuid
from annalog.operators.append import assign_versions
from annalog.operators.audit import gaps
from annalog.operators.audit_queries import in_window
from annalog.operators.numbering import event_digits
from annalog.operators.skew import MAX_ROWS_PER_TASK, small_side
from annalog.schema import (
    COLS,
    LIMIT_EXCEEDED,
    REASON_MISSING,
    REPLAY_LIMIT_DEFAULT,
    REPLAY_METADATA_KEYS,
    SCOPE_MISSING,
    STREAM_MISSING,
    TENANT_MISMATCH,
    TENANT_MISSING,
    VERSION_GAP,
    VERSION_NEGATIVE,
)

IDS_INLINE = 100
PROBE_ROWS = 100_000


class ReplayLimitExceeded(ValueError):
    """The filter matches more events than the safety limit."""


class VersionGap(ValueError):
    """A stream misses a version."""


@dataclass
class ReplayFilter:
    """All given fields must hold. `event_ids` (list, or DataFrame with column `id`)
    replaces every other field but the tenant; an empty list counts as not given."""

    tenant_id: str = ""
    stream_id: str = ""
    correlation_id: str = ""
    event_type: str = ""
    actor_id: str = ""
    from_time: dt.datetime | None = None
    to_time: dt.datetime | None = None
    event_ids: list[str] | DataFrame | None = None
    exclude_replays: bool = False

    def has_ids(self) -> bool:
        return isinstance(self.event_ids, DataFrame) or bool(self.event_ids)


@dataclass
class ReplayRequest:
    filter: ReplayFilter
    caller_tenant: str
    dry_run: bool = False
    replay_reason: str = ""
    safety_limit: int = 0
    replay_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    now: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc))

    def limit(self) -> int:
        return self.safety_limit if self.safety_limit > 0 else REPLAY_LIMIT_DEFAULT

    def check(self) -> None:
        if not self.caller_tenant:
            raise ValueError(TENANT_MISSING)
        if not self.dry_run and not self.replay_reason:
            raise ValueError(REASON_MISSING)
        if not self.filter.tenant_id and not self.filter.has_ids():
            raise ValueError(SCOPE_MISSING)
        if self.filter.tenant_id and self.filter.tenant_id != self.caller_tenant:
            raise ValueError(TENANT_MISMATCH)


def match(df: DataFrame, wanted: ReplayFilter) -> DataFrame:
    """Events the filter selects, unordered; predicates reach the scan."""
    if wanted.exclude_replays:
        df = df.filter(~F.col("is_replay"))
    if wanted.has_ids():
        ids = wanted.event_ids
        if wanted.tenant_id:
            df = df.filter(F.col("tenant_id") == wanted.tenant_id)
        if isinstance(ids, DataFrame):
            return df.join(small_side(ids.select("id").distinct()), "id", "left_semi")
        if len(ids) <= IDS_INLINE:
            return df.filter(F.col("id").isin(*ids))
        listed = df.sparkSession.createDataFrame([(i,) for i in set(ids)], "id string")
        return df.join(listed, "id", "left_semi")
    if not wanted.tenant_id:
        raise ValueError(SCOPE_MISSING)
    given = {
        "tenant_id": wanted.tenant_id,
        "stream_id": wanted.stream_id,
        "correlation_id": wanted.correlation_id,
        "type": wanted.event_type,
        "actor_id": wanted.actor_id,
    }
    for column, value in given.items():
        if value:
            df = df.filter(F.col(column) == value)
    return df.filter(in_window(wanted.from_time, wanted.to_time))


def replay_order() -> list[Column]:
    return [F.col("occurred_at"), F.col("stream_id"), F.col("version")]


def check_limit(df: DataFrame, limit: int) -> int:
    """Number of matches; raises past `limit`.

    Small limits stop after limit + 1 rows. A global limit passes its rows through
    one task, so large ones are checked by a plain count.
    """
    seen = df.limit(limit + 1).count() if limit <= PROBE_ROWS else df.count()
    if seen > limit:
        raise ReplayLimitExceeded(
            f"{LIMIT_EXCEEDED}: {seen} or more events, {limit} allowed"
        )
    return seen


def replay_read(
    df: DataFrame,
    tenant: str,
    stream_id: str,
    from_version: int = 0,
    to_version: int = 0,
    from_time: dt.datetime | None = None,
    to_time: dt.datetime | None = None,
) -> DataFrame:
    """One stream in version order within optional bounds, without writing.

    Raises VersionGap, naming the first missing version, when the rows read are
    not contiguous.
    """
    if not tenant:
        raise ValueError(TENANT_MISSING)
    if not stream_id:
        raise ValueError(STREAM_MISSING)
    if from_version < 0:
        raise ValueError(VERSION_NEGATIVE)
    rows = df.filter((F.col("tenant_id") == tenant) & (F.col("stream_id") == stream_id))
    rows = rows.filter(F.col("version") >= from_version)
    if to_version:
        rows = rows.filter(F.col("version") <= to_version)
    rows = rows.filter(in_window(from_time, to_time))
    first = gaps(rows).orderBy("previous_version").limit(1).collect()
    if first:
        g = first[0]
        raise VersionGap(
            f"{VERSION_GAP}: {g.stream_id} goes from {g.previous_version} to {g.found_version}, {g.missing_version} is missing"
        )
    return rows.orderBy("version")


def replay_metadata(
    metadata: Column, replay_id: Column, source_id: Column, reason: Column
) -> Column:
    """The original map with the four replay keys set; `map_concat` alone would fail
    on a row that is itself a replay."""
    values = {
        "is_replay": F.lit("true"),
        "replay_id": replay_id,
        "replay_source_event_id": source_id,
        "replay_reason": reason,
    }
    kept = F.map_filter(metadata, lambda k, _: ~k.isin(*REPLAY_METADATA_KEYS))
    pairs = [c for k in REPLAY_METADATA_KEYS for c in (F.lit(k), values[k])]
    return F.map_concat(kept, F.create_map(*pairs))


def replay_rows(
    matched: DataFrame,
    heads: DataFrame,
    replay_id: str,
    now: dt.datetime | Column,
    reason: str,
    limit: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """The new events of a replay, versions following `heads`. Originals stay as they are.

    Ids derive from (replay_id, original id): a retried task, or the same replay
    run again, makes the same rows. Versions follow the originals' order, so the
    cells of a crowded stream are those of the original times.
    """
    when = now if isinstance(now, Column) else F.lit(now)
    originals = matched.select(*COLS).withColumnsRenamed({"id": "_from", "occurred_at": "_was"})
    renewed = originals.withColumns(
        {
            "id": stable_uuid(F.lit(replay_id), F.col("_from")),
            "occurred_at": when.cast("timestamp"),
            "metadata": replay_metadata(
                F.col("metadata"), F.lit(replay_id), F.col("_from"), F.lit(reason)
            ),
            "is_replay": F.lit(True),
            "replay_id": F.lit(replay_id),
            "replayed_at": when.cast("timestamp"),
            "replay_reason": F.lit(reason),
            "replay_source_event_id": F.col("_from"),
            "_nth": F.col("version"),
        }
    )
    numbered = assign_versions(
        renewed,
        heads,
        order=[F.col("_was"), F.col("_nth"), F.col("_from")],
        digits=event_digits("_was", "_from")[:2],
        limit=limit,
    )
    return numbered.select(*COLS)


def replay_summary(
    replay_id: str, dry_run: bool, matched: DataFrame, replayed: DataFrame | None
) -> DataFrame:
    """One row: replay_id ('' for a dry run), dry_run, matched_count, replayed_count."""
    none = F.lit(0).cast("bigint")
    counts = matched.agg(F.count(F.lit(1)).alias("m")).select("m", none.alias("r"))
    if replayed is not None:
        new = replayed.agg(F.count(F.lit(1)).alias("r"))
        counts = counts.unionByName(new.select(none.alias("m"), "r"))
    return counts.agg(F.sum("m").alias("matched_count"), F.sum("r").alias("replayed_count")).select(
        F.lit("" if dry_run else replay_id).alias("replay_id"),
        F.lit(dry_run).alias("dry_run"),
        "matched_count",
        "replayed_count",
    )


def plan_hourly(df: DataFrame) -> DataFrame:
    """Size of each one-hour batch of a large replay."""
    return (
        df.groupBy(F.window("occurred_at", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("from_time"), F.col("w.end").alias("until_time"), "events")
    )


def filter_from_dlq(dlq: DataFrame, tenant: str) -> ReplayFilter:
    """The replay filter for everything in a dead-letter table (column `event`)."""
    ids = dlq.select(F.col("event.id").alias("id")).distinct()
    return ReplayFilter(tenant_id=tenant, event_ids=ids)
