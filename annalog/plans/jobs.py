"""Batch jobs over stored tables: import, replay, and the incident report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalog.operators.append import stream_heads
from annalog.operators.ingest import normalise, reject_reason, stamp_tenant
from annalog.operators.replay import (
    ReplayFilter,
    ReplayRequest,
    check_limit,
    filter_from_dlq,
    match,
    replay_order,
    replay_rows,
    replay_summary,
)
from annalog.schema import COLS, REQUEST_MAX_BYTES, REQUEST_PREVIEW_CHARS
from annalog.session import cut_lineage
from annalog.sources.batches import content, find, next_batch, record
from annalog.sources.log import LOG_SCHEMA, append_batch, commit, read_heads, read_log
from annalog.sources.messages import to_messages
from annalog.sources.requests import decode_requests, position_lines, read_request_lines


def judge_requests(
    lines: DataFrame, tenant: str, now: dt.datetime, max_bytes: int = REQUEST_MAX_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(events without versions but with their `position`, rejected rows: file, line_no,
    reject_reason, preview).

    Lines come from `position_lines`; ids derive from file, line number and body, so they
    are unique and the same in every run.
    """
    decoded, broken = decode_requests(lines.withColumn("body", F.col("value")), max_bytes=max_bytes)
    events = normalise(
        stamp_tenant(decoded, tenant),
        now=now,
        id_from=[F.col("file"), F.col("body"), F.col("line_no")],
    )
    judged = events.withColumn("reject_reason", reject_reason()).withColumn(
        "preview", F.left("body", F.lit(REQUEST_PREVIEW_CHARS))
    )
    both = judged.drop("body").unionByName(broken.drop("body"), allowMissingColumns=True)
    stored = cut_lineage(both)  # decoded once for both results
    valid = stored.filter(F.col("reject_reason").isNull()).select(*COLS, "position")
    rejected = stored.filter(F.col("reject_reason").isNotNull())
    return valid, rejected.select("file", "line_no", "reject_reason", "preview")


def import_lines(
    lines: DataFrame,
    log_path: str,
    rejected_path: str,
    tenant: str,
    batch_id: int,
    *,
    writer: str,
    now: dt.datetime | None = None,
    max_bytes: int = REQUEST_MAX_BYTES,
) -> None:
    """Append a frame of `request_lines`, e.g. a streaming micro-batch; versions of a stream
    follow the lines, files in path order."""
    now = now or dt.datetime.now(dt.timezone.utc)
    valid, rejected = judge_requests(position_lines(lines), tenant, now, max_bytes)
    number = append_batch(valid, log_path, batch_id, stored=True, writer=writer, position="position")
    # By the log's number, which no other writer gets.
    rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch_id={number}")


def import_requests(
    spark: SparkSession,
    source: str,
    log_path: str,
    rejected_path: str,
    tenant: str,
    batch_id: int,
    *,
    writer: str,
    now: dt.datetime | None = None,
    max_bytes: int = REQUEST_MAX_BYTES,
) -> None:
    """Import files of request bodies into the log. Running it again with the same
    batch id, or the same files under a later one, adds nothing twice; other files under a
    writer's number raise `BatchConflict`."""
    lines = read_request_lines(spark, source)
    import_lines(lines, log_path, rejected_path, tenant, batch_id, writer=writer, now=now, max_bytes=max_bytes)


def execute(log: DataFrame, request: ReplayRequest, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, events) of a replay; writes nothing.

    Dry run: the matched originals in replay order. Active: the new rows. Raises
    before anything is built when the request breaks a rule or its safety limit.
    """
    request.check()
    wanted = request.filter
    scoped = ReplayFilter(**{**wanted.__dict__, "tenant_id": wanted.tenant_id or request.caller_tenant})
    matched = match(log, scoped)
    check_limit(matched, request.limit())
    if request.dry_run:
        return replay_summary("", True, matched, None), matched.orderBy(*replay_order())
    new = replay_rows(
        matched,
        stream_heads(log) if heads is None else heads,
        request.replay_id,
        request.now,
        request.replay_reason,
    )
    return replay_summary(request.replay_id, False, matched, new), new


def run_replay(
    spark: SparkSession,
    log_path: str,
    request: ReplayRequest,
    batch_id: int,
    messages_path: str | None = None,
    routes: dict[str, str] | None = None,
    fallback: str = "events.v1",
) -> DataFrame:
    """Replay into the log as one batch (all rows or none), then publish what was stored.

    A replay_id is one batch of the log, whatever `batch_id` it is run under: run again,
    it answers with what it stored.
    """
    if request.dry_run:
        return execute(read_log(spark, log_path), request)[0]
    request.check()
    writer = f"replay {request.replay_id}"
    known = find(spark, log_path, writer, 0)
    if known is None:
        number = next_batch(spark, log_path, batch_id)
        _, events = execute(read_log(spark, log_path), request, read_heads(spark, log_path))
        commit(events, log_path, number)
        written = spark.read.schema(LOG_SCHEMA).parquet(f"{log_path}/batch_id={number}")
        record(spark, log_path, writer, 0, number, *content(written))
    else:
        number = known[0]
    stored = read_log(spark, log_path, layout=True).filter(F.col("batch_id") == number).select(*COLS)
    summary = replay_summary(request.replay_id, False, stored, stored)  # each match made one row
    if messages_path:
        to_messages(stored, routes or {}, fallback).write.mode("overwrite").parquet(
            f"{messages_path}/batch_id={batch_id}"
        )
    return summary


def recover_dead_letters(
    spark: SparkSession,
    log_path: str,
    dlq: DataFrame,
    tenant: str,
    reason: str,
    batch_id: int,
    replay_id: str,
    safety_limit: int = 0,
    **publish,
) -> DataFrame:
    """Replays a tenant's dead-lettered events from the log as new rows, and publishes them
    if `messages_path` is given; the replay's summary.

    An event that was dead-lettered several times is replayed once, one that the log does
    not hold, or that is a replay itself, not at all. `replay_id` names the recovery: run
    again under it, it adds nothing.
    """
    wanted = filter_from_dlq(dlq, tenant)
    wanted.event_ids = cut_lineage(wanted.event_ids)
    request = ReplayRequest(
        filter=wanted, caller_tenant=tenant, replay_reason=reason, safety_limit=safety_limit, replay_id=replay_id
    )
    return run_replay(spark, log_path, request, batch_id, **publish)
