"""W3C trace context as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: version 00, 32 hex digits, 16 hex digits, two flag characters.
TRACEPARENT = r"^00-([0-9a-fA-F]{32})-([0-9a-fA-F]{16})-([^-]{2})$"


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def parse_traceparent(header: Column) -> Column:
    """struct<trace_id, parent_span_id, sampled>, or NULL when malformed."""
    return F.when(
        F.regexp_like(header, F.lit(TRACEPARENT)),
        F.struct(
            F.regexp_extract(header, TRACEPARENT, 1).alias("trace_id"),
            F.regexp_extract(header, TRACEPARENT, 2).alias("parent_span_id"),
            (F.regexp_extract(header, TRACEPARENT, 3) == "01").alias("sampled"),
        ),
    )


def format_traceparent(trace_id: Column, span_id: Column, sampled: Column) -> Column:
    flags = F.when(sampled, F.lit("01")).otherwise(F.lit("00"))
    return F.concat_ws("-", F.lit("00"), trace_id, span_id, flags)


def span_of(event_id: Column) -> Column:
    """Span id of the publish step: stable per event, so a retried task repeats it."""
    return F.left(F.md5(event_id), F.lit(16))


def resolve_trace(traceparent: Column, x_trace_id: Column, fresh: Column | None = None) -> Column:
    """Valid traceparent, else a 32-character X-Trace-ID, else a fresh id."""
    made = F.replace(F.uuid(), F.lit("-"), F.lit("")) if fresh is None else fresh
    return F.coalesce(
        parse_traceparent(traceparent)["trace_id"],
        F.when(F.octet_length(x_trace_id) == 32, x_trace_id),
        made,
    )


def coalesce_id(header: Column, value: Column) -> Column:
    """The header when it is there and not empty, else the event's own value."""
    return F.coalesce(blank_to_null(header), value)
