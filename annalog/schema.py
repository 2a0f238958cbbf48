"""Event envelope: columns, types, defaults and the platform's fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# They are part of the data contract and must not change.
PAGE_LIMIT_DEFAULT = 20
PAGE_LIMIT_MAX = 100
REPLAY_LIMIT_DEFAULT = 1000
REQUEST_MAX_BYTES = 4096
REQUEST_PREVIEW_CHARS = 512
MESSAGE_PREVIEW_BYTES = 200
READ_MODEL_LOG = "postgres"
READ_MODEL_PROJECTION = "elasticsearch"
CONSISTENCY_STRONG = "strong"
CONSISTENCY_EVENTUAL = "eventual"
DEFAULT_TENANT = "default"
ABSENT_PAYLOAD = "null"
REPLAY_METADATA_KEYS = (
    "is_replay",
    "replay_id",
    "replay_source_event_id",
    "replay_reason",
)

_TEXT = T.StringType()

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", _TEXT),
        T.StructField("tenant_id", _TEXT),
        T.StructField("stream_id", _TEXT),
        T.StructField("type", _TEXT),
        T.StructField("source", _TEXT),
        T.StructField("version", T.LongType()),
        T.StructField("event_version", T.IntegerType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("payload", _TEXT),
        T.StructField("metadata", T.MapType(_TEXT, _TEXT)),
        T.StructField("correlation_id", _TEXT),
        T.StructField("causation_id", _TEXT),
        T.StructField("actor_id", _TEXT),
        T.StructField("trace_id", _TEXT),
        T.StructField("source_version", _TEXT),
        T.StructField("is_replay", T.BooleanType()),
        T.StructField("replay_id", _TEXT),
        T.StructField("replayed_at", T.TimestampType()),
        T.StructField("replay_reason", _TEXT),
        T.StructField("replay_source_event_id", _TEXT),
    ]
)

COLS = EVENT_SCHEMA.fieldNames()

# Columns that a log written before they existed reads back with a default.
# `replayed_at` is the only envelope column whose absence stays NULL.
COLUMN_DEFAULTS = {
    "tenant_id": DEFAULT_TENANT,
    "correlation_id": "",
    "event_version": 1,
    "causation_id": "",
    "actor_id": "",
    "trace_id": "",
    "source_version": "",
    "is_replay": False,
    "replay_id": "",
    "replay_reason": "",
    "replay_source_event_id": "",
}

# What a caller may send: no id, version, tenant or time.
REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("stream_id", _TEXT),
        T.StructField("type", _TEXT),
        T.StructField("source", _TEXT),
        T.StructField("payload", _TEXT),
        T.StructField("metadata", T.MapType(_TEXT, _TEXT)),
        T.StructField("event_version", T.IntegerType()),
        T.StructField("causation_id", _TEXT),
        T.StructField("actor_id", _TEXT),
        T.StructField("trace_id", _TEXT),
        T.StructField("source_version", _TEXT),
    ]
)

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("topic", _TEXT),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField(
            "headers",
            T.ArrayType(
                T.StructType(
                    [T.StructField("key", _TEXT), T.StructField("value", T.BinaryType())]
                )
            ),
        ),
    ]
)

# One row per replay or timeline request in a request table.
REPLAY_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", _TEXT),
        T.StructField("caller_tenant", _TEXT),
        T.StructField("tenant_id", _TEXT),
        T.StructField("stream_id", _TEXT),
        T.StructField("correlation_id", _TEXT),
        T.StructField("event_type", _TEXT),
        T.StructField("actor_id", _TEXT),
        T.StructField("from_time", _TEXT),
        T.StructField("to_time", _TEXT),
        T.StructField("event_ids", T.ArrayType(_TEXT)),
        T.StructField("dry_run", T.BooleanType()),
        T.StructField("replay_reason", _TEXT),
        T.StructField("safety_limit", T.IntegerType()),
    ]
)

# Why a request, an event or a line is refused: codes of this library, the same in errors,
# in `reject_reason` columns and in the status of request tables.
TENANT_MISSING = "tenant_missing"
TENANT_MISMATCH = "tenant_mismatch"
STREAM_MISSING = "stream_missing"
EVENT_ID_MISSING = "event_id_missing"
FIELDS_MISSING = "fields_missing"
REASON_MISSING = "reason_missing"
SCOPE_MISSING = "scope_missing"
FROM_TIME_BAD = "from_time_bad"
TO_TIME_BAD = "to_time_bad"
VERSION_NEGATIVE = "version_negative"
VERSION_GAP = "version_gap"
LIMIT_EXCEEDED = "limit_exceeded"
BODY_INVALID = "body_invalid"
BODY_TOO_LONG = "body_too_long"
