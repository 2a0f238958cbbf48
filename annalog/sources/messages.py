"""Bus messages: the Kafka source and sink column contract.

`read_messages(spark, "kafka", {...})` works where the Kafka package is installed;
any file format with MESSAGE_SCHEMA columns works the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalog.functions.envelope import (
    UUID_PATTERN,
    envelope_json,
    fix_columns,
    parse_rfc3339,
    raw_member,
    variant_is,
    variant_text,
)
from annalog.functions.routing import topic_column
from annalog.functions.trace import blank_to_null, format_traceparent, parse_traceparent, span_of
from annalog.operators.lookup import lookup
from annalog.operators.skew import MAX_ROWS_PER_TASK
from annalog.schema import ABSENT_PAYLOAD, COLS, EVENT_SCHEMA, MESSAGE_PREVIEW_BYTES, MESSAGE_SCHEMA
from annalog.session import cut_lineage

_TEXT_FIELDS = [f.name for f in EVENT_SCHEMA if f.dataType.simpleString() == "string" and f.name != "payload"]
_TIME_FIELDS = ["occurred_at", "replayed_at"]
_DOC_SCHEMA = ", ".join(
    [f"{c} variant" for c in COLS if c not in ("payload", "metadata")]
    + ["metadata map<string,variant>", "payload string", "_broken string"]
)


def message_headers() -> Column:
    """event_id, event_type, source, then traceparent and correlation_id when set."""

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))

    traceparent = F.when(
        F.col("trace_id") != "",
        format_traceparent(F.col("trace_id"), span_of(F.col("id")), F.lit(True)),
    )
    all_headers = F.array(
        header("event_id", F.col("id")),
        header("event_type", F.col("type")),
        header("source", F.col("source")),
        header("traceparent", traceparent),
        header("correlation_id", blank_to_null(F.col("correlation_id"))),
    )
    return F.filter(all_headers, lambda h: h["value"].isNotNull())


def to_messages(df: DataFrame, routes: dict[str, str], fallback: str) -> DataFrame:
    """One message per event: what `.write.format("kafka")` takes, plus its time."""
    return df.select(
        topic_column(F.col("stream_id"), routes, fallback).alias("topic"),
        F.col("stream_id").cast("binary").alias("key"),
        envelope_json().cast("binary").alias("value"),
        message_headers().alias("headers"),
        F.col("occurred_at").alias("timestamp"),
    )


def bus_parts(df: DataFrame, limit: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """Adds `part`: 0 for the first `limit` versions that `df` has of a stream, 1 for the next,
    and so on. A stream of any size is then sent by several tasks, one part after the other."""
    first = df.groupBy("stream_id").agg(F.min("version").alias("version"))
    found = lookup(df, first, ["stream_id"], "_first", limit=limit)
    part = F.floor((F.col("version") - F.col("_first.version")) / limit).cast("bigint")
    return found.withColumn("part", part).drop("_first")


def order_for_bus(df: DataFrame) -> DataFrame:
    """Strict order of one part: a stream's rows of it, `limit` at most, in one task.

    For files whose names give the order use `order_for_export`.
    """
    return df.repartition("stream_id").sortWithinPartitions("stream_id", "version")


def send_in_order(
    df: DataFrame, send: Callable[[DataFrame, int], None], limit: int = MAX_ROWS_PER_TASK
) -> None:
    """Hands the parts of `df` to `send`, each after the one before has been written, so a
    stream's versions reach the bus in order although several tasks send them."""
    parted = cut_lineage(bus_parts(df, limit))
    # One number for every `limit` rows of the longest stream.
    parts = sorted(r.part for r in parted.select("part").distinct().collect())
    for part in parts:
        send(order_for_bus(parted.filter(F.col("part") == part)).drop("part"), part)


def write_messages(messages: DataFrame, fmt: str, options: dict[str, str], folder: str) -> None:
    """One write of messages: to a bus (`kafka`, by its options), or files in `folder`, which
    are written over."""
    if fmt == "kafka":
        messages.write.format(fmt).options(**options).save()
    else:
        messages.write.format(fmt).options(**options).mode("overwrite").save(folder)


def order_for_export(df: DataFrame) -> DataFrame:
    """Whole-table order: consecutive version ranges per task, so a stream of any
    size is split; files in name order give each stream in version order."""
    return df.repartitionByRange("stream_id", "version").sortWithinPartitions("stream_id", "version")


def read_messages(spark: SparkSession, fmt: str, options: dict[str, str]) -> DataFrame:
    """Streaming read from the earliest offset; the checkpoint keeps the position.

    `path` among the options is the folder of a file format.
    """
    options = dict(options)
    path = options.pop("path", None)
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return reader.options(startingOffsets="earliest", includeHeaders="true").load()
    return reader.schema(MESSAGE_SCHEMA).load(path)


def message_context(headers: Column) -> Column:
    """struct<trace_id, correlation_id> carried by the headers, NULL where absent.

    Of repeated headers the last usable one counts.
    """

    def last(name: str, read, usable) -> Column:
        mine = F.filter(headers, lambda h: h["key"] == name)
        texts = F.transform(mine, lambda h: read(h["value"].cast("string")))
        return F.try_element_at(F.filter(texts, usable), F.lit(-1))

    return F.struct(
        last(
            "traceparent", lambda t: parse_traceparent(t)["trace_id"], lambda t: t.isNotNull()
        ).alias("trace_id"),
        last("correlation_id", lambda t: t, lambda t: t != "").alias("correlation_id"),
    )


def preview(value: Column, size: int = MESSAGE_PREVIEW_BYTES) -> Column:
    """The first `size` bytes as text, marked when cut. For people; nothing reads it back."""
    cut = F.concat(F.substring(value, 1, size).cast("string"), F.lit("…"))
    return F.when(F.octet_length(value) <= size, value.cast("string")).otherwise(cut)


def from_envelope_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Add `event` (struct of the 20 columns) and `decode_error` (NULL when fine).

    Strict on JSON types: a number where a text belongs is an error, as are a
    missing or malformed id and time. Unknown members are ignored, absent texts
    read as ''. The payload text is kept as written.
    """
    text = F.col(value).cast("string")
    doc = F.from_json(text, _DOC_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    parsed = fix_columns(df.withColumn("_text", text), _doc=doc)

    def member(name: str) -> Column:
        return F.col("_doc")[name]

    texts = {c: F.coalesce(variant_text(member(c)), F.lit("")) for c in _TEXT_FIELDS}
    times = {c: parse_rfc3339(variant_text(member(c))) for c in _TIME_FIELDS}
    whole = {c: F.try_variant_get(member(c), "$", t) for c, t in (("version", "bigint"), ("event_version", "int"))}
    flag = F.coalesce(F.try_variant_get(member("is_replay"), "$", "boolean"), F.lit(False))

    wrong_type = F.lit(False)
    for c in _TEXT_FIELDS + _TIME_FIELDS:
        wrong_type = wrong_type | ~variant_is(member(c), "STRING")
    for c in ("version", "event_version"):
        wrong_type = wrong_type | ~variant_is(member(c), "BIGINT")
    wrong_type = wrong_type | ~variant_is(member("is_replay"), "BOOLEAN")
    wrong_type = wrong_type | F.coalesce(
        F.exists(F.map_values(member("metadata")), lambda v: ~variant_is(v, "STRING")), F.lit(False)
    )
    error = (
        F.when(F.col("_doc").isNull() | member("_broken").isNotNull(), F.lit("not a JSON object"))
        .when(wrong_type, F.lit("wrong JSON type"))
        .when(~F.regexp_like(texts["id"], F.lit(UUID_PATTERN)), F.lit("bad event id"))
        .when(times["occurred_at"].isNull(), F.lit("bad occurred_at"))
        .when(
            variant_text(member("replayed_at")).isNotNull() & times["replayed_at"].isNull(),
            F.lit("bad replayed_at"),
        )
    )
    metadata = F.transform_values(member("metadata"), lambda _, v: F.coalesce(variant_text(v), F.lit("")))
    payload = F.when(member("payload").isNull(), F.lit(ABSENT_PAYLOAD)).otherwise(
        raw_member(F.col("_text"), "payload", COLS, member("payload"))
    )
    values = texts | times | {"is_replay": flag, "payload": payload}
    values |= {c: F.coalesce(v, F.lit(0)) for c, v in whole.items()}
    values["id"] = F.lower(texts["id"])
    values["metadata"] = F.coalesce(metadata, F.from_json(F.lit("{}"), "map<string,string>"))
    event = F.struct(*[values[c].cast(EVENT_SCHEMA[c].dataType).alias(c) for c in COLS])
    judged = fix_columns(parsed, decode_error=error)
    decoded = fix_columns(judged, event=F.when(F.col("decode_error").isNull(), event))
    return decoded.drop("_text", "_doc")


def judge_messages(df: DataFrame) -> DataFrame:
    """Messages with `event` or `decode_error`, and the context their headers carry."""
    return from_envelope_json(df).withColumn("context", message_context(F.col("headers")))


def events_of(judged: DataFrame) -> DataFrame:
    """The decoded events with their position and header context."""
    ok = judged.filter(F.col("decode_error").isNull())
    return ok.select("event.*", "topic", "partition", "offset", "context")


def quarantine_of(judged: DataFrame) -> DataFrame:
    """The undecodable messages, as much of them as an operator needs to find them."""
    return judged.filter(F.col("decode_error").isNotNull()).select(
        "topic",
        "partition",
        "offset",
        F.col("key").cast("string").alias("key"),
        F.col("context.trace_id").alias("trace_id"),
        F.col("context.correlation_id").alias("correlation_id"),
        preview(F.col("value")).alias("preview"),
        F.col("decode_error").alias("error"),
    )


def decode_messages(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of a frame of messages."""
    judged = judge_messages(df)
    return events_of(judged), quarantine_of(judged)


def to_wire9(df: DataFrame) -> DataFrame:
    """The nine fields of the wire form, payload as bytes."""
    return df.select(
        "id",
        "stream_id",
        "type",
        "source",
        "version",
        "occurred_at",
        F.col("payload").cast("binary").alias("payload"),
        "metadata",
        "correlation_id",
    )
