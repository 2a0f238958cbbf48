"""From decoded requests to normalised events (before versions are assigned)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.functions.envelope import stable_uuid
from annalog.functions.trace import blank_to_null, coalesce_id, resolve_trace
from annalog.schema import ABSENT_PAYLOAD, COLS, EVENT_SCHEMA, FIELDS_MISSING, TENANT_MISSING

REQUIRED = ("stream_id", "type", "source")


def reject_reason() -> Column:
    """NULL for a valid row, else why it is refused."""
    missing_tenant = F.coalesce(F.col("tenant_id"), F.lit("")) == ""
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | (F.coalesce(F.col(name), F.lit("")) == "")
    return F.when(
        missing_tenant, F.lit(TENANT_MISSING)
    ).when(missing, F.lit(FIELDS_MISSING))


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with `reject_reason`). A rejected row stores nothing."""
    judged = df.withColumn("reject_reason", reject_reason())
    return (
        judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        judged.filter(F.col("reject_reason").isNotNull()),
    )


def stamp_tenant(df: DataFrame, tenant: str) -> DataFrame:
    """The caller's tenant replaces whatever the body says."""
    return df.withColumn("tenant_id", F.lit(tenant))


def stamp_tenants(df: DataFrame, credentials: DataFrame) -> DataFrame:
    """Files of many callers: `credential` -> tenant_id from a table.

    Rows of an unknown credential get a NULL tenant, which `validate` refuses.
    """
    known = credentials.groupBy("credential").agg(F.max("tenant_id").alias("tenant_id"))
    return df.drop("tenant_id").join(known, "credential", "left")


def resolve_headers(
    df: DataFrame, headers: str = "headers", fresh: Column | None = None
) -> DataFrame:
    """Correlation, causation and trace from a map of lower-case header names.

    Header beats request id beats a new id; for causation and trace the header
    beats the body. `fresh` replaces the random UUID given to rows that bring
    neither; derive it from the source position to make retries repeatable.
    """
    made = F.uuid() if fresh is None else fresh
    h = F.col(headers)

    def body(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit("")

    correlation = F.coalesce(
        blank_to_null(h["x-correlation-id"]), blank_to_null(h["x-request-id"]), made
    )
    trace = resolve_trace(
        h["traceparent"],
        h["x-trace-id"],
        F.coalesce(blank_to_null(body("trace_id")), F.replace(made, F.lit("-"), F.lit(""))),
    )
    return df.withColumns(
        {
            "correlation_id": correlation,
            "causation_id": coalesce_id(h["x-causation-id"], body("causation_id")),
            "trace_id": trace,
        }
    )


def normalise(
    df: DataFrame,
    now: Column | dt.datetime | None = None,
    id_from: list[Column] | None = None,
) -> DataFrame:
    """Envelope defaults; version stays 0 until the append assigns it.

    `id_from` names the row's source position (topic, partition, offset, or file
    and line); ids derived from it survive task retries and make a second
    delivery the same event. Without it ids are random.
    """
    when = F.current_timestamp() if now is None else (now if isinstance(now, Column) else F.lit(now))
    made = F.uuid() if id_from is None else stable_uuid(*[c.cast("string") for c in id_from])
    have = set(df.columns)

    def given(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None)

    def text(name: str) -> Column:
        return F.coalesce(given(name).cast("string"), F.lit(""))

    empty_map = F.from_json(F.lit("{}"), "map<string,string>")
    exprs = {
        "id": F.lower(F.coalesce(blank_to_null(given("id").cast("string")), made)),
        "tenant_id": F.col("tenant_id"),
        "stream_id": F.col("stream_id"),
        "type": F.col("type"),
        "source": F.col("source"),
        "version": F.lit(0).cast("bigint"),
        "event_version": F.when(given("event_version").cast("int") > 0, given("event_version").cast("int"))
        .otherwise(F.lit(1)),
        "occurred_at": when.cast("timestamp"),
        "payload": F.coalesce(blank_to_null(given("payload").cast("string")), F.lit(ABSENT_PAYLOAD)),
        "metadata": F.coalesce(given("metadata").cast("map<string,string>"), empty_map),
        "correlation_id": F.coalesce(
            blank_to_null(given("correlation_id").cast("string")),
            F.uuid() if id_from is None else stable_uuid(F.lit("correlation"), *[c.cast("string") for c in id_from]),
        ),
        "is_replay": F.lit(False),
        "replayed_at": F.lit(None).cast("timestamp"),
    }
    for name in COLS:
        exprs.setdefault(name, F.lit("") if name.startswith("replay") else text(name))
    extra = [c for c in df.columns if c not in COLS]
    return df.select(*[exprs[c].cast(EVENT_SCHEMA[c].dataType).alias(c) for c in COLS], *extra)
