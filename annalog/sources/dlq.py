"""Dead-letter envelopes: the failed event, why, when, and its correlation id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.functions.envelope import envelope_json, rfc3339
from annalog.functions.trace import coalesce_id
from annalog.schema import COLS


def to_dlq(
    df: DataFrame, reason: Column, failed_at: Column, header_correlation: Column | None = None
) -> DataFrame:
    """struct columns event, reason, failed_at, correlation_id. The message header's
    correlation id beats the event's."""
    header = F.lit(None).cast("string") if header_correlation is None else header_correlation
    return df.select(
        F.struct(*COLS).alias("event"),
        reason.alias("reason"),
        failed_at.alias("failed_at"),
        coalesce_id(header, F.col("correlation_id")).alias("correlation_id"),
    )


def dlq_messages(dlq: DataFrame) -> DataFrame:
    """Bus form: key = event id, value = JSON, time = failed_at.

    A redelivered event may be dead-lettered again; readers dedupe by key.
    """
    flat = dlq.select("event.*", "reason", "failed_at", F.col("correlation_id").alias("dlq_correlation_id"))
    rest = F.to_json(
        F.struct(
            "reason",
            rfc3339(F.col("failed_at")).alias("failed_at"),
            F.col("dlq_correlation_id").alias("correlation_id"),
        )
    )
    value = F.concat(F.lit('{"event":'), envelope_json(), F.lit(","), F.substring(rest, 2, 2**31 - 1))
    return flat.select(
        F.col("id").cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.col("failed_at").alias("timestamp"),
    )
