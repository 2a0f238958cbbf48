"""Structured Streaming jobs: ingest into the log, and projection with dead letters.

The checkpoint gives at-least-once. The log and the read model know each writer's batches and
write none twice; dead letters, quarantine and bus messages go to folders named after the
micro-batch, which a second run overwrites with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annalog.functions.envelope import indexable
from annalog.operators.skew import MAX_ROWS_PER_TASK
from annalog.plans.jobs import import_lines
from annalog.schema import REQUEST_MAX_BYTES
from annalog.sources.dlq import dlq_messages, to_dlq
from annalog.sources.batches import BATCH_SCHEMA, prepare
from annalog.sources.log import read_log
from annalog.sources.messages import (
    events_of,
    judge_messages,
    quarantine_of,
    send_in_order,
    to_messages,
    write_messages,
)
from annalog.sources.projection import upsert_projection
from annalog.sources.requests import request_lines

Rule = Callable[[], Column]


@dataclass(frozen=True)
class ProjectionPaths:
    """Folders; dead letters go to `dlq_bus` as keyed messages too, where it is given."""

    projection: str
    dlq: str
    quarantine: str
    dlq_bus: str = ""


def index_error() -> Column:
    """Why the read model refuses the event in the current row, NULL when it does not."""
    return F.when(~indexable(F.col("payload")), F.lit("payload is not an object"))


def _start(df: DataFrame, handle, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def run_ingest(
    spark: SparkSession,
    source: str,
    log_path: str,
    rejected_path: str,
    tenant: str,
    checkpoint: str,
    interval: str | None = None,
    max_files: int = 1000,
    max_bytes: int = REQUEST_MAX_BYTES,
) -> StreamingQuery:
    """Files of request bodies -> log. Without `interval` it drains what is there and ends."""
    lines = request_lines(spark.readStream.option("maxFilesPerTrigger", max_files).text(source))

    def handle(batch: DataFrame, batch_id: int) -> None:
        import_lines(batch, log_path, rejected_path, tenant, batch_id, writer=f"ingest {checkpoint}", max_bytes=max_bytes)

    return _start(lines, handle, checkpoint, interval)


def run_projection(
    messages: DataFrame,
    paths: ProjectionPaths,
    checkpoint: str,
    rule: Rule = index_error,
    interval: str | None = None,
) -> StreamingQuery:
    """Bus messages -> read model; refused events -> dead letters; undecodable
    messages -> quarantine. A bad event never stops the stream; a failing write
    fails the micro-batch, which is then run again in full."""
    spark = messages.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Decoding is the work; the three writes below share it.
        judged = judge_messages(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            events = events_of(judged).withColumn("index_error", rule())
            indexed = events.filter(F.col("index_error").isNull())
            upsert_projection(indexed, paths.projection, batch_id, writer=f"bus {checkpoint}")
            refused = events.filter(F.col("index_error").isNotNull())
            to_dlq(
                refused, F.col("index_error"), F.current_timestamp(), F.col("context.correlation_id")
            ).write.mode("overwrite").parquet(f"{paths.dlq}/batch_id={batch_id}")
            if paths.dlq_bus:
                dead = spark.read.parquet(f"{paths.dlq}/batch_id={batch_id}")
                dlq_messages(dead).write.mode("overwrite").parquet(f"{paths.dlq_bus}/batch_id={batch_id}")
            quarantine_of(judged).write.mode("overwrite").parquet(
                f"{paths.quarantine}/batch_id={batch_id}"
            )
        finally:
            judged.unpersist()

    return _start(messages, handle, checkpoint, interval)


def stream_commits(spark: SparkSession, log_path: str, max_batches: int = 100) -> DataFrame:
    """The batch table of a log, as a stream: whole batches, none before it counts."""
    return spark.readStream.schema(BATCH_SCHEMA).option("maxFilesPerTrigger", max_batches).parquet(prepare(spark, log_path))


def committed_events(records: DataFrame, log_path: str) -> DataFrame:
    """The events of the batches in a micro-batch of commit records."""
    numbers = [r.batch_id for r in records.select("batch_id").collect()]  # `max_batches` at most
    log = read_log(records.sparkSession, log_path, layout=True)
    return log.filter(F.col("batch_id").isin(*numbers) if numbers else F.lit(False))


def run_publish(
    spark: SparkSession,
    log_path: str,
    target: str,
    checkpoint: str,
    routes: dict[str, str],
    fallback: str,
    interval: str | None = None,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
    limit: int = MAX_ROWS_PER_TASK,
) -> StreamingQuery:
    """Log -> bus messages, each stream in version order, `limit` rows of it per task at a time.

    Files go to `<target>/batch_id=N/part=P`; with `fmt="kafka"` the options name the bus.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        def send(events: DataFrame, part: int) -> None:
            folder = f"{target}/batch_id={batch_id}/part={part}"
            write_messages(to_messages(events, routes, fallback), fmt, options or {}, folder)

        send_in_order(committed_events(batch, log_path), send, limit)

    return _start(stream_commits(spark, log_path), handle, checkpoint, interval)


def run_log_projection(
    spark: SparkSession,
    log_path: str,
    paths: ProjectionPaths,
    checkpoint: str,
    rule: Rule = index_error,
    interval: str | None = None,
) -> StreamingQuery:
    """Log -> read model without a bus between; the stream version is the offset."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        events = committed_events(batch, log_path)
        position = {"topic": F.lit(""), "partition": F.lit(0), "offset": F.col("version")}
        judged = events.withColumns({"index_error": rule(), **position})
        indexed = judged.filter(F.col("index_error").isNull())
        upsert_projection(indexed, paths.projection, batch_id, writer=f"log {checkpoint}")
        refused = judged.filter(F.col("index_error").isNotNull())
        to_dlq(refused, F.col("index_error"), F.current_timestamp()).write.mode(
            "overwrite"
        ).parquet(f"{paths.dlq}/batch_id={batch_id}")

    return _start(stream_commits(spark, log_path), handle, checkpoint, interval)
