"""Whole-table integrity audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalog.operators.lookup import lookup
from annalog.operators.numbering import version_digit
from annalog.operators.skew import MAX_ROWS_PER_TASK
from annalog.schema import COLUMN_DEFAULTS, COLS, EVENT_SCHEMA


def gap_check(df: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """One row per stream: bounds, counts, and whether its versions are contiguous."""
    # Distinct versions first: the group by (stream, version) spreads a long stream.
    return (
        df.groupBy(*keys, "version")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys)
        .agg(
            F.min("version").alias("first_version"),
            F.max("version").alias("last_version"),
            F.sum("_n").alias("events"),
            F.count(F.lit(1)).alias("distinct_versions"),
        )
        .withColumn(
            "contiguous",
            (F.col("last_version") - F.col("first_version") + 1 == F.col("events"))
            & (F.col("events") == F.col("distinct_versions")),
        )
    )


def gaps(
    df: DataFrame, keys: Sequence[str] = ("stream_id",), width: int = 100_000
) -> DataFrame:
    """Every place where a version does not follow its predecessor by one.

    Columns: keys, previous_version, missing_version, found_version, times. A
    version stored n times is a gap found n - 1 times. A start above 1 is fine.

    `lag` over a whole stream would sort it in one task. Versions are cut into
    ranges of `width`; each range is compared on its own, and its first version
    with the last one of the nearest earlier range.
    """
    keys = list(keys)
    versions = (
        df.groupBy(*keys, "version")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("cell", version_digit(F.col("version"), width))
    )
    inside = Window.partitionBy(*keys, "cell").orderBy("version")
    cells = versions.groupBy(*keys, "cell").agg(F.max("version").alias("_top"))
    across = Window.partitionBy(*keys).orderBy("cell")
    earlier = cells.select(*keys, "cell", F.lag("_top").over(across).alias("_earlier"))
    linked = (
        versions.withColumn("_here", F.lag("version").over(inside))
        .join(earlier, [*keys, "cell"])
        .withColumn("previous_version", F.coalesce("_here", "_earlier"))
    )
    breaks = linked.filter(F.col("version") != F.col("previous_version") + 1).select(
        *keys, "previous_version", F.col("version").alias("found_version"), F.lit(1).cast("bigint").alias("times")
    )
    repeats = versions.filter("copies > 1").select(
        *keys,
        F.col("version").alias("previous_version"),
        F.col("version").alias("found_version"),
        (F.col("copies") - 1).alias("times"),
    )
    return breaks.unionByName(repeats).select(
        *keys,
        "previous_version",
        (F.col("previous_version") + 1).alias("missing_version"),
        "found_version",
        "times",
    )


def _without_source(
    df: DataFrame, log: DataFrame, reference: str, limit: int
) -> DataFrame:
    known = log.select("tenant_id", F.col("id").alias(reference))
    asked = lookup(df, known, ["tenant_id", reference], "_source", limit=limit)
    return asked.filter(F.col("_source").isNull()).drop("_source")


def lineage_orphans(df: DataFrame, limit: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """Replayed events whose source event does not exist in their tenant."""
    replayed = df.filter("is_replay").select(
        "tenant_id", "id", "stream_id", "version", "replay_id", "replay_source_event_id"
    )
    return _without_source(replayed, df, "replay_source_event_id", limit)


def causation_orphans(df: DataFrame, limit: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """Events that name a cause which does not exist in their tenant."""
    caused = df.filter(F.col("causation_id") != "").select(
        "tenant_id", "id", "stream_id", "version", "causation_id"
    )
    return _without_source(caused, df, "causation_id", limit)


def index_missing(
    log: DataFrame,
    projection: DataFrame,
    tenant: str,
    from_time=None,
    to_time=None,
    limit: int | None = None,
) -> DataFrame:
    """Stored events that the read model lacks, newest first (all, or the first `limit`)."""

    def asked(df: DataFrame) -> DataFrame:
        df = df.filter(F.col("tenant_id") == tenant)
        if from_time is not None:
            df = df.filter(F.col("occurred_at") >= F.lit(from_time))
        return df if to_time is None else df.filter(F.col("occurred_at") <= F.lit(to_time))

    missing = asked(log).join(asked(projection).select("id"), "id", "left_anti").select(
        "id", "tenant_id", "stream_id", "type", "occurred_at"
    )
    ordered = missing.orderBy(F.col("occurred_at").desc(), F.col("id").desc())
    return ordered if limit is None else ordered.limit(limit)


def replay_verify(df: DataFrame) -> DataFrame:
    """Per replay batch: rows, distinct sources, and whether each source came once."""
    return (
        df.filter("is_replay")
        .groupBy("tenant_id", "replay_id")
        .agg(
            F.count(F.lit(1)).alias("replayed_count"),
            F.countDistinct("replay_source_event_id").alias("source_count"),
        )
        .withColumn("one_per_source", F.col("replayed_count") == F.col("source_count"))
    )


def upcast(df: DataFrame) -> DataFrame:
    """Rows written before a column existed, with the column's default."""
    have = set(df.columns)

    def column(name: str) -> Column:
        kind = EVENT_SCHEMA[name].dataType
        value = F.col(name) if name in have else F.lit(None)
        if name in COLUMN_DEFAULTS:
            value = F.coalesce(value.cast(kind), F.lit(COLUMN_DEFAULTS[name]))
        elif name == "metadata":
            value = F.coalesce(value.cast(kind), F.from_json(F.lit("{}"), "map<string,string>"))
        return value.cast(kind).alias(name)

    others = [c for c in df.columns if c not in COLS]
    return df.select(*[column(c) for c in COLS], *others)


def correlation_profile(df: DataFrame) -> DataFrame:
    """Per tenant and correlation id: events, streams, first and last time."""
    # By stream first, so one large correlation set is counted in many tasks.
    return (
        df.filter(F.col("correlation_id") != "")
        .groupBy("tenant_id", "correlation_id", "stream_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("occurred_at").alias("_first"),
            F.max("occurred_at").alias("_last"),
        )
        .groupBy("tenant_id", "correlation_id")
        .agg(
            F.sum("_n").alias("events"),
            F.count(F.lit(1)).alias("streams"),
            F.min("_first").alias("first_at"),
            F.max("_last").alias("last_at"),
        )
    )


def correlation_tenants(df: DataFrame) -> DataFrame:
    """Correlation ids seen in more than one tenant, with the number of tenants."""
    return (
        df.filter(F.col("correlation_id") != "")
        .groupBy("correlation_id")
        .agg(F.countDistinct("tenant_id").alias("tenants"), F.count(F.lit(1)).alias("events"))
        .filter("tenants > 1")
    )


def read_service_logs(spark, path: str) -> DataFrame:
    """JSON-lines service logs; the trace id may be spelled trace_id or traceId."""
    lines = spark.read.schema(
        "trace_id string, traceId string, service string, msg string"
    ).option("caseSensitive", "true").json(path)
    return lines.select(
        F.coalesce(F.col("trace_id"), F.col("traceId")).alias("trace_id"), "service", "msg"
    )


def traces(events: DataFrame) -> DataFrame:
    """One row per trace: events, tenants, first and last time."""
    return (
        events.filter(F.col("trace_id") != "")
        .groupBy("trace_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.min("tenant_id").alias("tenant_id"),
            F.min("occurred_at").alias("first_at"),
            F.max("occurred_at").alias("last_at"),
        )
    )


def correlate_logs(events: DataFrame, logs: DataFrame, limit: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """Each log line of a known trace with that trace's events, in summary.

    The event side is one row per trace, so the result has one row per log line
    and a busy trace does not multiply.
    """
    lines = logs.filter(F.col("trace_id").isNotNull() & (F.col("trace_id") != ""))
    joined = lookup(lines, traces(events), ["trace_id"], "trace", limit=limit)
    return joined.filter(F.col("trace").isNotNull()).select(
        *logs.columns, "trace.events", "trace.tenant_id", "trace.first_at", "trace.last_at"
    )
