"""Topic routing by stream prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_prefix(stream_id: Column) -> Column:
    """Text before the first ':', NULL when there is none or it is empty."""
    return F.when(F.instr(stream_id, ":") > 1, F.substring_index(stream_id, ":", 1))


def topic_column(stream_id: Column, routes: dict[str, str], fallback: str) -> Column:
    """Routes given by the job: a literal map, no join."""
    if not routes:
        return F.lit(fallback)
    pairs = [F.lit(text) for pair in routes.items() for text in pair]
    return F.coalesce(F.create_map(*pairs)[stream_prefix(stream_id)], F.lit(fallback))


def route_by_table(df: DataFrame, routes: DataFrame, fallback: str) -> DataFrame:
    """Routes as a table (prefix, topic, position); a repeated prefix: the last wins.

    No broadcast hint: the table may be of any size, so Spark chooses from its
    statistics, and AQE splits a prefix that holds much of the log.
    """
    last = routes.groupBy("prefix").agg(F.max_by("topic", "position").alias("_topic"))
    return (
        df.withColumn("prefix", stream_prefix(F.col("stream_id")))
        .join(last, "prefix", "left")
        .withColumn("topic", F.coalesce("_topic", F.lit(fallback)))
        .drop("prefix", "_topic")
    )
