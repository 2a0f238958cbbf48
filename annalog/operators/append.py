"""Version assignment and id idempotency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.operators.lookup import lookup
from annalog.operators.numbering import event_digits, running_total
from annalog.operators.skew import MAX_ROWS_PER_TASK, is_small, small_side, stored_keys
from annalog.session import cut_lineage


def stream_heads(log: DataFrame) -> DataFrame:
    """Highest version per stream over all tenants; combines map-side."""
    return log.groupBy("stream_id").agg(F.max("version").alias("version"))


def assign_versions(
    df: DataFrame,
    heads: DataFrame | None = None,
    order: Sequence[Column] | None = None,
    digits: Sequence[Column] | None = None,
    limit: int = MAX_ROWS_PER_TASK,
) -> DataFrame:
    """version = highest stored version of the stream + 1, 2, 3 … in `order`.

    One counter per `stream_id`, shared by all tenants. Default order is
    (occurred_at, id).
    """
    order = [F.col("occurred_at"), F.col("id")] if order is None else list(order)
    digits = event_digits() if digits is None else digits
    numbered = running_total(
        df.drop("version"), ["stream_id"], order, digits, name="version", limit=limit
    )
    if heads is None:
        return numbered.select(*df.columns)
    known = heads.select("stream_id", F.col("version").alias("top"))
    return (
        lookup(numbered, known, ["stream_id"], "_head", limit=limit)
        .withColumn("version", F.col("version") + F.coalesce(F.col("_head.top"), F.lit(0)))
        .select(*df.columns)
    )


def first_delivery(df: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """One row per id: the first by `order`.

    Repeated ids are looked for by id alone; usually there are few, and only their
    rows are merged. The merge combines map-side, so an id delivered any number of
    times never gathers in one task.
    """
    repeated = stored_keys(df, ["id"], 1)
    if repeated is None:
        return df
    if not is_small(repeated):
        return _first_of(df, order)
    ids = F.broadcast(repeated)
    merged = _first_of(df.join(ids, "id", "left_semi"), order)
    return df.join(ids, "id", "left_anti").unionByName(merged)


def _first_of(df: DataFrame, order: Sequence[Column] | None) -> DataFrame:
    # The digest decides between rows that are equal in `order`, whatever the input's order.
    maps = {f.name for f in df.schema if f.dataType.typeName() == "map"}
    whole = [F.array_sort(F.map_entries(c)) if c in maps else F.col(c) for c in df.columns]
    rank = F.struct(*(order or [F.col("occurred_at"), F.col("stream_id")]), F.xxhash64(*whole))
    rest = [c for c in df.columns if c != "id"]
    return (
        df.groupBy("id")
        .agg(F.min_by(F.struct(*rest), rank).alias("_row"))
        .select("id", "_row.*")
        .select(*df.columns)
    )


def stored_versions(df: DataFrame, log: DataFrame) -> DataFrame:
    """(id, version) of those ids of `df` that the log already has.

    Never larger than the batch. Only `id` and `version` of the log are read; the
    batch's ids go to the log by broadcast when they are few (give a stored batch,
    whose size Spark knows), so an append does not shuffle the log.
    """
    ids = df.select("id").distinct()
    return log.select("id", "version").join(small_side(ids), "id", "left_semi")


def drop_known(df: DataFrame, log: DataFrame) -> DataFrame:
    """Rows whose id is not stored yet. Run before `assign_versions`: a retry
    burns no version. The known ids are stored first, so that a batch with few of
    them is filtered in place instead of shuffled."""
    known = cut_lineage(stored_versions(df, log).select("id"))
    return df.join(small_side(known), "id", "left_anti")


def append_result(
    batch: DataFrame, log: DataFrame, limit: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """What the append answers: every id of the batch once, its version, `is_new`.

    A known id answers with the stored version; the retry's payload is ignored.
    """
    unique = cut_lineage(first_delivery(batch))
    known = cut_lineage(stored_versions(unique, log))
    new = unique.join(small_side(known.select("id")), "id", "left_anti")
    fresh = assign_versions(new, stream_heads(log), limit=limit)
    return fresh.select("id", "version", F.lit(True).alias("is_new")).unionByName(
        known.withColumn("is_new", F.lit(False))
    )
