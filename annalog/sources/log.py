"""The event log: an append-only Parquet table.

Layout: `<path>/batch_id=N/occurred_date=D/*.parquet`. Files hold consecutive
ranges of (tenant_id, stream_id, version): the date prunes folders, file and
row-group statistics prune tenants and streams, Bloom filters serve id,
correlation and causation lookups. A bulk-loaded log of few tenants may put
tenant_id before the date as folders (`folders=`); for micro-batches of many
tenants that would make one small file each. A batch's number comes from the log
(`sources/batches.py`): a batch that counts is never written again, and readers see only
batches that count. Days are UTC days, whatever the
session's zone.

Beside it, `<path>_heads/batch_id=N` keeps the highest version of each stream the
batch touched, and `<path>_ids/batch_id=N` the id and version of each row, sorted by a hash
bucket of the id. Finding the heads and the known ids of a new batch reads those narrow
tables instead of the log; every `MERGE_EVERY` batches they are merged, the ids into
one folder for each bucket, so that a batch reads the buckets it hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalog.functions.days import utc_day
from annalog.operators.append import assign_versions, drop_known, first_delivery, stream_heads
from annalog.operators.audit import upcast
from annalog.operators.numbering import version_digit
from annalog.operators.skew import MAX_ROWS_PER_TASK, small_side
from annalog.schema import COLS, EVENT_SCHEMA
from annalog.session import cut_lineage
from annalog.sources.batches import BatchConflict, content, find, next_batch, read_batches, record, table_or_none

LOG_SCHEMA = T.StructType(
    [*EVENT_SCHEMA.fields, T.StructField("batch_id", T.LongType()), T.StructField("occurred_date", T.DateType())]
)
HEAD_SCHEMA = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
ID_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
ID_BUCKETS = 256
MERGE_EVERY = 64
BLOOM_COLUMNS = ("id", "correlation_id", "causation_id")


def _scan(spark: SparkSession, path: str, log_path: str, schema: T.StructType, before: int | None) -> DataFrame:
    """The rows of batches that count; folders of others are pruned by the join."""
    df = table_or_none(spark, path, schema)
    if df is None:
        return spark.createDataFrame([], schema)
    df = df.join(small_side(read_batches(spark, log_path).select("batch_id")), "batch_id", "left_semi")
    df = df.select(*schema.fieldNames())
    return df if before is None else df.filter(F.col("batch_id") < before)


def read_log(
    spark: SparkSession,
    path: str,
    before: int | None = None,
    layout: bool = False,
    legacy: bool = False,
) -> DataFrame:
    """The 20 event columns of all batches that count; filters on them reach the Parquet scan.

    `before` keeps batches with a smaller id, `layout=True` adds batch_id and
    occurred_date. `legacy=True` is for logs with files from before some column
    existed: their rows read with the column's default, at the price that filters
    on such columns run after the scan.
    """
    df = _scan(spark, path, path, LOG_SCHEMA, before)
    if legacy:
        df = upcast(df)
    return df if layout else df.select(*COLS)


def read_heads(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Highest version per stream: the newest snapshot and the batches after it."""
    heads = _scan(spark, f"{path}_heads", path, HEAD_SCHEMA, before)
    snapshots = table_or_none(spark, f"{path}_head_snapshots", HEAD_SCHEMA)
    if snapshots is not None:
        snapshots = snapshots if before is None else snapshots.filter(F.col("batch_id") < before)
        newest = snapshots.agg(F.max("batch_id")).first()[0]
        if newest is not None:
            heads = heads.filter(F.col("batch_id") > newest).unionByName(
                snapshots.filter(F.col("batch_id") == newest)
            )
    return stream_heads(heads)


def snapshot_heads(spark: SparkSession, path: str, batch_id: int) -> None:
    """Merge the heads of all batches up to `batch_id`, so that later appends read
    one row per stream instead of one per stream and batch."""
    merged = read_heads(spark, path, before=batch_id + 1)
    merged.write.mode("overwrite").parquet(f"{path}_head_snapshots/batch_id={batch_id}")


def id_bucket(event_id: Column) -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(ID_BUCKETS)).cast("int")


def read_ids(
    spark: SparkSession, path: str, batch: DataFrame | None = None, before: int | None = None
) -> DataFrame:
    """(id, version) of the log from its id index; with `batch`, only the buckets that hold
    an id of it: folders of the merged index, row groups of the batches since."""
    deltas = _scan(spark, f"{path}_ids", path, ID_SCHEMA, before)
    merged = table_or_none(spark, f"{path}_id_snapshots", ID_SCHEMA)
    if merged is not None and before is not None:
        merged = merged.filter(F.col("batch_id") < before)
    newest = None if merged is None else merged.agg(F.max("batch_id")).first()[0]
    if newest is not None:
        deltas = deltas.filter(F.col("batch_id") > newest)
    hit = None
    if batch is not None:  # `ID_BUCKETS` numbers at most
        hit = F.col("bucket").isin([r.b for r in batch.select(id_bucket(F.col("id")).alias("b")).distinct().collect()])
    parts = [deltas] if newest is None else [deltas, merged.filter(F.col("batch_id") == newest)]
    parts = [(p if hit is None else p.filter(hit)).select("id", "version") for p in parts]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def merge_ids(spark: SparkSession, path: str, batch_id: int) -> None:
    """One table of the ids of all batches up to `batch_id`, a folder for each bucket."""
    every = read_ids(spark, path, before=batch_id + 1).withColumn("bucket", id_bucket(F.col("id")))
    target = f"{path}_id_snapshots/batch_id={batch_id}"
    every.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)


def from_text_metadata(df: DataFrame) -> DataFrame:
    """Rows whose metadata is JSON text, as a database export has it."""
    return df.withColumn("metadata", F.from_json("metadata", "map<string,string>")).select(*COLS)


def write_batch(
    df: DataFrame,
    path: str,
    batch_id: int,
    folders: Sequence[str] = ("occurred_date",),
    max_records: int = 5_000_000,
) -> None:
    """Write rows that already have versions as batch `batch_id` of the log.

    Range partitioning by the sort key splits a day, tenant or stream that is too
    large for one task; a hash of them would not. `folders` must be the same for
    all batches of a log.
    """
    keys = [*folders, *[c for c in ("tenant_id", "stream_id", "version") if c not in folders]]
    dated = df.select(*COLS).withColumn("occurred_date", utc_day(F.col("occurred_at")))
    writer = (
        dated.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .partitionBy(*folders)
        .option("maxRecordsPerFile", max_records)
        .option("parquet.bloom.filter.adaptive.enabled", "true")
    )
    for name in BLOOM_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(f"{path}/batch_id={batch_id}")


def append_batch(
    df: DataFrame,
    path: str,
    batch_id: int,
    *,
    writer: str,
    order: list | None = None,
    digits: list | None = None,
    limit: int = MAX_ROWS_PER_TASK,
    folders: Sequence[str] = ("occurred_date",),
    stored: bool = False,
    position: str | None = None,
) -> int:
    """Idempotent append with version assignment; returns the log's batch number.

    `batch_id` is `writer`'s own number of the batch. `stored=True` says that `df`
    is already a stored table with unique ids. `position` names a column of whole numbers
    from 1 that orders the batch; without it versions follow (occurred_at, id).

    Running a writer's batch again, after any failure, gives the same log; its number with
    other ids raises `BatchConflict` and changes nothing. Random ids or times in `df` must
    be fixed before (see `normalise(id_from=…)`).
    """
    spark = df.sparkSession
    # Stored once: read several times below, and its size decides the join.
    names = COLS if position is None else [*COLS, position]
    batch = df.select(*names) if stored else cut_lineage(first_delivery(df, order).select(*names))
    rows, digest = content(batch)
    known = find(spark, path, writer, batch_id)
    if known is not None:
        if known[1:] != (rows, digest):
            raise BatchConflict(f"writer {writer!r} wrote batch {batch_id} before, with other rows")
        return known[0]
    number = next_batch(spark, path, batch_id)
    fresh = drop_known(batch, read_ids(spark, path, batch))
    by = None
    if position is not None:
        by, digits = [F.col(position)], [version_digit(F.col(position))]
    heads = read_heads(spark, path)
    commit(assign_versions(fresh, heads, order=by, digits=digits, limit=limit), path, number, folders)
    record(spark, path, writer, batch_id, number, rows, digest)
    if number % MERGE_EVERY == MERGE_EVERY - 1:
        snapshot_heads(spark, path, number)
        merge_ids(spark, path, number)
    return number


def commit(
    df: DataFrame, path: str, batch_id: int, folders: Sequence[str] = ("occurred_date",)
) -> None:
    """Store versioned rows as a batch that does not count yet, then the heads of the
    streams it touched and its ids. Whatever a killed writer left under the number goes."""
    write_batch(df, path, batch_id, folders)
    # From the stored rows, so heads and log cannot disagree.
    stored = df.sparkSession.read.schema(LOG_SCHEMA).parquet(f"{path}/batch_id={batch_id}")
    stream_heads(stored).write.mode("overwrite").parquet(f"{path}_heads/batch_id={batch_id}")
    ids = stored.select("id", "version", id_bucket(F.col("id")).alias("bucket"))
    ids.repartitionByRange("bucket", "id").sortWithinPartitions("bucket").write.mode("overwrite").parquet(
        f"{path}_ids/batch_id={batch_id}"
    )
