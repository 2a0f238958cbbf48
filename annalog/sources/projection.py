"""The read model: one row per event id, the last delivery wins.

Three tables: `<path>/batch_id=N` holds the deliveries of a micro-batch as they came,
`<path>_base/batch_id=N` one row per id for all batches up to N, and `<path>_batches` a row
for each batch that counts (`sources/batches.py`). Writing a batch moves no row to another
task. A read takes the newest base, leaves out ids that were delivered since, and
adds the last delivery of those; the base is neither sorted nor grouped. Every
`MERGE_EVERY` batches a new base is made, so what came since stays small.

A delivery's position is (batch, topic, partition, offset): offsets order one partition
only, so between partitions the later micro-batch wins, and within one the greater topic
and partition, the same in every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalog.operators.skew import small_side
from annalog.schema import COLS, EVENT_SCHEMA
from annalog.sources.batches import content, find, next_batch, read_batches, record, table_or_none

POSITION = ["topic", "partition", "offset"]
DELIVERY_SCHEMA = T.StructType(
    [
        *EVENT_SCHEMA.fields,
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
MERGE_EVERY = 32
_MERGES = "merge"  # the writer's name of bases in the table of bases


def latest_by_id(df: DataFrame, position: Sequence[str]) -> DataFrame:
    """One row per id, the one of the greatest `position`, which no two rows of an id share.

    In two steps: ids and positions alone are reduced, combined map-side, so a document
    delivered millions of times leaves one candidate per task; then the winners take their
    whole rows by id and position, over which the copies of a hot id are spread.
    Empty positions rank lowest.
    """
    place = F.struct(*position)
    winners = df.select("id", place.alias("_at")).groupBy("id").agg(F.max("_at").alias("_at"))
    same = (F.col("_mine") == F.col("_at")) & (F.col("id") == F.col("_winner"))
    keys = winners.withColumnRenamed("id", "_winner").hint("shuffle_hash")
    return df.withColumn("_mine", place).join(keys, same, "left_semi").select(*df.columns)


def upsert_projection(df: DataFrame, path: str, batch_id: int, writer: str) -> int:
    """Create-or-overwrite by id: the deliveries (event columns, topic, partition, offset) of
    `writer`'s batch; returns the read model's number of it.

    A batch that counts is not written again: running it again, after any failure,
    changes nothing under readers.
    """
    spark = df.sparkSession
    known = find(spark, path, writer, batch_id)
    if known is not None:
        return known[0]
    number = next_batch(spark, path)
    df.select(*COLS, *POSITION).write.mode("overwrite").parquet(f"{path}/batch_id={number}")
    stored = spark.read.schema(DELIVERY_SCHEMA).parquet(f"{path}/batch_id={number}")
    record(spark, path, writer, batch_id, number, *content(stored))
    if number % MERGE_EVERY == MERGE_EVERY - 1:
        merge_projection(spark, path)
    return number


def _newest_base(spark: SparkSession, path: str) -> int | None:
    return read_batches(spark, f"{path}_base").agg(F.max("batch_id")).first()[0]


def _since(spark: SparkSession, path: str, base: int | None) -> DataFrame | None:
    """Deliveries of the batches that count and are not in the base, each with its place in
    the files, which tells apart copies of one message."""
    rows = table_or_none(spark, path, DELIVERY_SCHEMA)
    if rows is None:
        return None
    rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    if base is not None:
        rows = rows.filter(F.col("batch_id") > base)
    return rows.join(small_side(read_batches(spark, path).select("batch_id")), "batch_id", "left_semi")


def read_projection(
    spark: SparkSession, path: str, tenant: str | None = None, stream_id: str | None = None
) -> DataFrame:
    """One row per event id, the last delivery wins.

    An event never changes its tenant or stream, so these two filters apply before
    the copies are merged and reach both scans; any other filter belongs after.
    """

    def mine(df: DataFrame) -> DataFrame:
        if tenant is not None:
            df = df.filter(F.col("tenant_id") == tenant)
        return df if stream_id is None else df.filter(F.col("stream_id") == stream_id)

    number = _newest_base(spark, path)
    since = _since(spark, path, number)
    if since is None:
        return spark.createDataFrame([], EVENT_SCHEMA)
    since = mine(since)
    latest = latest_by_id(since, ["batch_id", *POSITION, "_file", "_row"]).select(*COLS)
    if number is None:
        return latest
    base = mine(spark.read.schema(EVENT_SCHEMA).parquet(f"{path}_base/batch_id={number}"))
    replaced = since.select("id").distinct()
    return base.join(small_side(replaced), "id", "left_anti").select(*COLS).unionByName(latest)


def merge_projection(spark: SparkSession, path: str) -> None:
    """A new base of all batches that count, sorted for pages of tenants and streams. It
    counts once its row stands in the table of bases; readers use the one before until then."""
    last = read_batches(spark, path).agg(F.max("batch_id")).first()[0]
    if last is None or last == _newest_base(spark, path):
        return
    keys = ["tenant_id", "stream_id", "version"]
    (
        read_projection(spark, path)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .parquet(f"{path}_base/batch_id={last}")
    )
    record(spark, f"{path}_base", _MERGES, last, last, 0, 0)
