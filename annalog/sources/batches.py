"""The batch table of a log: one row for each batch that counts.

`<log>_batches` is a Parquet table (writer, number, batch_id, rows, digest). A writer names
itself and numbers its own batches; the log gives each the next `batch_id`. The row is
appended after the batch's data, so a batch is seen whole or not at all: readers keep the
rows of the log whose batch_id is in this table. What a killed writer left under a number is
seen by nobody and written over by the next batch.

A batch that is in the table is never written again. The same writer and number with the
same ids is a retry and answers with the batch that is there; with other ids it is an error.

Appends to one log take turns: two at the very same time would number streams alike.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_SCHEMA = "writer string, number long, batch_id long, rows long, digest long"


class BatchConflict(ValueError):
    """A writer's batch number came again with other rows."""


def batches_path(log_path: str) -> str:
    return f"{log_path.rstrip('/')}_batches"


def table_or_none(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """A Parquet table, or None where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_batches(spark: SparkSession, log_path: str) -> DataFrame:
    found = table_or_none(spark, batches_path(log_path), BATCH_SCHEMA)
    return spark.createDataFrame([], BATCH_SCHEMA) if found is None else found


def content(ids: DataFrame) -> tuple[int, int]:
    """Rows of a batch, and a digest of their ids that no order or partitioning changes."""
    rows, digest = ids.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("id")), F.lit(0))).first()
    return rows, digest


def find(spark: SparkSession, log_path: str, writer: str, number: int) -> tuple[int, int, int] | None:
    """(batch_id, rows, digest) of a writer's batch that counts already."""
    own = read_batches(spark, log_path).where((F.col("writer") == writer) & (F.col("number") == number))
    return next((tuple(r) for r in own.select("batch_id", "rows", "digest").limit(1).collect()), None)


def next_batch(spark: SparkSession, log_path: str, least: int = 0) -> int:
    """The number after all that count, and `least` at least."""
    last = read_batches(spark, log_path).agg(F.max("batch_id")).first()[0]
    return least if last is None else max(least, last + 1)


def record(spark: SparkSession, log_path: str, writer: str, number: int, batch_id: int, rows: int, digest: int) -> None:
    """Makes a written batch count: a table of one file is appended, whole or not at all."""
    row = spark.createDataFrame([(writer, number, batch_id, rows, digest)], BATCH_SCHEMA).coalesce(1)
    row.write.mode("append").parquet(batches_path(log_path))


def prepare(spark: SparkSession, log_path: str) -> str:
    """The batch table's folder, made if it is missing, so that a stream can watch it."""
    spark.createDataFrame([], BATCH_SCHEMA).coalesce(1).write.mode("ignore").parquet(batches_path(log_path))
    return batches_path(log_path)
