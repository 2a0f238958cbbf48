"""Stored causation labels of a log: the root of each event's tree and its depth there.

Brought up to date batch by batch, so that a tree is a lookup by root. Three narrow tables
beside a batch table (`sources/batches.py`), each a folder for every update:

* `<path>/batch_id=N`: an update's events with root and depth as known then. The rows are
  sorted by a hash bucket of the id, so an update reads the row groups of its causes.
* `<path>_open/batch_id=N`: roots that name a cause nobody has stored yet.
* `<path>_links/batch_id=N`: such roots whose cause came later, with their own root and
  depth. Labels below them are not rewritten; `read_labels` follows the links.

Events in a cycle, or caused by one, have neither root nor depth. Updates of one log take turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalog.operators.causation import climb
from annalog.operators.lookup import lookup
from annalog.operators.skew import MAX_ROWS_PER_TASK, small_side
from annalog.session import cut_lineage
from annalog.sources.batches import read_batches, record, table_or_none
from annalog.sources.log import id_bucket, read_log

LABEL_SCHEMA = (
    "tenant_id string, id string, causation_id string, root_id string, depth long, bucket int, batch_id long"
)
OPEN_SCHEMA = "tenant_id string, id string, causation_id string, batch_id long"
LINK_SCHEMA = "tenant_id string, root_id string, new_root string, more long, batch_id long"
_WRITER = "labels"
_KEY = ["tenant_id", "id"]


def _scan(spark: SparkSession, path: str, suffix: str, schema: str) -> DataFrame:
    rows = table_or_none(spark, path + suffix, schema)
    if rows is None:
        return spark.createDataFrame([], schema)
    return rows.join(small_side(read_batches(spark, path).select("batch_id")), "batch_id", "left_semi")


def _links(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """(tenant_id, root_id, new_root, more) with `new_root` a root of today, or NULL for a cycle."""
    links = _scan(spark, path, "_links", LINK_SCHEMA).select("tenant_id", F.col("root_id").alias("id"), "new_root", "more")
    moved = links.select("tenant_id", F.col("id").alias("new_root"), F.lit(True).alias("_moved"))
    state = links.join(moved, ["tenant_id", "new_root"], "left").select(
        *_KEY, F.col("new_root").alias("up"), F.col("more").alias("depth"), F.col("_moved").isNull().alias("done")
    )
    return climb(state, limit).select(
        "tenant_id", F.col("id").alias("root_id"), F.col("up").alias("new_root"), F.col("depth").alias("more")
    )


def _follow(rows: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """Labels as first stored -> labels of today. Rows without a root stay so."""
    rooted = rows.filter(F.col("root_id").isNotNull())
    found = lookup(rooted, links, ["tenant_id", "root_id"], "_link", limit=limit)
    linked = F.col("_link").isNotNull()
    depth = F.when(~linked, F.col("depth")).otherwise(F.col("depth") + F.col("_link.more"))
    root = F.when(linked, F.col("_link.new_root")).otherwise(F.col("root_id"))
    found = found.withColumns({"depth": depth, "root_id": root}).select(*rows.columns)
    return found.unionByName(rows.filter(F.col("root_id").isNull()))


def read_labels(spark: SparkSession, path: str, limit: int = MAX_ROWS_PER_TASK) -> DataFrame:
    """(tenant_id, id, causation_id, root_id, depth) of every labelled event."""
    rows = _scan(spark, path, "", LABEL_SCHEMA).select(*_KEY, "causation_id", "root_id", "depth")
    return _follow(rows, _links(spark, path, limit), limit)


def update_labels(spark: SparkSession, log_path: str, path: str, limit: int = MAX_ROWS_PER_TASK) -> int | None:
    """Label the batches of a log that have no labels yet, as one update named after the
    last of them; its number, or None where nothing was new. An update that was killed is
    seen by nobody and made anew by the next."""
    newest = read_batches(spark, log_path).agg(F.max("batch_id")).first()[0]
    before = read_batches(spark, path).agg(F.max("batch_id")).first()[0]
    if newest is None or newest == before:
        return None
    log = read_log(spark, log_path, layout=True).filter(F.col("batch_id") <= newest)
    if before is not None:
        log = log.filter(F.col("batch_id") > before)
    fresh = cut_lineage(log.select(*_KEY, F.nullif("causation_id", F.lit("")).alias("causation_id")))
    ids = fresh.select(*_KEY)

    # Roots of old that this update brings the cause of.
    links = cut_lineage(_links(spark, path, limit))
    waiting = _scan(spark, path, "_open", OPEN_SCHEMA).select(*_KEY, "causation_id")
    waiting = waiting.join(links.select("tenant_id", F.col("root_id").alias("id")), _KEY, "left_anti")
    causes = ids.withColumnRenamed("id", "causation_id")
    freed = cut_lineage(waiting.join(small_side(causes), ["tenant_id", "causation_id"], "left_semi").select(*_KEY, "causation_id"))

    # What is known of the causes: events of this update, or labels of old.
    wanted = fresh.filter(F.col("causation_id").isNotNull()).select("tenant_id", F.col("causation_id").alias("id")).distinct()
    buckets = [r.b for r in wanted.select(id_bucket(F.col("id")).alias("b")).distinct().collect()]  # 256 at most
    old = _scan(spark, path, "", LABEL_SCHEMA).filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    old = old.join(small_side(wanted), _KEY, "left_semi").select(*_KEY, "root_id", "depth")
    old = _follow(old, links, limit)
    again = freed.select("tenant_id", F.col("id").alias("root_id"), F.lit(True).alias("_open"))
    known = old.join(small_side(again), ["tenant_id", "root_id"], "left").select(
        "tenant_id", F.col("id").alias("causation_id"), F.col("root_id").alias("above"), F.col("depth").alias("more"),
        F.col("_open").isNull().alias("end"), F.lit(False).alias("new"),
    )
    new = ids.select(
        "tenant_id", F.col("id").alias("causation_id"), F.col("id").alias("above"), F.lit(0).cast("bigint").alias("more"),
        F.lit(False).alias("end"), F.lit(True).alias("new"),
    )
    caused = fresh.filter(F.col("causation_id").isNotNull()).unionByName(freed)
    caused = lookup(caused, known.unionByName(new), ["tenant_id", "causation_id"], "_c", limit=limit)
    roots = fresh.filter(F.col("causation_id").isNull()).withColumn("_c", F.lit(None).cast(caused.schema["_c"].dataType))
    found = F.col("_c").isNotNull()
    state = caused.unionByName(roots).select(
        *_KEY,
        F.when(found, F.col("_c.above")).otherwise(F.col("id")).alias("up"),
        F.when(found, F.col("_c.more") + 1).otherwise(0).cast("bigint").alias("depth"),
        F.when(found, F.col("_c.end")).otherwise(True).alias("done"),
    )
    ended = climb(state, limit)
    result = ended.select(
        *_KEY,
        F.when(F.col("done"), F.col("up")).alias("root_id"),
        F.when(F.col("done") & F.col("up").isNotNull(), F.col("depth")).alias("depth"),
    )
    result = cut_lineage(result)
    labels = fresh.join(result, _KEY).withColumn("bucket", id_bucket(F.col("id")))
    labels.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id").write.mode("overwrite").parquet(
        f"{path}/batch_id={newest}"
    )
    unknown = labels.filter((F.col("root_id") == F.col("id")) & F.col("causation_id").isNotNull())
    unknown.select(*_KEY, "causation_id").write.mode("overwrite").parquet(f"{path}_open/batch_id={newest}")
    joined = result.join(small_side(freed.select(*_KEY)), _KEY, "left_semi").select(
        "tenant_id", F.col("id").alias("root_id"), F.col("root_id").alias("new_root"), F.col("depth").alias("more")
    )
    joined.write.mode("overwrite").parquet(f"{path}_links/batch_id={newest}")
    record(spark, path, _WRITER, newest, newest, 0, 0)
    return newest
