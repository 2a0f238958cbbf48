"""Range reads for a table of requests, over runs of versions.

A run is a stretch of a stream's versions that follow each other by one; a version that is
stored again starts a run anew. The runs of a whole log are a small table: one row for a
stream without gaps, whatever its length. A request for a range of versions is contiguous
if one run covers what it finds, and else the first two runs name the gap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalog.operators.numbering import version_digit
from annalog.schema import STREAM_MISSING, TENANT_MISSING, VERSION_GAP, VERSION_NEGATIVE

STREAM = ("tenant_id", "stream_id")
WIDTH = 100_000  # versions that are looked at together


def version_runs(events: DataFrame, keys: Sequence[str] = STREAM, width: int = WIDTH) -> DataFrame:
    """(keys, first, last): the runs of each key.

    Versions are cut into ranges of `width`, so that no task sorts a long stream; runs that
    end at a border are joined to the next one by a window over those runs alone."""
    keys = list(keys)
    versions = events.groupBy(*keys, "version").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"))
    versions = versions.withColumn("cell", version_digit(F.col("version"), width))
    places = versions.select(*keys, "cell", "version", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    inside = Window.partitionBy(*keys, "cell").orderBy("version", "copy")
    begins = F.lag("version").over(inside)
    begins = (begins.isNull() | (F.col("version") != begins + 1)).cast("int")
    numbered = places.withColumn("begins", begins).withColumn("run", F.sum("begins").over(inside))
    local = numbered.groupBy(*keys, "cell", "run").agg(F.min("version").alias("first"), F.max("version").alias("last"))

    at_low, at_high = F.col("first") == F.col("cell") * width, F.col("last") == (F.col("cell") + 1) * width - 1
    edge = local.where(at_low | at_high)
    # Runs that begin alike lie in one range, where `run` tells their order.
    across = Window.partitionBy(*keys).orderBy("first", "run")
    before = F.lag("last").over(across)
    edge = edge.withColumn("begins", (before.isNull() | ~at_low | (before != F.col("first") - 1)).cast("int"))
    edge = edge.withColumn("chain", F.sum("begins").over(across))
    chains = edge.groupBy(*keys, "chain").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return local.where(~(at_low | at_high)).select(*keys, "first", "last").union(chains.select(*keys, "first", "last"))


def _first_gap(found: DataFrame) -> DataFrame:
    """(request_id, previous_version, missing_version, found_version) of the requests that
    find more than one run."""
    order = Window.partitionBy("request_id").orderBy("first", "last")
    two = found.withColumn("place", F.row_number().over(order)).where("place <= 2")
    pairs = two.groupBy("request_id").agg(
        F.max(F.when(F.col("place") == 1, F.col("last"))).alias("previous_version"),
        F.max(F.when(F.col("place") == 2, F.col("first"))).alias("found_version"),
    )
    return pairs.where("found_version IS NOT NULL").select(
        "request_id", "previous_version", (F.col("previous_version") + 1).alias("missing_version"), "found_version"
    )


def reject_code() -> Column:
    """Why a request is not read at all, null if it is."""
    return (
        F.when(F.coalesce("tenant_id", F.lit("")) == "", TENANT_MISSING)
        .when(F.coalesce("stream_id", F.lit("")) == "", STREAM_MISSING)
        .when((F.coalesce("from_version", F.lit(0)) < 0) | (F.coalesce("to_version", F.lit(0)) < 0), VERSION_NEGATIVE)
    )


def _rows_of(events: DataFrame, requests: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """The rows each request finds, with its request_id. A request is dealt to the ranges of
    versions it touches, and meets the rows of those alone."""
    bounds = runs.groupBy(*STREAM).agg(F.min("first").alias("low"), F.max("last").alias("high"))
    dealt = requests.join(bounds, list(STREAM))
    low = F.greatest("from_version", "low")
    high = F.when(F.col("to_version") > 0, F.least("to_version", "high")).otherwise(F.col("high"))
    dealt = dealt.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    cells = F.explode(F.sequence(version_digit(F.col("_low"), width), version_digit(F.col("_high"), width))).alias("_cell")
    dealt = dealt.select("request_id", *STREAM, "_low", "_high", "from_time", "to_time", cells)
    rows = events.withColumn("_cell", version_digit(F.col("version"), width)).join(dealt, [*STREAM, "_cell"])
    timely = F.coalesce(F.col("occurred_at") >= F.col("from_time"), F.lit(True))
    timely &= F.coalesce(F.col("occurred_at") <= F.col("to_time"), F.lit(True))
    return rows.where((F.col("version").between(F.col("_low"), F.col("_high"))) & timely).select("request_id", *events.columns)


def read_ranges(
    events: DataFrame, requests: DataFrame, runs: DataFrame | None = None, width: int = WIDTH
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, rows) of `requests` (request_id unique, tenant_id, stream_id, from_version,
    to_version, from_time, to_time); null or zero bounds are open, both ends count.

    Verdicts: request_id, reject_reason (null if read), previous_version, missing_version,
    found_version (of the first gap). Rows: those of accepted requests, each with its
    request_id. Requests without times are judged by `runs` alone (those of `events` unless
    a stored table is given); with times, by the runs of the rows they find."""
    runs = version_runs(events, width=width) if runs is None else runs
    opened = requests.select(
        "request_id", "tenant_id", "stream_id", F.coalesce("from_version", F.lit(0)).alias("from_version"),
        F.coalesce("to_version", F.lit(0)).alias("to_version"), "from_time", "to_time", reject_code().alias("reject_reason"),
    )
    valid = opened.where("reject_reason IS NULL")
    timed = F.col("from_time").isNotNull() | F.col("to_time").isNotNull()
    ranged = valid.where(~timed).join(runs, list(STREAM)).where("last >= from_version AND (to_version = 0 OR first <= to_version)")
    clipped = ranged.select(
        "request_id",
        F.greatest("first", "from_version").alias("first"),
        F.when(F.col("to_version") > 0, F.least("last", "to_version")).otherwise(F.col("last")).alias("last"),
    )
    found = version_runs(_rows_of(events, valid.where(timed), runs, width).select("request_id", "version"), ["request_id"], width)
    gaps = _first_gap(clipped.unionByName(found))
    verdicts = opened.join(gaps, "request_id", "left").select(
        "request_id",
        F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason")).when(F.col("found_version").isNotNull(), VERSION_GAP).alias("reject_reason"),
        "previous_version",
        "missing_version",
        "found_version",
    )
    accepted = valid.join(gaps.select("request_id"), "request_id", "left_anti")
    return verdicts, _rows_of(events, accepted, runs, width)
