"""Bulk import of ingest requests: one JSON body per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalog.functions.envelope import fix_columns, raw_member, variant_is, variant_text
from annalog.operators.skew import small_side
from annalog.schema import BODY_INVALID, BODY_TOO_LONG, REQUEST_MAX_BYTES, REQUEST_PREVIEW_CHARS, REQUEST_SCHEMA
from annalog.session import cut_lineage

_TEXTS = ["stream_id", "type", "source", "causation_id", "actor_id", "trace_id", "source_version"]
_DOC_SCHEMA = ", ".join(
    [f"{c} variant" for c in [*_TEXTS, "event_version"]]
    + ["metadata map<string,variant>", "payload string", "_broken string"]
)


def request_lines(rows: DataFrame) -> DataFrame:
    """(value, file, start) of a text scan, `start` the first byte of the line's split."""
    return rows.selectExpr("value", "_metadata.file_path AS file", "_metadata.file_block_start AS start")


def read_request_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files below `path`."""
    return request_lines(spark.read.text(path))


def position_lines(lines: DataFrame) -> DataFrame:
    """(value, file, line_no, position): the line's number in its file, and over all files
    in path order, both from 1 and the same however the files were split.

    `lines` comes from a text scan, where a task reads each of its splits in order. The
    lines are stored once with their row in the task; a table with one row per split then
    says how many lines lie before it. That table, not the lines, passes one task.
    """
    stored = cut_lineage(lines.withColumn("_at", F.monotonically_increasing_id()))
    splits = stored.groupBy("file", "start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = cut_lineage(
        splits.select(
            "file",
            "start",
            "_first",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_all"),
            F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_own"),
        )
    )
    row = F.col("_at") - F.col("_first") + 1
    return stored.join(small_side(known), ["file", "start"]).select(
        "value", "file", (row + F.col("_own")).alias("line_no"), (row + F.col("_all")).alias("position")
    )


def decode_requests(
    df: DataFrame, value: str = "value", max_bytes: int = REQUEST_MAX_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(decoded requests, rejected bodies with reason and preview).

    A body longer than `max_bytes` would arrive cut and fail to decode; it is
    refused by its length. Other columns of `df` stay on both sides.
    """
    others = [c for c in df.columns if c not in REQUEST_SCHEMA.fieldNames() and c != value]
    text = F.col(value)
    doc = F.from_json(text, _DOC_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    parsed = fix_columns(df, _doc=doc)

    def member(name: str):
        return F.col("_doc")[name]

    wrong = F.lit(False)
    for c in _TEXTS:
        wrong = wrong | ~variant_is(member(c), "STRING")
    wrong = wrong | ~variant_is(member("event_version"), "BIGINT")
    wrong = wrong | F.coalesce(
        F.exists(F.map_values(member("metadata")), lambda v: ~variant_is(v, "STRING")), F.lit(False)
    )
    reason = (
        F.when(F.octet_length(text) > max_bytes, F.lit(BODY_TOO_LONG))
        .when(F.col("_doc").isNull() | member("_broken").isNotNull(), F.lit(BODY_INVALID))
        .when(wrong, F.lit(BODY_INVALID))
    )
    judged = fix_columns(parsed, reject_reason=reason)
    values = {c: F.coalesce(variant_text(member(c)), F.lit("")) for c in _TEXTS}
    values["event_version"] = F.coalesce(F.try_variant_get(member("event_version"), "$", "int"), F.lit(0))
    values["metadata"] = F.transform_values(
        member("metadata"), lambda _, v: F.coalesce(variant_text(v), F.lit(""))
    )
    values["payload"] = F.when(
        member("payload").isNotNull(), raw_member(text, "payload", REQUEST_SCHEMA.fieldNames(), member("payload"))
    )
    ok = judged.filter(F.col("reject_reason").isNull()).select(
        *others,
        *[values[f.name].cast(f.dataType).alias(f.name) for f in REQUEST_SCHEMA],
    )
    preview = F.when(
        F.char_length(text) <= REQUEST_PREVIEW_CHARS, text
    ).otherwise(F.concat(F.left(text, F.lit(REQUEST_PREVIEW_CHARS)), F.lit("…")))
    rejected = judged.filter(F.col("reject_reason").isNotNull()).select(
        *others, "reject_reason", preview.alias("preview")
    )
    return ok, rejected
