"""Streams drained with availableNow from files; each run twice on one checkpoint."""

import json

import pytest
from pyspark.sql import functions as F

from annalog.operators.append import assign_versions
from annalog.operators.audit import gap_check
from annalog.schema import MESSAGE_SCHEMA
from annalog.sources.log import append_batch, read_log
from annalog.sources.messages import read_messages, to_messages
from annalog.sources.projection import merge_projection, read_projection
from annalog.streaming.jobs import ProjectionPaths, run_ingest, run_log_projection, run_projection, run_publish
from conftest import event, uid


def deliver(df, path, first_offset=0):
    rows = to_messages(df, {}, "events.v1").withColumns(
        {"partition": F.lit(0), "offset": F.lit(first_offset) + F.col("timestamp").cast("long") - F.lit(1704067200)}
    )
    rows.select(*[F.col(f.name).cast(f.dataType) for f in MESSAGE_SCHEMA]).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def paths(tmp_path):
    return ProjectionPaths(*(str(tmp_path / n) for n in ("projection", "dlq", "quarantine")))


def test_projection_dlq_and_quarantine(spark, log_of, tmp_path, paths):
    bus, checkpoint = str(tmp_path / "bus"), str(tmp_path / "cp")
    deliver(log_of([event(i, version=i, payload="42" if i == 3 else "{}") for i in range(1, 6)]), bus)
    deliver(log_of([event(2, version=2, event_version=9)]), bus, first_offset=100)
    bad = log_of([event(8)])
    cut = to_messages(bad, {}, "events.v1").withColumns(
        {"value": F.expr("substring(value, 1, 25)"), "partition": F.lit(0), "offset": F.lit(77)}
    )
    cut.select(*[F.col(f.name).cast(f.dataType) for f in MESSAGE_SCHEMA]).write.mode("append").parquet(bus)

    def drain():
        source = read_messages(spark, "parquet", {"path": bus, "maxFilesPerTrigger": "1"})
        query = run_projection(source, paths, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None

    drain()
    drain()
    index = {r.id: r for r in read_projection(spark, paths.projection).collect()}
    assert set(index) == {uid(i) for i in (1, 2, 4, 5)} and index[uid(2)].event_version == 9
    dead = spark.read.parquet(paths.dlq).collect()
    assert [d.event.version for d in dead] == [3] and dead[0].reason == "payload is not an object"
    assert dead[0].correlation_id == "corr-3" and dead[0].failed_at is not None
    lost = spark.read.parquet(paths.quarantine).collect()
    assert [(r.offset, r.key, r.correlation_id) for r in lost] == [(77, "parcel:1", "corr-8")]

    deliver(log_of([event(5, version=5, event_version=7), event(6, version=6)]), bus, first_offset=200)
    drain()
    index = {r.id: r.event_version for r in read_projection(spark, paths.projection).collect()}
    assert len(index) == 5 and index[uid(5)] == 7
    merge_projection(spark, paths.projection)
    assert {r.id: r.event_version for r in read_projection(spark, paths.projection).collect()} == index


def test_failing_rule_retries_the_whole_batch(spark, log_of, tmp_path, paths):
    bus, checkpoint = str(tmp_path / "bus"), str(tmp_path / "cp")
    deliver(log_of([event(i, version=i) for i in range(1, 4)]), bus)

    def broken_rule():
        return F.raise_error(F.lit("index is down")).cast("string")

    query = run_projection(read_messages(spark, "parquet", {"path": bus}), paths, checkpoint, broken_rule)
    with pytest.raises(Exception):
        query.awaitTermination(60)
    query = run_projection(read_messages(spark, "parquet", {"path": bus}), paths, checkpoint)
    query.awaitTermination(60)
    assert read_projection(spark, paths.projection).count() == 3


def test_ingest_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    log_path, rejected, checkpoint = (str(tmp_path / n) for n in ("log", "rejected", "cp"))

    def body(n, **extra):
        return json.dumps({"stream_id": f"parcel:{n % 3}", "type": "t", "source": "s", "payload": {"n": n}} | extra)

    (source / "a.jsonl").write_text("\n".join([body(i) for i in range(10)] + [body(0), "{broken", body(1, type="")]) + "\n")

    def drain():
        query = run_ingest(spark, str(source), log_path, rejected, "tenant-a", checkpoint, max_files=1)
        query.awaitTermination(120)
        assert query.exception() is None

    drain()
    drain()
    log = read_log(spark, log_path)
    assert log.count() == 11 and log.select("id").distinct().count() == 11
    assert {r.tenant_id for r in log.select("tenant_id").distinct().collect()} == {"tenant-a"}
    assert sorted(r.reject_reason for r in spark.read.parquet(rejected).collect()) == [
        "body_invalid", "fields_missing"
    ]
    (source / "b.jsonl").write_text("\n".join(body(i) for i in range(10)) + "\n")
    drain()
    log = read_log(spark, log_path)
    assert log.count() == 21
    assert gap_check(log).filter("not contiguous or first_version <> 1").isEmpty()


def test_fan_out_from_the_log(spark, log_of, tmp_path, paths):
    log_path, bus = str(tmp_path / "log"), str(tmp_path / "bus")
    append_batch(log_of([event(i, payload="7" if i == 4 else "{}") for i in range(8)]), log_path, 0, writer="loader")
    for _ in range(2):
        run_publish(spark, log_path, bus, str(tmp_path / "cp1"), {"parcel": "events.parcel.v1"}, "events.v1").awaitTermination(60)
        run_log_projection(spark, log_path, paths, str(tmp_path / "cp2")).awaitTermination(60)
    assert spark.read.parquet(bus).count() == 8
    assert read_projection(spark, paths.projection).count() == 7
    assert [r.event.id for r in spark.read.parquet(paths.dlq).collect()] == [uid(4)]
    append_batch(log_of([event(20)]), log_path, 1, writer="loader")
    run_log_projection(spark, log_path, paths, str(tmp_path / "cp2")).awaitTermination(60)
    assert read_projection(spark, paths.projection).count() == 8


def test_assigned_versions_reach_the_bus(log_of):
    rows = to_messages(assign_versions(log_of([event(1), event(2)])), {}, "events.v1").collect()
    assert sorted(json.loads(bytes(r.value))["version"] for r in rows) == [1, 2]
