"""Ordered publishing in parts, keyed dead letters and their recovery."""

import json

from pyspark.sql import functions as F

from annalog.plans.jobs import recover_dead_letters
from annalog.sources.dlq import to_dlq
from annalog.sources.log import append_batch, read_log
from annalog.sources.messages import bus_parts, send_in_order
from annalog.streaming.jobs import ProjectionPaths, run_projection, run_publish
from annalog.sources.messages import read_messages
from conftest import event, uid
from test_streaming import deliver


def test_parts_are_bounded_and_sent_one_after_the_other(spark, log_of, tmp_path):
    rows = [event(i, stream_id="hot", version=i + 4) for i in range(11)]
    rows += [event(100 + i, stream_id=f"s:{i}", version=1) for i in range(5)]
    parts = {r.id: r.part for r in bus_parts(log_of(rows[::-1]), limit=3).collect()}
    assert [parts[uid(i)] for i in range(11)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
    assert {parts[uid(100 + i)] for i in range(5)} == {0}
    sent = []

    def send(df, part):
        task = df.withColumn("task", F.spark_partition_id()).collect()
        assert len({r.task for r in task if r.stream_id == "hot"}) == 1 and "part" not in df.columns
        sent.append((part, [r.version for r in task if r.stream_id == "hot"]))

    send_in_order(log_of(rows[::-1]), send, limit=3)
    assert sent == [(0, [4, 5, 6]), (1, [7, 8, 9]), (2, [10, 11, 12]), (3, [13, 14])]
    send_in_order(log_of([]), send, limit=3)
    assert len(sent) == 4


def test_publish_stream_to_another_format(spark, log_of, tmp_path):
    log_path, bus = str(tmp_path / "log"), str(tmp_path / "bus")
    append_batch(log_of([event(i) for i in range(7)]), log_path, 0, writer="loader")
    for _ in range(2):
        run_publish(
            spark, log_path, bus, str(tmp_path / "cp"), {}, "events.v1", fmt="orc", options={"compression": "zlib"}, limit=3
        ).awaitTermination(120)
    rows = spark.read.orc(bus)
    assert sorted((r.part, json.loads(bytes(r.value))["version"]) for r in rows.collect()) == [
        (0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (1, 6), (2, 7)
    ]


def test_keyed_dead_letters_and_their_recovery(spark, log_of, tmp_path):
    log_path, bus = str(tmp_path / "log"), str(tmp_path / "bus")
    events = [event(i, payload="42" if i in (2, 5) else "{}") for i in range(6)]
    append_batch(log_of(events), log_path, 0, writer="loader")
    deliver(log_of([event(i, version=i + 1, payload=e["payload"]) for i, e in enumerate(events)]), bus)
    paths = ProjectionPaths(*(str(tmp_path / n) for n in ("index", "dlq", "quarantine", "dead-bus")))
    run_projection(read_messages(spark, "parquet", {"path": bus}), paths, str(tmp_path / "cp")).awaitTermination(120)
    keyed = spark.read.parquet(paths.dlq_bus).collect()
    assert sorted(bytes(r.key).decode() for r in keyed) == [uid(2), uid(5)]
    assert all(json.loads(bytes(r.value))["reason"] == "payload is not an object" for r in keyed)

    dlq = spark.read.parquet(paths.dlq)
    # Dead-lettered twice, never stored, and another tenant's.
    extra = log_of([event(2), event(99), event(5, tenant_id="tenant-b")])
    dlq = dlq.select("event").unionByName(to_dlq(extra, F.lit("again"), F.current_timestamp()).select("event"))
    for batch_id in (1, 2):
        summary = recover_dead_letters(spark, log_path, dlq, "tenant-a", "index mended", batch_id, "recovery-1").first()
        assert (summary.matched_count, summary.replayed_count) == (2, 2)
    new = read_log(spark, log_path).filter("is_replay").orderBy("version").collect()
    assert [(r.replay_source_event_id, r.version, r.replay_reason) for r in new] == [
        (uid(2), 7, "index mended"), (uid(5), 8, "index mended")
    ]
    none = recover_dead_letters(spark, log_path, dlq.limit(0), "tenant-a", "nothing", 3, "recovery-2").first()
    assert none.matched_count == 0
