import random

import pytest
from pyspark.sql import functions as F

from annalog.functions.routing import route_by_table, topic_column
from annalog.operators import audit
from annalog.operators.causation import causation_forest, causation_roots, causation_tree, incident
from annalog.schema import COLS
from annalog.sources.messages import message_context, order_for_export
from conftest import at, event, uid


@pytest.mark.parametrize("limit", [1, 1_000_000])
def test_orphans(log_of, limit):
    log = log_of(
        [event(1), event(2, causation_id=uid(1)), event(3, causation_id="lost"), event(4, causation_id="lost"),
         event(5, causation_id=uid(1), tenant_id="tenant-b"),
         event(6, is_replay=True, replay_source_event_id=uid(1)), event(7, is_replay=True, replay_source_event_id=uid(99))]
    )
    assert sorted(r.id for r in audit.causation_orphans(log, limit).collect()) == [uid(3), uid(4), uid(5)]
    assert [r.id for r in audit.lineage_orphans(log, limit).collect()] == [uid(7)]


def parents_to_truth(parent):
    truth = {}
    for node in parent:
        seen, at_node, depth = {node}, node, 0
        while parent.get(at_node) in parent:
            at_node = parent[at_node]
            depth += 1
            if at_node in seen:
                at_node, depth = None, None
                break
            seen.add(at_node)
        truth[node] = (at_node, depth)
    return truth


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_roots_of_chains_stars_and_cycles(log_of, limit):
    rnd = random.Random(3)
    parent = {i: i - 1 for i in range(1, 21)} | {0: None}  # a chain
    parent |= {i: 5 for i in range(30, 45)}  # a star on a chain element
    parent |= {50: 51, 51: 52, 52: 50, 53: 51}  # a cycle and a tail into it
    parent |= {60: 60}  # causes itself
    parent |= {i: rnd.randrange(70, i) for i in range(71, 100)} | {70: 999}  # a tree below an unknown cause
    log = log_of([event(i, causation_id="" if p is None else uid(p)) for i, p in parent.items()])
    got = {r.id: (r.root_id, r.depth) for r in causation_roots(log, limit).collect()}
    expected = {uid(n): (None if r is None else uid(r), d) for n, (r, d) in parents_to_truth(parent).items()}
    assert got == expected


def test_tree_from_roots_ends_in_cycles(log_of):
    links = {1: None, 2: 1, 3: 1, 4: 3, 5: 4, 10: 12, 11: 10, 12: 11}
    log = log_of([event(i, causation_id="" if p is None else uid(p)) for i, p in links.items()])
    roots = log.filter(F.col("id").isin(uid(1), uid(10))).select("tenant_id", "id")
    got = {(r.root_id, r.id): r.depth for r in causation_tree(log, roots).collect()}
    assert got == {
        (uid(1), uid(1)): 0, (uid(1), uid(2)): 1, (uid(1), uid(3)): 1, (uid(1), uid(4)): 2, (uid(1), uid(5)): 3,
        (uid(10), uid(10)): 0, (uid(10), uid(11)): 1, (uid(10), uid(12)): 2,
    }
    assert causation_tree(log, roots, max_depth=1).count() == 5
    assert causation_forest(log, log.select("tenant_id", "id")).count() == 8


def test_incident(log_of):
    log = log_of(
        [event(1, correlation_id="c"), event(2, causation_id=uid(1)), event(3, causation_id=uid(2)),
         event(50), event(51, correlation_id="c"), event(90), event(4, causation_id=uid(1), tenant_id="tenant-b")]
    )
    got = {r.id: r.via for r in incident(log, "tenant-a", "c", at(50), at(51)).collect()}
    assert got == {uid(1): "correlation", uid(51): "correlation", uid(50): "window", uid(2): "causation", uid(3): "causation"}


def test_index_missing(log_of):
    log = log_of([event(i) for i in range(10)])
    index = log_of([event(i) for i in range(0, 10, 2)])
    assert [r.id for r in audit.index_missing(log, index, "tenant-a", at(2), limit=2).collect()] == [uid(9), uid(7)]
    assert audit.index_missing(log, index, "tenant-a", limit=None).count() == 5


def test_upcast(spark, log_of):
    old = log_of([event(1, version=3)]).select("id", "stream_id", "type", "source", "version", "occurred_at", "payload")
    row = audit.upcast(old).first()
    assert list(row.asDict()) == COLS
    assert (row.tenant_id, row.event_version, row.is_replay, row.replayed_at, row.metadata) == ("default", 1, False, None, {})
    both = audit.upcast(old.unionByName(log_of([event(2)]), allowMissingColumns=True))
    assert both.filter("tenant_id = 'default'").count() == 1 and both.filter("correlation_id = ''").count() == 1


def test_profiles(log_of):
    log = log_of([event(1, correlation_id="c"), event(2, correlation_id="c", stream_id="x"), event(3, correlation_id="c", tenant_id="tenant-b")])
    got = {r.tenant_id: (r.events, r.streams) for r in audit.correlation_profile(log).collect()}
    assert got == {"tenant-a": (2, 2), "tenant-b": (1, 1)}
    assert audit.correlation_tenants(log).first().tenants == 2


@pytest.mark.parametrize("limit", [1, 1_000_000])
def test_logs_in_both_spellings(spark, log_of, tmp_path, limit):
    (tmp_path / "svc.jsonl").write_text(
        '{"trace_id":"t1","service":"a","msg":"m1"}\n{"traceId":"t1","service":"b","msg":"m2"}\n'
        '{"traceId":"t1","service":"b","msg":"m2"}\n{"trace_id":"zz","msg":"m3"}\n{"msg":"none"}\n'
    )
    logs = audit.read_service_logs(spark, str(tmp_path))
    log = log_of([event(1, trace_id="t1"), event(2, trace_id="t1")])
    got = audit.correlate_logs(log, logs, limit).collect()
    assert sorted(r.msg for r in got) == ["m1", "m2", "m2"] and {r.events for r in got} == {2}


def test_topic_routing(spark):
    routes = {"parcel": "events.parcel.v1", "user": "events.user.v1"}
    expected = {"parcel:1": "events.parcel.v1", "user:4:2": "events.user.v1", "payment:9": "f", "parcel": "f", ":order": "f", "": "f"}
    df = spark.createDataFrame([(s,) for s in expected], "stream_id string")
    got = {r.stream_id: r.t for r in df.select("stream_id", topic_column(F.col("stream_id"), routes, "f").alias("t")).collect()}
    assert got == expected
    assert df.select(topic_column(F.col("stream_id"), {}, "f").alias("t")).distinct().count() == 1
    table = spark.createDataFrame(
        [("parcel", "old", 0), ("parcel", "events.parcel.v1", 1), ("user", "events.user.v1", 2)], "prefix string, topic string, position int"
    )
    assert {r.stream_id: r.topic for r in route_by_table(df, table, "f").collect()} == expected


def test_repeated_headers_last_one_counts(spark):
    tp = "00-{}-00f067aa0ba902b7-01"
    headers = [("traceparent", tp.format("a" * 32).encode()), ("traceparent", tp.format("b" * 32).encode()),
               ("traceparent", b"bad"), ("correlation_id", b"one"), ("correlation_id", b"")]
    df = spark.createDataFrame([(headers,), ([],)], "headers array<struct<key:string,value:binary>>")
    got = [r.c for r in df.select(message_context(F.col("headers")).alias("c")).collect()]
    assert (got[0].trace_id, got[0].correlation_id) == ("b" * 32, "one")
    assert got[1].trace_id is None and got[1].correlation_id is None


def test_export_order(log_of):
    rows = [event(i, stream_id=f"s{i % 3}", version=i // 3 + 1) for i in range(30)]
    seen = {}
    for r in order_for_export(log_of(rows)).collect():
        assert r.version > seen.get(r.stream_id, 0)
        seen[r.stream_id] = r.version
