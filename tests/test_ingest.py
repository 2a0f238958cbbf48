import datetime as dt

import pytest
from pyspark.sql import functions as F

from annalog.functions.trace import format_traceparent, parse_traceparent, resolve_trace
from annalog.operators.ingest import normalise, resolve_headers, stamp_tenant, stamp_tenants, validate
from annalog.schema import COLS
from annalog.plans.jobs import import_requests
from annalog.sources.log import read_log
from annalog.sources.requests import decode_requests, position_lines, read_request_lines

NOW = dt.datetime(2024, 5, 1, 12, 0, 0)
SAMPLE = "00-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7-01"


def commands(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, stream_id string, type string, source string")


def test_required_fields_reject_the_row(spark):
    df = commands(
        spark,
        [("t", "s", "ty", "so"), ("t", "", "ty", "so"), ("t", "s", None, "so"), ("t", "s", "ty", ""), ("", "s", "ty", "so")],
    )
    valid, rejected = validate(df)
    assert valid.count() == 1
    reasons = [r.reject_reason for r in rejected.collect()]
    assert reasons.count("fields_missing") == 3
    assert reasons.count("tenant_missing") == 1


def test_defaults(spark):
    df = commands(spark, [("t", "s", "ty", "so")])
    row = normalise(df, NOW).collect()[0]
    assert (row.payload, row.metadata, row.event_version, row.version) == ("null", {}, 1, 0)
    assert row.occurred_at == NOW and len(row.id) == 36 and len(row.correlation_id) == 36
    assert row.replayed_at is None and row.is_replay is False and row.actor_id == ""
    assert list(row.asDict())[: len(COLS)] == COLS


def test_ids_from_source_position_repeat(spark):
    df = commands(spark, [("t", "s", "ty", "so"), ("t", "s2", "ty", "so")])
    first = normalise(df, NOW, id_from=[F.col("stream_id")]).select("id").collect()
    second = normalise(df, NOW, id_from=[F.col("stream_id")]).select("id").collect()
    assert first == second and len({r.id for r in first}) == 2


def test_tenant_comes_from_the_caller(spark):
    df = commands(spark, [("from-body", "s", "ty", "so")])
    assert stamp_tenant(df, "tenant-a").first().tenant_id == "tenant-a"
    keyed = df.withColumn("credential", F.lit("key"))
    known = spark.createDataFrame([("key", "tenant-b")], "credential string, tenant_id string")
    assert stamp_tenants(keyed, known).first().tenant_id == "tenant-b"
    unknown = known.filter("false")
    assert validate(stamp_tenants(keyed, unknown))[0].count() == 0


def test_header_priority(spark):
    rows = [
        ({"x-correlation-id": "h", "x-request-id": "r", "x-causation-id": "c", "traceparent": SAMPLE}, "body", "t" * 32),
        ({"x-correlation-id": "", "x-request-id": "r", "x-trace-id": "a" * 32}, "body", "t" * 32),
        ({"traceparent": "bad", "x-trace-id": "short"}, "body", "t" * 32),
        ({}, "", ""),
    ]
    df = spark.createDataFrame(rows, "headers map<string,string>, causation_id string, trace_id string")
    got = resolve_headers(df).collect()
    assert [(r.correlation_id, r.causation_id) for r in got[:2]] == [("h", "c"), ("r", "body")]
    assert got[0].trace_id == "4bf92f3577b34da6a3ce929d0e0e4736"
    assert got[1].trace_id == "a" * 32 and got[2].trace_id == "t" * 32
    assert len(got[3].correlation_id) == 36 and len(got[3].trace_id) == 32 and got[3].causation_id == ""


def test_traceparent_forms(spark):
    cases = {
        SAMPLE: ("4bf92f3577b34da6a3ce929d0e0e4736", "00f067aa0ba902b7", True),
        SAMPLE.upper(): ("4BF92F3577B34DA6A3CE929D0E0E4736", "00F067AA0BA902B7", True),
        SAMPLE[:-2] + "00": ("4bf92f3577b34da6a3ce929d0e0e4736", "00f067aa0ba902b7", False),
        SAMPLE[:-2] + "zz": ("4bf92f3577b34da6a3ce929d0e0e4736", "00f067aa0ba902b7", False),
        "01" + SAMPLE[2:]: None,
        SAMPLE + "-x": None,
        SAMPLE.replace("4b", "xy"): None,
        SAMPLE[:-1]: None,
        "": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    got = {r.h: r.t and tuple(r.t) for r in df.select("h", parse_traceparent(F.col("h")).alias("t")).collect()}
    assert got == cases


def test_traceparent_format_and_resolution(spark):
    df = spark.createDataFrame([("t" * 32, "s" * 16)], "t string, s string")
    row = df.select(
        format_traceparent(F.col("t"), F.col("s"), F.lit(True)).alias("on"),
        format_traceparent(F.col("t"), F.col("s"), F.lit(False)).alias("off"),
        resolve_trace(F.lit(SAMPLE), F.col("t")).alias("a"),
        resolve_trace(F.lit(None).cast("string"), F.col("t")).alias("b"),
        resolve_trace(F.lit("x"), F.lit("short")).alias("c"),
    ).first()
    assert row.on == f"00-{'t' * 32}-{'s' * 16}-01" and row.off.endswith("-00")
    assert row.a.startswith("4bf9") and row.b == "t" * 32 and len(row.c) == 32


def test_request_bodies(spark):
    bodies = [
        '{"stream_id":"s","type":"t","source":"so","payload": {"x": 1.10, "type":"in", "x": 2}}',
        '{"payload":"text","stream_id":"s"}',
        '{"stream_id":"s","payload":"42","metadata":{"a":"b"}}',
        '{"stream_id":"s","payload":42}',
        '{"stream_id":"s","unknown":[1]}',
        '{"stream_id":5}',
        '{"stream_id":"s","metadata":{"a":1}}',
        '{"stream_id":"s"',
        '{"stream_id":"' + "x" * 5000 + '"}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, value string")
    ok, bad = decode_requests(df)
    rows = {r.n: r for r in ok.collect()}
    assert rows[0].payload == '{"x": 1.10, "type":"in", "x": 2}'
    assert rows[1].payload == '"text"' and rows[2].payload == '"42"' and rows[3].payload == "42"
    assert rows[4].payload is None and rows[2].metadata == {"a": "b"}
    reasons = {r.n: r.reject_reason for r in bad.collect()}
    assert reasons == {5: "body_invalid", 6: "body_invalid", 7: "body_invalid", 8: "body_too_long"}
    assert all(len(r.preview) <= 513 for r in bad.collect())


def write_lines(folder, sizes):
    folder.mkdir()
    every = []
    for name, size in sizes.items():
        lines = [f"{name} same" if i % 3 == 0 else f"{name} {i} " + "x" * (i % 40) for i in range(size)]
        (folder / name).write_text("".join(line + "\n" for line in lines))
        every += [(name, i + 1, line) for i, line in enumerate(lines)]
    return every


@pytest.mark.parametrize("split", [150, 4000, 10**8])
def test_lines_keep_their_place_however_files_are_split(spark, tmp_path, split):
    expected = write_lines(tmp_path / "in", {"a": 90, "b": 0, "c": 1, "d": 200})
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, str(split))
        lines = read_request_lines(spark, str(tmp_path / "in"))
        assert split > 150 or lines.select("start").distinct().count() > 20
        rows = position_lines(lines).orderBy("position").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(r.file.rsplit("/")[-1], r.line_no, r.value) for r in rows] == expected
    assert [r.position for r in rows] == list(range(1, len(expected) + 1))


def test_versions_follow_the_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = '{{"stream_id":"s","type":"t","source":"so","payload":{{"n":{}}}}}\n'
    (tmp_path / "in" / "b").write_text("".join(body.format(i) for i in range(20, 30)))
    (tmp_path / "in" / "a").write_text("{broken\n" + "".join(body.format(i) for i in range(20)))
    log, rejected = str(tmp_path / "log"), str(tmp_path / "rejected")
    for batch_id in (0, 0, 1):  # a retry, and the same files again under a later number
        import_requests(spark, str(tmp_path / "in"), log, rejected, "tenant-a", batch_id, writer="import")
    rows = read_log(spark, log).orderBy("version").collect()
    assert [(r.version, r.payload) for r in rows] == [(i + 1, f'{{"n":{i}}}') for i in range(30)]
    assert {(r.file[-1], r.line_no) for r in spark.read.parquet(rejected).collect()} == {("a", 1)}
