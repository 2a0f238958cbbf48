import pytest
from pyspark.sql import functions as F

from annalog.operators.append import append_result, assign_versions, first_delivery, stored_versions, stream_heads
from annalog.operators.audit import gap_check
from annalog.operators.audit_queries import timeline
from annalog.plans.jobs import import_requests
from annalog.sources.batches import BatchConflict, record
from annalog.sources.log import append_batch, merge_ids, read_heads, read_ids, read_log, snapshot_heads
from conftest import at, event, uid


def versions(df):
    return {r.id: r.version for r in df.select("id", "version").collect()}


@pytest.mark.parametrize("limit", [1, 1_000_000])
def test_streams_count_on_their_own(log_of, limit):
    rows = [event(i, stream_id=s) for i, s in enumerate("ABAB")]
    assert versions(assign_versions(log_of(rows), limit=limit)) == {uid(0): 1, uid(1): 1, uid(2): 2, uid(3): 2}


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_versions_follow_the_heads(log_of, limit):
    log = assign_versions(log_of([event(i, stream_id="A") for i in range(5)]))
    batch = log_of([event(10 + i, stream_id="AB"[i % 2], tenant_id="tenant-b") for i in range(8)])
    got = versions(assign_versions(batch, stream_heads(log), limit=limit))
    assert [got[uid(10 + i)] for i in range(8)] == [6, 1, 7, 2, 8, 3, 9, 4]


def test_first_delivery_wins(log_of):
    rows = [event(1, payload="late", occurred_at=at(9)), event(1, payload="first", occurred_at=at(1)), event(2)]
    got = {r.id: r.payload for r in first_delivery(log_of(rows)).collect()}
    assert got == {uid(1): "first", uid(2): '{"n": 1}'}


def test_known_ids_answer_with_the_stored_version(log_of):
    log = assign_versions(log_of([event(i) for i in range(3)]))
    batch = log_of([event(2, payload="changed"), event(7), event(7, occurred_at=at(99))])
    got = {r.id: (r.version, r.is_new) for r in append_result(batch, log).collect()}
    assert got == {uid(2): (3, False), uid(7): (4, True)}


def test_append_twice_and_retry(spark, log_of, tmp_path):
    path = str(tmp_path / "log")
    first = log_of([event(i, stream_id=f"s{i % 3}") for i in range(20)])
    append_batch(first, path, 0, writer="loader")
    append_batch(first, path, 0, writer="loader")
    assert read_log(spark, path).count() == 20
    both = log_of([event(i, stream_id=f"s{i % 3}") for i in range(10, 40)])
    append_batch(both, path, 1, writer="loader")
    append_batch(first, path, 2, writer="loader")  # a redelivery under a new batch id
    log = read_log(spark, path)
    assert log.count() == 40 and log.select("id").distinct().count() == 40
    assert gap_check(log).filter("not contiguous or first_version <> 1").isEmpty()
    heads = {r.stream_id: r.version for r in read_heads(spark, path).collect()}
    assert heads == {r.stream_id: r.version for r in stream_heads(log).collect()}
    kept = {r.id: r.version for r in read_log(spark, path, before=1).collect()}
    assert len(kept) == 20


def test_a_batch_that_counts_is_never_lost(spark, log_of, tmp_path):
    """A number that comes again with other rows is an error, whatever writers did since."""
    path = str(tmp_path / "log")
    rows = [log_of([event(10 * k + i) for i in range(n)]) for k, n in enumerate((5, 3, 2, 4, 0))]
    append_batch(rows[0], path, 0, writer="loader")
    for other in (rows[1], rows[4], rows[0].limit(3)):
        with pytest.raises(BatchConflict):
            append_batch(other, path, 0, writer="loader")
    assert read_log(spark, path).count() == 5
    assert append_batch(rows[2], path, 1, writer="loader") == 1
    with pytest.raises(BatchConflict):
        append_batch(rows[3], path, 0, writer="loader")
    assert append_batch(rows[3], path, 0, writer="other") == 2
    assert append_batch(rows[0].repartition(3), path, 0, writer="loader") == 0
    assert read_log(spark, path).count() == 11 and read_ids(spark, path).count() == 11
    with pytest.raises(TypeError):
        append_batch(rows[1], path, 5)  # no default writer that jobs would share
    append_batch(rows[4], path, 9, writer="empty")
    assert append_batch(rows[4], path, 9, writer="empty") == 9


@pytest.mark.parametrize("at_step", ["write_batch", "stream_heads", "record"])
def test_a_batch_killed_at_any_step_is_unseen(spark, log_of, tmp_path, monkeypatch, at_step):
    path = str(tmp_path / "log")
    append_batch(log_of([event(i, stream_id="s") for i in range(2)]), path, 0, writer="loader")
    more = log_of([event(i, stream_id="s") for i in range(2, 6)])

    def killed(*_, **__):
        raise RuntimeError("killed")

    for _ in range(2):
        with monkeypatch.context() as m:
            # Heads of the old log are read before the new ones are written.
            m.setattr(f"annalog.sources.log.{at_step}", killed)
            with pytest.raises(RuntimeError):
                append_batch(more, path, 1, writer="loader")
        assert versions_of(spark, path) == [("s", 1), ("s", 2)]
        assert read_ids(spark, path).count() == 2 and {r.version for r in read_heads(spark, path).collect()} == {2}
    assert append_batch(log_of([event(8, stream_id="s")]), path, 0, writer="other") == 1  # the number nobody saw
    append_batch(more, path, 1, writer="loader")
    assert versions_of(spark, path) == [("s", v) for v in range(1, 8)]


def test_known_ids_come_from_the_index_alone(spark, log_of, tmp_path):
    path = str(tmp_path / "log")
    for k in range(3):
        append_batch(log_of([event(10 * k + i) for i in range(10)]), path, k, writer="loader")
    batch = log_of([event(3), event(14), event(99)])
    for merged in (False, True):
        if merged:
            merge_ids(spark, path, 1)
        ids = read_ids(spark, path, batch)
        assert ids.inputFiles() and not any(f"{path}/" in f for f in ids.inputFiles())
        plan = ids._jdf.queryExecution().executedPlan().toString()
        assert "In(bucket, [" in plan or "EqualTo(bucket," in plan
        assert ("PartitionFilters: [isnotnull(batch_id" in plan) or not merged
        known = {r.id: r.version for r in stored_versions(batch, ids).collect()}
        assert known == {r.id: r.version for r in stored_versions(batch, read_log(spark, path)).collect()}
        assert known.keys() == {uid(3), uid(14)}
    assert append_batch(batch, path, 3, writer="loader") == 3
    assert read_log(spark, path).count() == 31 and read_ids(spark, path).count() == 31


def test_merging_runs_with_the_appends(spark, log_of, tmp_path, monkeypatch):
    monkeypatch.setattr("annalog.sources.log.MERGE_EVERY", 2)
    path = str(tmp_path / "log")
    for k in range(5):
        append_batch(log_of([event(5 * k + i, stream_id=f"s{i % 2}") for i in range(6)]), path, k, writer="loader")
    assert {r.batch_id for r in spark.read.parquet(f"{path}_id_snapshots").select("batch_id").distinct().collect()} == {1, 3}
    log = read_log(spark, path)
    assert log.count() == 26 == log.select("id").distinct().count() == read_ids(spark, path).count()
    assert gap_check(log).filter("not contiguous or first_version <> 1").isEmpty()


def test_log_scan_prunes_and_pushes_down(spark, log_of, tmp_path):
    path = str(tmp_path / "log")
    append_batch(log_of([event(i, tenant_id=f"t{i % 2}", occurred_at=at(i * 50_000)) for i in range(10)]), path, 0, writer="loader")
    rows = read_log(spark, path, layout=True).filter(
        (F.col("tenant_id") == "t1") & (F.col("occurred_date") == F.lit("2024-01-02").cast("date")) & (F.col("id") == uid(3))
    ).select("id", "version")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id," in plan and "EqualTo(tenant_id," in plan and "payload" not in plan.split("ReadSchema")[1]
    assert rows.count() == 1


def test_head_snapshots_replace_older_heads(spark, log_of, tmp_path):
    path = str(tmp_path / "log")
    for batch in range(3):
        append_batch(log_of([event(batch * 10 + i, stream_id=f"s{i % 2}") for i in range(4)]), path, batch, writer="loader")
    before = {r.stream_id: r.version for r in read_heads(spark, path).collect()}
    snapshot_heads(spark, path, 1)
    assert {r.stream_id: r.version for r in read_heads(spark, path).collect()} == before == {"s0": 6, "s1": 6}
    assert {r.version for r in read_heads(spark, path, before=1).collect()} == {2}
    append_batch(log_of([event(90, stream_id="s0")]), path, 3, writer="loader")
    assert read_log(spark, path).filter(F.col("id") == uid(90)).first().version == 7


def test_import_of_request_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = ['{"stream_id":"a","type":"t","source":"s"}'] * 3 + ['{"stream_id":"","type":"t","source":"s"}', "nonsense"]
    (source / "x.jsonl").write_text("\n".join(lines))
    paths = (str(tmp_path / "log"), str(tmp_path / "rejected"))
    for batch_id in (0, 0, 1):
        import_requests(spark, str(source), *paths, "tenant-a", batch_id, writer="import")
    log = read_log(spark, paths[0])
    assert sorted(r.version for r in log.collect()) == [1, 2, 3] and log.select("id").distinct().count() == 3
    first = spark.read.parquet(paths[1]).filter("batch_id = 0")
    assert sorted(r.preview for r in first.collect()) == ["nonsense", lines[3]]


def test_legacy_files_read_with_defaults(spark, log_of, tmp_path):
    path = str(tmp_path / "log")
    append_batch(log_of([event(1)]), path, 1, writer="loader")
    old = log_of([event(2, version=9)]).select("id", "stream_id", "type", "source", "version", "occurred_at", "payload", "metadata")
    old.withColumn("occurred_date", F.to_date("occurred_at")).write.partitionBy("occurred_date").parquet(f"{path}/batch_id=0")
    record(spark, path, "legacy", 0, 0, 1, 0)
    rows = {r.id: r for r in read_log(spark, path, legacy=True).collect()}
    assert rows[uid(2)].tenant_id == "default" and rows[uid(2)].correlation_id == "" and rows[uid(1)].tenant_id == "tenant-a"


def versions_of(spark, path):
    return sorted((r.stream_id, r.version) for r in read_log(spark, path).collect())


def test_writers_take_turns(spark, log_of, tmp_path):
    path = str(tmp_path / "log")
    assert append_batch(log_of([event(i, stream_id="s") for i in range(3)]), path, 0, writer="a") == 0
    assert append_batch(log_of([event(i, stream_id="s") for i in range(3, 6)]), path, 0, writer="b") == 1
    assert append_batch(log_of([event(i, stream_id="s") for i in range(6, 9)]), path, 1, writer="a") == 2
    with pytest.raises(BatchConflict):
        append_batch(log_of([event(99, stream_id="s")]), path, 0, writer="a")
    assert versions_of(spark, path) == [("s", v) for v in range(1, 10)]


def test_equal_times_keep_the_same_payload_in_any_order(log_of):
    rows = [event(1, payload=p) for p in ('{"a": 1}', '{"a": 2}', '{"a": 3}')]
    kept = {first_delivery(log_of(r)).first().payload for r in (rows, rows[::-1], [rows[1], rows[0], rows[2]])}
    assert len(kept) == 1


def test_days_are_utc_days(spark, log_of, tmp_path):
    path = str(tmp_path / "log")
    append_batch(log_of([event(i, occurred_at=at(i * 3600)) for i in range(48)]), path, 0, writer="loader")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        bounds = [F.lit("2024-01-01 01:00:00+00:00").cast("timestamp"), F.lit("2024-01-02 00:00:00+00:00").cast("timestamp")]
        rows, summary = timeline(read_log(spark, path, layout=True), "tenant-a", *bounds, limit=100)
        assert rows.count() == 24
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
