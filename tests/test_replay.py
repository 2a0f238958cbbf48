import datetime as dt

import pytest

from annalog.operators.append import assign_versions
from annalog.operators.audit import gap_check, gaps, lineage_orphans, replay_verify
from annalog.operators.replay import (
    ReplayFilter,
    ReplayLimitExceeded,
    ReplayRequest,
    VersionGap,
    check_limit,
    match,
    plan_hourly,
    replay_read,
)
from annalog.plans.jobs import execute, run_replay
from annalog.sources.log import append_batch, read_log
from conftest import at, event, uid


@pytest.mark.parametrize("versions", [[], [1], [1, 2, 3], [2, 3]])
def test_contiguous(log_of, versions):
    log = log_of([event(i, version=v) for i, v in enumerate(versions)])
    assert gaps(log).isEmpty() and gap_check(log).filter("not contiguous").isEmpty()
    assert [r.version for r in replay_read(log, "tenant-a", "parcel:1").collect()] == versions


@pytest.mark.parametrize("versions, text", [([1, 2, 4], "goes from 2 to 4, 3 is missing"), ([1, 1, 2], "goes from 1 to 1, 2 is missing")])
def test_gap_names_the_missing_version(log_of, versions, text):
    log = log_of([event(i, version=v) for i, v in enumerate(versions)])
    with pytest.raises(VersionGap) as caught:
        replay_read(log, "tenant-a", "parcel:1")
    assert text in str(caught.value)
    assert gap_check(log).filter("not contiguous").count() == 1


@pytest.mark.parametrize("width", [1, 2, 7, 100_000])
def test_gaps_against_brute_force(log_of, width):
    versions = [1, 2, 3, 7, 8, 8, 8, 20, 21, 40]
    log = log_of([event(i, version=v) for i, v in enumerate(versions)])
    got = sorted((r.previous_version, r.missing_version, r.found_version, r.times) for r in gaps(log, width=width).collect())
    assert got == [(3, 4, 7, 1), (8, 9, 8, 2), (8, 9, 20, 1), (21, 22, 40, 1)]


def test_read_bounds(log_of):
    log = log_of([event(i, version=i) for i in range(1, 9)])
    read = lambda **k: [r.version for r in replay_read(log, "tenant-a", "parcel:1", **k).collect()]
    assert read(from_version=3) == [3, 4, 5, 6, 7, 8] and read(from_version=99) == []
    assert read(from_version=2, to_version=4) == [2, 3, 4]
    assert read(from_time=at(5), to_time=at(6)) == [5, 6]
    for bad in (dict(stream_id=""), dict(from_version=-1), dict(tenant="")):
        with pytest.raises(ValueError):
            replay_read(log, bad.get("tenant", "tenant-a"), bad.get("stream_id", "parcel:1"), bad.get("from_version", 0))


def test_filter_fields_and_ids(log_of):
    log = log_of(
        [event(1), event(2, stream_id="parcel:2"), event(3, type="x", actor_id="u"), event(4, tenant_id="tenant-b")]
    )
    found = lambda **k: sorted(r.id for r in match(log, ReplayFilter(**k)).collect())
    assert found(tenant_id="tenant-a") == [uid(1), uid(2), uid(3)]
    assert found(tenant_id="tenant-a", stream_id="parcel:1", event_type="x", actor_id="u") == [uid(3)]
    assert found(tenant_id="tenant-a", from_time=at(2), to_time=at(2)) == [uid(2)]
    assert found(event_ids=[uid(1), uid(4)]) == [uid(1), uid(4)]
    assert found(tenant_id="tenant-a", event_ids=[uid(1), uid(4)], stream_id="ignored") == [uid(1)]
    many = [uid(n) for n in range(1, 300)]
    assert found(tenant_id="tenant-a", event_ids=many) == [uid(1), uid(2), uid(3)]
    with pytest.raises(ValueError):
        match(log, ReplayFilter(stream_id="parcel:1"))


def request(**given):
    base = dict(filter=ReplayFilter(tenant_id="tenant-a"), caller_tenant="tenant-a", replay_reason="outage", replay_id="rep")
    return ReplayRequest(**(base | given), now=dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc))


@pytest.mark.parametrize(
    "given, text",
    [
        (dict(caller_tenant=""), "tenant_missing"),
        (dict(replay_reason=""), "reason_missing"),
        (dict(filter=ReplayFilter(stream_id="s")), "scope_missing"),
        (dict(filter=ReplayFilter(tenant_id="tenant-b")), "tenant_mismatch"),
    ],
)
def test_request_rules(log_of, given, text):
    with pytest.raises(ValueError, match=text):
        execute(log_of([event(1, version=1)]), request(**given))


def test_safety_limit(log_of):
    log = log_of([event(i, version=i) for i in range(1, 12)])
    assert check_limit(log, 11) == 11
    with pytest.raises(ReplayLimitExceeded):
        execute(log, request(safety_limit=10))
    assert request().limit() == 1000 and request(safety_limit=-4).limit() == 1000


def test_dry_run(log_of):
    log = assign_versions(log_of([event(i) for i in range(4)]))
    summary, events = execute(log, request(dry_run=True, replay_reason=""))
    assert summary.first().asDict() == {"replay_id": "", "dry_run": True, "matched_count": 4, "replayed_count": 0}
    assert [r.id for r in events.collect()] == [uid(i) for i in range(4)]


def test_active_replay_keeps_the_original_and_its_lineage(log_of):
    rows = [event(i, metadata={"region": "eu", "replay_id": "older"}, causation_id="c", actor_id="u") for i in range(4)]
    log = assign_versions(log_of(rows))
    summary, events = execute(log, request())
    assert summary.first().replayed_count == 4
    new = sorted(events.collect(), key=lambda r: r.version)
    assert [r.version for r in new] == [5, 6, 7, 8]
    assert [r.replay_source_event_id for r in new] == [uid(i) for i in range(4)]
    one = new[0]
    assert one.is_replay and one.replay_id == "rep" and one.replay_reason == "outage"
    assert one.occurred_at == dt.datetime(2024, 3, 1) == one.replayed_at and one.id != uid(0)
    assert (one.correlation_id, one.causation_id, one.actor_id, one.payload) == ("corr-0", "c", "u", '{"n": 1}')
    assert one.metadata == {
        "region": "eu", "is_replay": "true", "replay_id": "rep", "replay_source_event_id": uid(0), "replay_reason": "outage"
    }


def test_replay_job_is_atomic_and_repeatable(spark, log_of, tmp_path):
    log_path, bus = str(tmp_path / "log"), str(tmp_path / "bus")
    append_batch(log_of([event(i, stream_id=f"parcel:{i % 2}") for i in range(10)]), log_path, 0, writer="loader")
    wanted = request(filter=ReplayFilter(tenant_id="tenant-a", stream_id="parcel:1"))
    for _ in range(2):
        summary = run_replay(spark, log_path, wanted, 1, bus, {"parcel": "events.parcel.v1"})
        assert summary.first().replayed_count == 5
    log = read_log(spark, log_path)
    assert log.count() == 15 and gap_check(log).filter("not contiguous").isEmpty()
    assert spark.read.parquet(bus).count() == 5
    check = replay_verify(log).first()
    assert check.replayed_count == 5 and check.one_per_source
    assert lineage_orphans(log).isEmpty()
    again = request(filter=ReplayFilter(tenant_id="tenant-a", stream_id="parcel:1"), replay_id="rep2")
    run_replay(spark, log_path, again, 2)
    assert read_log(spark, log_path).count() == 25  # replays of replays count, as by default
    rows = match(read_log(spark, log_path), ReplayFilter(tenant_id="tenant-a", exclude_replays=True))
    assert rows.count() == 10


def test_hourly_plan(log_of):
    log = log_of([event(i, occurred_at=at(i * 1800)) for i in range(6)])
    assert [r.events for r in plan_hourly(log).orderBy("from_time").collect()] == [2, 2, 2]


def test_replays_and_appends_take_turns(spark, log_of, tmp_path):
    path = str(tmp_path / "log")
    append_batch(log_of([event(i, stream_id="s") for i in range(3)]), path, 0, writer="loader")
    wanted = request(filter=ReplayFilter(tenant_id="tenant-a", stream_id="s", exclude_replays=True))
    run_replay(spark, path, wanted, 1000)  # far ahead of the append's own numbers
    append_batch(log_of([event(i, stream_id="s") for i in range(10, 13)]), path, 1, writer="loader")
    assert sorted(r.version for r in read_log(spark, path).collect()) == list(range(1, 10))
    again = run_replay(spark, path, wanted, 2)  # the same replay_id adds nothing
    assert again.first().replayed_count == 3
    log = read_log(spark, path)
    assert log.count() == 9 == log.select("id").distinct().count()


def test_an_empty_id_list_is_not_given(log_of):
    log = log_of([event(i) for i in range(3)])
    assert match(log, ReplayFilter(tenant_id="tenant-a", event_ids=[])).count() == 3
    with pytest.raises(ValueError):
        request(filter=ReplayFilter(event_ids=[])).check()
