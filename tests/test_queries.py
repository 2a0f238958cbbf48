import pytest
from pyspark.sql import functions as F

from annalog.operators import audit_queries as q
from annalog.operators import paging
from annalog.operators.paging import clamp, text_param
from conftest import at, event, uid


def ids(df):
    return [r.id for r in df.collect()]


def test_correlation_and_tenant_isolation(log_of):
    log = log_of(
        [
            event(1, correlation_id="corr-123"),
            event(2, correlation_id="corr-123"),
            event(3, correlation_id="other"),
            event(4, correlation_id="corr-123", tenant_id="tenant-b"),
        ]
    )
    rows, summary = q.by_correlation(log, "tenant-a", "corr-123")
    assert ids(rows) == [uid(2), uid(1)] and summary.first().total == 2
    assert ids(q.by_correlation(log, "tenant-b", "corr-123")[0]) == [uid(4)]
    empty, none = q.by_correlation(log, "tenant-a", "unknown")
    assert ids(empty) == [] and none.first().total == 0


def test_paging_and_total(log_of):
    log = log_of([event(i, correlation_id="c") for i in range(5)])
    rows, summary = q.by_correlation(log, "tenant-a", "c", 2, 1)
    assert ids(rows) == [uid(3), uid(2)]
    assert summary.first().asDict() == {"total": 5, "limit": 2, "offset": 1}
    past, summary = q.by_correlation(log, "tenant-a", "c", 2, 50)
    assert ids(past) == [] and summary.first().total == 5


@pytest.mark.parametrize(
    "given, expected", [((9999, 0), (100, 0)), ((0, -3), (20, 0)), ((None, None), (20, 0)), ((-1, 7), (20, 7)), ((100, 1), (100, 1))]
)
def test_clamp(given, expected):
    assert clamp(*given) == expected


@pytest.mark.parametrize("text, expected", [(None, 20), ("", 20), ("x", 20), ("-1", 20), ("0", 0), ("33", 33)])
def test_text_param(text, expected):
    assert text_param(text, 20) == expected


@pytest.mark.parametrize("task_limit", [3, 1_000_000])
def test_deep_pages_agree_with_top_k(log_of, monkeypatch, task_limit):
    log = log_of([event(i, occurred_at=at(i * 700 % 9001)) for i in range(60)])
    shallow = ids(q.feed_page(log, "tenant-a", 10, 25)[0])
    monkeypatch.setattr(paging, "TOP_K_DEPTH", 5)
    deep = paging.page(log, q.newest_first(), 10, 25, digits=q._newest_digits(), task_limit=task_limit)[0]
    assert ids(deep) == shallow


def test_by_id_hides_other_tenants(log_of):
    log = log_of([event(1, tenant_id="tenant-b")])
    assert q.by_id(log, "tenant-a", uid(1)).isEmpty()
    assert ids(q.by_id(log, "tenant-b", uid(1).upper())) == [uid(1)]
    with pytest.raises(ValueError):
        q.by_id(log, "", uid(1))


def test_stream_from_version(log_of):
    log = log_of([event(i, version=i) for i in range(1, 6)])
    assert [r.version for r in q.stream(log, "parcel:1", "tenant-a", 3).collect()] == [3, 4, 5]
    assert q.stream(log, "parcel:1", "tenant-a", 99).isEmpty()
    assert q.stream(log, "parcel:1").count() == 5 and q.stream(log, "parcel:1", "tenant-b").isEmpty()


def test_timeline_bounds_are_inclusive(log_of):
    log = log_of([event(i) for i in range(10)])
    rows, summary = q.timeline(log, "tenant-a", at(3), at(6))
    assert ids(rows) == [uid(6), uid(5), uid(4), uid(3)] and summary.first().total == 4
    assert q.timeline(log, "tenant-a", at(6), at(3))[1].first().total == 0
    assert q.timeline(log, "tenant-a")[1].first().total == 10


def test_effects_and_children(log_of):
    log = log_of(
        [event(1), event(2, causation_id=uid(1)), event(3, causation_id=uid(1)), event(4, causation_id="lost"),
         event(5, causation_id=uid(1), tenant_id="tenant-b")]
    )
    rows, summary = q.effects(log, "tenant-a", uid(1))
    assert ids(rows) == [uid(2), uid(3)] and summary.first().total == 2
    for limit in (1, 1_000_000):
        assert sorted(ids(q.children(log, limit))) == [uid(2), uid(3)]
    with pytest.raises(ValueError):
        q.effects(log, "tenant-a", "")


def test_routing_of_reads(log_of):
    log, index = log_of([event(1), event(2)]), log_of([event(1)])
    strong = q.list_events(log, index, "tenant-a", "corr-2")[1].first()
    assert (strong.total, strong.read_model, strong.consistency) == (1, "postgres", "strong")
    eventual = q.list_events(log, index, "tenant-a")[1].first()
    assert (eventual.total, eventual.read_model, eventual.consistency) == (1, "elasticsearch", "eventual")


def test_pages_are_top_k_not_sorts(log_of):
    rows, _ = q.feed_page(log_of([event(1)]), "tenant-a", 20, 40)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=60" in plan


def test_actor_and_replay_feeds(log_of):
    log = log_of([event(1, actor_id="u"), event(2, is_replay=True, replay_id="r"), event(3, is_replay=True, replay_id="x")])
    assert ids(q.actor_feed(log, "tenant-a", "u")[0]) == [uid(1)] and q.actor_feed(log, "tenant-a", "")[0].isEmpty()
    assert ids(q.replay_batch(log, "tenant-a", "r")) == [uid(2)] and q.replay_batch(log, "tenant-a", "").isEmpty()
    assert ids(q.replay_feed(log, "tenant-a")[0]) == [uid(3), uid(2)]
    assert q.by_ids(log, "tenant-a", log.filter(F.col("id") == uid(3)).select("id")).count() == 1
