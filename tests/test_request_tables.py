import random

import pytest

from annalog.operators import request_tables as rt
from annalog.schema import REPLAY_REQUEST_SCHEMA
from conftest import at, event, uid


def iso(t):
    return t.strftime("%Y-%m-%dT%H:%M:%SZ")


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_timeline_requests_against_brute_force(spark, log_of, limit):
    rnd = random.Random(5)
    events = [event(i, tenant_id=rnd.choice(["hot", "hot", "cold"]), occurred_at=at(rnd.randrange(0, 9000) // 60 * 60)) for i in range(80)]
    asked = []
    for n in range(25):
        low, high = (rnd.choice([None, at(rnd.randrange(0, 9000) // 60 * 60)]) for _ in range(2))
        asked.append((f"q{n}", rnd.choice(["hot", "cold", "none"]), low, high, rnd.choice([0, 3, 500]), rnd.choice([-2, 0, 4])))
    texts = [(q, t, iso(a) if a else "", iso(b) if b else "", n, s) for q, t, a, b, n, s in asked]
    frame = spark.createDataFrame(
        [*texts, ("bad", "hot", "nope", "", 0, 0)],
        "request_id string, tenant_id string, from_time string, to_time string, limit int, offset int",
    )
    ok, rejected = rt.parse_bounds(frame)
    assert [r.request_id for r in rejected.collect()] == ["bad"]
    totals = {r.request_id: r.total for r in rt.timeline_totals(log_of(events), ok, limit).collect()}
    pages = {}
    for r in rt.timeline_pages(log_of(events), ok, limit).collect():
        pages.setdefault(r.request_id, []).append((r.place, r.id))
    for q, tenant, low, high, n, skip in asked:
        found = [e for e in events if e["tenant_id"] == tenant and (not low or e["occurred_at"] >= low) and (not high or e["occurred_at"] <= high)]
        found.sort(key=lambda e: (e["occurred_at"], e["id"]), reverse=True)
        size = 20 if n <= 0 else min(n, 100)
        expected = [e["id"] for e in found[max(skip, 0):][:size]]
        assert totals[q] == len(found)
        assert [i for _, i in sorted(pages.get(q, []))] == expected


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_replay_requests_against_brute_force(spark, log_of, limit):
    rnd = random.Random(8)
    events = [
        event(i, tenant_id=rnd.choice("ab"), stream_id=rnd.choice(["s1", "s2"]), type=rnd.choice(["x", "y"]),
              actor_id=rnd.choice(["u", "v"]), correlation_id=rnd.choice(["c1", "c2"]), occurred_at=at(i * 30))
        for i in range(70)
    ]
    asked = []
    for n in range(40):
        pick = lambda *v: rnd.choice(["", *v])
        ids = [uid(rnd.randrange(90)) for _ in range(6)] if n % 5 == 0 else None
        asked.append(
            (f"r{n}", "a", "a" if n % 7 else ("" if ids else "a"), pick("s1"), pick("c1"), pick("x", "y"), pick("u"),
             rnd.choice(["", iso(at(300))]), rnd.choice(["", iso(at(1500))]), ids, True, "", rnd.choice([0, 2, 30]))
        )
    asked += [
        ("no-caller", "", "a", "", "", "", "", "", "", None, True, "", 0),
        ("no-reason", "a", "a", "", "", "", "", "", "", None, False, "", 0),
        ("no-scope", "a", "", "", "", "", "", "", "", None, True, "", 0),
        ("other", "a", "b", "", "", "", "", "", "", None, True, "", 0),
        ("bad-time", "a", "a", "", "", "", "", "soon", "", None, True, "", 0),
    ]
    frame = spark.createDataFrame(asked, REPLAY_REQUEST_SCHEMA)
    ok, rejected = rt.validate_requests(frame)
    assert {r.request_id for r in rejected.collect()} == {"no-caller", "no-reason", "no-scope", "other", "bad-time"}
    counts, hits = rt.match_requests(log_of(events), ok, limit)
    status = {r.request_id: (r.matched_count, r.status) for r in counts.collect()}
    found = {}
    for r in hits.collect():
        found.setdefault(r.request_id, set()).add(r.id)
    for q, _, _, stream, corr, kind, actor, low, high, ids, _, _, cap in asked[:40]:
        def wanted(e):
            if e["tenant_id"] != "a":
                return False
            if ids:
                return e["id"] in ids
            return (
                (not stream or e["stream_id"] == stream) and (not corr or e["correlation_id"] == corr)
                and (not kind or e["type"] == kind) and (not actor or e["actor_id"] == actor)
                and (not low or e["occurred_at"] >= at(300)) and (not high or e["occurred_at"] <= at(1500))
            )
        expected = {e["id"] for e in events if wanted(e)}
        over = len(expected) > (cap or 1000)
        assert status[q] == (len(expected), "limit_exceeded" if over else "ok")
        assert found.get(q, set()) == (set() if over else expected)


@pytest.mark.parametrize("most", [0, 100])
def test_bounds_and_tenants_reach_the_scan(spark, log_of, tmp_path, monkeypatch, most):
    """Many tenants are a semi-join, few a filter at the scan; the totals agree."""
    monkeypatch.setattr(rt, "MAX_TENANT_FILTER", most)
    log_of([event(i, tenant_id="ab"[i % 2], occurred_at=at(i * 600)) for i in range(40)]).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    ok, _ = rt.parse_bounds(
        spark.createDataFrame(
            [("q1", "a", iso(at(1200)), iso(at(9000)), 0, 0), ("q2", "a", iso(at(7000)), iso(at(12000)), 0, 0), ("q3", "a", iso(at(9000)), iso(at(1200)), 0, 0)],
            "request_id string, tenant_id string, from_time string, to_time string, limit int, offset int",
        )
    )
    assert {r.request_id: r.total for r in rt.timeline_totals(log, ok).collect()} == {"q1": 7, "q2": 5, "q3": 0}
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    scan = rt._clip(log, ok)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(occurred_at" in scan and "LessThanOrEqual(occurred_at" in scan
    assert ("EqualTo(tenant_id,a)" in scan) == (most == 100)


def test_ranges_longer_than_a_block(spark, log_of, monkeypatch):
    monkeypatch.setattr(rt, "BLOCK", 3)
    events = [event(i, occurred_at=at(i * 700)) for i in range(40)]
    asked = [("r1", "tenant-a", "tenant-a", "", "", "", "", iso(at(1400)), "", None, True, "", 50), ("r2", "tenant-a", "tenant-a", "", "", "", "", "", "", None, True, "", 39)]
    ok, _ = rt.validate_requests(spark.createDataFrame(asked, REPLAY_REQUEST_SCHEMA))
    counts, hits = rt.match_requests(log_of(events), ok)
    assert {(r.request_id, r.matched_count, r.status) for r in counts.collect()} == {("r1", 38, "ok"), ("r2", 40, "limit_exceeded")}
    assert sorted(r.id for r in hits.collect()) == [e["id"] for e in events[2:]]


def test_no_requests_and_no_events(spark, log_of):
    ok, _ = rt.parse_bounds(
        spark.createDataFrame([("q1", "a", "", "", 0, 0)], "request_id string, tenant_id string, from_time string, to_time string, limit int, offset int")
    )
    assert [r.total for r in rt.timeline_totals(log_of([]), ok).collect()] == [0]
    assert rt.timeline_pages(log_of([]), ok).count() == 0
    assert rt.timeline_totals(log_of([event(1)]), ok.limit(0)).count() == 0
