import random

import pytest
from pyspark.sql import functions as F

from annalog.operators.audit import gaps
from annalog.operators.replay import VersionGap, replay_read
from annalog.operators.runs import read_ranges, version_runs
from conftest import at, event, uid

REQUESTS = "request_id string, tenant_id string, stream_id string, from_version long, to_version long, from_time timestamp, to_time timestamp"


def plain_runs(versions):
    runs = []
    for v in sorted(versions):
        if runs and v == runs[-1][1] + 1:
            runs[-1][1] = v
        else:
            runs.append([v, v])
    return sorted(map(tuple, runs))


@pytest.mark.parametrize("width", [1, 3, 10, 100_000])
def test_runs_at_any_width(spark, width):
    rng = random.Random(width)
    streams = {f"s{k}": [rng.randrange(1, 40) for _ in range(rng.choice([1, 5, 60]))] for k in range(8)}
    streams |= {"whole": list(range(1, 200)), "hole": [v for v in range(1, 100) if v % 10], "twice": [5, 6, 6, 6, 7, 9, 9, 10]}
    rows = [("t", s, v) for s, vs in streams.items() for v in vs]
    frame = spark.createDataFrame(rows, "tenant_id string, stream_id string, version long").repartition(3)
    found = {}
    for r in version_runs(frame, width=width).collect():
        found.setdefault(r.stream_id, []).append((r.first, r.last))
    want = {s: plain_runs(vs) for s, vs in streams.items()}
    # A version stored more than twice still starts one run only.
    want["twice"] = [(5, 6), (6, 7), (9, 9), (9, 10)]
    want = {s: w if s == "twice" else plain_runs([v for v in set(streams[s]) for _ in range(min(streams[s].count(v), 2))]) for s, w in want.items()}
    assert {s: sorted(f) for s, f in found.items()} == want


def test_the_runs_of_a_stream_without_gaps_are_one_row(spark):
    frame = spark.range(1, 30_001).select(F.lit("t").alias("tenant_id"), F.lit("hot").alias("stream_id"), F.col("id").alias("version"))
    assert [tuple(r)[2:] for r in version_runs(frame, width=1000).collect()] == [(1, 30_000)]


@pytest.mark.parametrize("width", [2, 100_000])
def test_a_table_of_requests_answers_like_single_reads(spark, log_of, width):
    rng = random.Random(5)
    rows, n = [], 0
    for s in range(6):
        for v in range(1, 15):
            for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 2]) if s % 2 else 1):
                rows.append(event(n, tenant_id=f"t{s % 2}", stream_id=f"s{s}", version=v, occurred_at=at(v * 100 + rng.randrange(250))))
                n += 1
    log = log_of(rows)
    asked = []
    for k in range(40):
        s, low = rng.randrange(7), rng.randrange(8)
        times = [at(300), at(1100)] if k % 3 == 0 else [None, at(900)] if k % 7 == 0 else [None, None]
        asked.append((f"r{k}", f"t{s % 2}", f"s{s}", rng.choice([low, None]), rng.choice([0, None, low + 4]), *times))
    asked += [("x1", "", "s1", 0, 0, None, None), ("x2", None, "s1", 0, 0, None, None), ("x3", "t1", "", 0, 0, None, None)]
    asked += [("x4", "t1", None, 0, 0, None, None), ("x5", "t1", "s1", -1, 0, None, None), ("x6", "t1", "s1", 0, -2, None, None)]
    asked += [("x7", "t0", "s1", 0, 0, None, None), ("x8", "t1", "s1", 9, 3, None, None)]
    verdicts, found = read_ranges(log, spark.createDataFrame(asked, REQUESTS), width=width)
    said = {r.request_id: r for r in verdicts.collect()}
    assert len(said) == len(asked)
    got = {}
    for r in found.collect():
        got.setdefault(r.request_id, []).append(r.id)
    for name, tenant, stream, low, high, start, end in asked:
        verdict = said[name]
        if name in ("x1", "x2", "x3", "x4", "x5", "x6"):
            reasons = {"x1": "tenant_missing", "x2": "tenant_missing", "x3": "stream_missing", "x4": "stream_missing"}
            assert verdict.reject_reason == reasons.get(name, "version_negative") and name not in got
            continue
        try:
            single = replay_read(log, tenant, stream, low or 0, high or 0, start, end)
        except VersionGap:
            read = log.where((F.col("tenant_id") == tenant) & (F.col("stream_id") == stream) & (F.col("version") >= (low or 0)))
            read = read.where(F.col("version") <= high) if high else read
            read = read.where(F.col("occurred_at") >= start) if start else read
            read = read.where(F.col("occurred_at") <= end) if end else read
            first = gaps(read).orderBy("previous_version", "found_version").first()
            assert verdict.reject_reason == "version_gap" and name not in got
            assert (verdict.previous_version, verdict.missing_version, verdict.found_version) == (
                first.previous_version, first.missing_version, first.found_version
            )
        else:
            assert verdict.reject_reason is None and verdict.missing_version is None
            assert sorted(got.get(name, [])) == sorted(r.id for r in single.collect())


def test_stored_runs_judge_without_the_log(spark, log_of):
    log = log_of([event(i, stream_id="s", version=i + 1) for i in range(9) if i != 4])
    runs = spark.createDataFrame(version_runs(log).collect(), "tenant_id string, stream_id string, first long, last long")
    asked = spark.createDataFrame([("a", "tenant-a", "s", 0, 4, None, None), ("b", "tenant-a", "s", 0, 0, None, None)], REQUESTS)
    verdicts, rows = read_ranges(log, asked, runs)
    assert {(r.request_id, r.reject_reason, r.missing_version) for r in verdicts.collect()} == {("a", None, None), ("b", "version_gap", 5)}
    assert sorted(r.id for r in rows.collect()) == [uid(i) for i in range(4)]
    none = spark.createDataFrame([], REQUESTS)
    assert [d.count() for d in read_ranges(log, none)] == [0, 0]
    assert {r.reject_reason for r in read_ranges(log_of([]), asked)[0].collect()} == {None}
