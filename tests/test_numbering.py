"""Running totals against brute force, with limits small enough to cut the keys."""

import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalog.operators.lookup import lookup
from annalog.operators.numbering import event_digits, running_total, text_digit, version_digit
from conftest import at, uid


def brute(rows, weight=lambda r: 1):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = {}
    for key, members in groups.items():
        total = 0
        for r in sorted(members, key=lambda r: (r[1], r[2])):
            total += weight(r)
            out[(key, r[2])] = total
    return out


def number(spark, rows, limit, weight=None):
    df = spark.createDataFrame(rows, "stream_id string, occurred_at timestamp, id string, w bigint")
    done = running_total(
        df, ["stream_id"], [F.col("occurred_at"), F.col("id")], event_digits(), weight=weight, limit=limit
    )
    return {(r.stream_id, r.id): r.row_no for r in done.collect()}


@pytest.mark.parametrize("limit", [1, 3, 10, 1_000_000])
def test_hot_stream_spread_over_hours(spark, limit):
    rnd = random.Random(1)
    rows = [
        ("hot" if i % 3 else f"s{i % 7}", at(rnd.randrange(0, 40_000)), uid(i), i % 5) for i in range(300)
    ]
    rnd.shuffle(rows)
    assert number(spark, rows, limit) == brute(rows)
    assert number(spark, rows, limit, F.col("w")) == brute(rows, lambda r: r[3])


@pytest.mark.parametrize("limit", [1, 4])
def test_all_rows_at_one_instant(spark, limit):
    rows = [("hot", at(5), uid(i * 7919 % 4099 << 16), 1) for i in range(200)]
    assert number(spark, rows, limit) == brute(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.integers(0, 9000), st.text("09afzAZ é", min_size=1, max_size=5)),
        min_size=1,
        max_size=40,
        unique_by=lambda r: (r[0], r[2]),
    )
)
def test_any_ids_keep_their_order(spark, drawn):
    rows = [(k, at(t), i, 1) for k, t, i in drawn]
    rows.sort(key=lambda r: r[2].encode())
    expected = brute([(k, t, i.encode(), w) for k, t, i, w in rows])
    got = number(spark, rows, limit=2)
    assert {(k, i.encode()): n for (k, i), n in got.items()} == expected


def test_text_digit_is_monotone(spark):
    texts = ["", "0", "00", "0a", "a", "aa", "aé", "z", "é", "𝒳"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", text_digit(F.col("t")).alias("d")).collect()
    ordered = sorted(rows, key=lambda r: r.t.encode())
    digits = [r.d for r in ordered]
    assert digits == sorted(digits)


def test_version_ranges(spark):
    df = spark.range(1, 501).select(F.lit("s").alias("k"), F.col("id").alias("version"))
    done = running_total(df, ["k"], [F.col("version").desc()], [-version_digit(F.col("version"), 10)], limit=20)
    assert all(r.row_no == 501 - r.version for r in done.collect())


@pytest.mark.parametrize("limit", [2, 1_000_000])
def test_lookup_with_a_crowded_key(spark, limit):
    rows = spark.createDataFrame(
        [(i, "hot" if i % 2 else ("gone" if i % 3 == 0 else f"k{i}")) for i in range(60)], "n int, key string"
    )
    table = spark.createDataFrame(
        [("hot", "H"), *[(f"k{i}", f"v{i}") for i in range(0, 60, 4)]], "key string, v string"
    )
    got = {r.n: r.far and r.far.v for r in lookup(rows, table, ["key"], "far", limit=limit).collect()}
    known = {r.key: r.v for r in table.collect()}
    assert got == {r.n: known.get(r.key) for r in rows.collect()}
