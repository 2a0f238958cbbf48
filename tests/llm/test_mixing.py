import random
import re

import pytest
from pyspark.sql import functions as F
from tests_llm_common import ODD, prose, rows_of

from annalog.llm import mixing as m

FIELDS = "doc_id long, text string, source string, size long, taken int"  # clashing extra columns


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes):
    """The contract's words: by weight, what is above twice the size goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, rest, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        part = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if part[s] > 2 * sizes[s]}
        if not over:
            return target | part
        target |= {s: 2.0 * sizes[s] for s in over}
        rest, free = 1.5 * sum(sizes.values()) - sum(target.values()), free - over
    return target


def plain_seats(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats if any(votes.values()) else 0):
        best = min((p for p in votes if votes[p]), key=lambda p: (-votes[p] / (2 * won[p] + 1), p))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(6))
def test_apportionment_seat_by_seat(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for g in range(4):
        votes = {p: rng.choice([0, 1, 1, 7, rng.randrange(1, 5000), rng.randrange(1, 10**6)]) for p in range(rng.randrange(1, 30))}
        seats = rng.choice([0, 1, 3, 40, 700])
        rows += [(g, p, v, seats) for p, v in votes.items()]
        want |= {(g, p): n for p, n in plain_seats(votes, seats).items()}
    frame = spark.createDataFrame(rows, "g int, p long, v long, seats long")
    found = {(r.g, r.p): r.quota for r in m.apportion(frame, ["g"], "p", "v", "seats").collect()}
    assert found == want


def mixed(spark, docs, **given):
    frame = spark.createDataFrame([(i, t, s, 5, 5) for i, t, s in docs], FIELDS).repartition(3)
    return m.mix(frame, keep=["text"], **given).collect()


def test_sources_come_near_their_targets(spark):
    docs = [(i, prose(i, 30 + i % 90), "hot") for i in range(400)]
    docs += [(1000 + i, prose(i, 50), f"s{i % 7}") for i in range(200)]
    docs += [(2000, prose(1, 5), "tiny"), (2001, prose(1, 20), None), (2002, None, None), (2003, " ", "blank")]
    docs += docs[:30] + docs[400:405]
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = plain_targets(sizes)
    for shard in (1_000_000, 700):
        rows = mixed(spark, docs, shard=shard)
        assert len(rows) == len(docs)
        taken = dict.fromkeys(sizes, 0)
        for r in rows:
            assert r.size == len(words(r.text)) and r.source_size == sizes[r.source]
            assert r.target == pytest.approx(want[r.source])
            assert r.taken <= 2 * r.size
            assert r.taken == r.laps * r.size + sum(s.end - s.first for s in r.spans)
            assert all(0 <= s.first < s.end <= r.size for s in r.spans)
            taken[r.source] += r.taken
        for s in sizes:
            assert abs(taken[s] - want[s]) <= max(2 * m.BLOCK, 0.02 * want[s]), s
        whole = [r for r in rows if r.taken % max(r.size, 1) == 0]
        assert len(whole) > 0.8 * len(rows)


def test_reruns_agree_and_seeds_differ(spark):
    docs = [(i, prose(i, 60), f"s{i % 3}") for i in range(120)]
    one, two, other = (sorted((r.doc_id, r.taken) for r in mixed(spark, docs, seed=s)) for s in (7, 7, 8))
    assert one == two and one != other


def test_odd_rows(spark, odd_docs, no_docs):
    rows = rows_of(m.mix(odd_docs), "doc_id", "size")
    assert rows == sorted(((i, len(words(t))) for i, t in ODD), key=repr)
    out = m.mix(odd_docs)
    total = out.agg(F.sum("size"), F.sum("taken"), F.max("target")).first()
    assert abs(total[1] - 1.5 * total[0]) <= 2 * m.BLOCK and total[2] == 1.5 * total[0]
    assert m.mix(no_docs).count() == 0
    blank = no_docs.union(spark.createDataFrame([(1, None, None, None, None), (2, "  ", None, "s", 2)], no_docs.schema))
    assert rows_of(m.mix(blank), "doc_id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
