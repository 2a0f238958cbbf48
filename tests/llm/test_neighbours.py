import numpy as np
import pytest
from pyspark.sql import functions as F

from annalog.llm import neighbours as nn

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


def vectors(n, dim=16, seed=1):
    v = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    return [(i, v[i].tolist(), 0.0) for i in range(n)]


def brute(rows, top=20):
    kept = {}
    for i, v, _ in rows:
        good = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if good:
            kept[i] = min(kept.get(i, v), v)
    out = {}
    for q in sorted(i for i in kept if i % 20 == 0):
        scores = [
            (-float((np.array(kept[i], float) * np.array(kept[q], float)).sum()), i)
            for i in kept
            if i != q and len(kept[i]) == len(kept[q])
        ]
        out[q] = [(i, -s) for s, i in sorted(scores)[:top]]
    return {q: v for q, v in out.items() if v}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def query(df, **given):
    return nn.nearest(df, F.col("vec_id") % 20 == 0, **given)


def test_odd_vectors_ties_and_few_candidates(spark):
    rows = vectors(12) + [(20, [1.0] * 16, 0.0), (21, [1.0] * 16, 0.0), (22, [1.0] * 16, 0.0), (40, [1.0, 2.0], 0.0)]
    rows += [(41, [3.0, 1.0], 0.0), (60, None, 0.0), (61, [0.0] * 16, 0.0), (62, [NAN] * 16, 0.0), (63, [INF] + [1.0] * 15, 0.0)]
    rows += [(64, [None] + [1.0] * 15, 0.0), (65, [], 0.0), (None, [1.0] * 16, 0.0), (5, [2.0] * 16, 0.0), (80, [5.0] * 3, 0.0)]
    got, want = found(query(table(spark, rows))), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_a_third_of_equal_vectors(spark):
    rows = vectors(900) + [(i, [5.0] * 16, 0.0) for i in range(900, 1400)]
    got, want = found(query(table(spark, rows))), brute(rows)
    same = [q for q in want if q >= 900]
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in same)
    assert all(len({s for _, s in got[q]}) == 1 for q in same)


@pytest.mark.parametrize("shard", [4096, 500])
def test_recall(spark, monkeypatch, shard):
    monkeypatch.setattr(nn, "SHARD", shard)
    monkeypatch.setattr(nn, "BLOCK", 30)
    rows = vectors(2000, 64)
    got, want = found(query(table(spark, rows))), brute(rows)
    assert got.keys() == want.keys()
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9


def test_empty(spark):
    assert query(table(spark, [])).count() == 0
    assert query(table(spark, [(0, [1.0], 0.0)])).count() == 0


def test_longest_prefixes_come_first():
    rng = np.random.default_rng(3)
    forest = nn.Forest(rng.standard_normal((300, 8)), trees=4)
    queries = rng.standard_normal((20, 8))
    codes, own = forest.codes(queries), forest.codes(forest.vectors)
    for q, hits in enumerate(forest.candidates(queries, 40)):
        shared = [nn.BITS - np.array([int(x).bit_length() for x in own[t] ^ codes[t, q]]) for t in range(4)]
        for length in range(nn.BITS, -1, -1):
            if sum(int((s >= length).sum()) for s in shared) >= 40:
                break
        assert set(hits) == {i for s in shared for i in np.flatnonzero(s >= length)}
