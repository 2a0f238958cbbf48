import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalog.llm import clusters as c

FIELDS = "vec_id long, embedding array<double>, cluster string, key int, v string, distance int"
NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k=16, rounds=3):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == 64 and all(a is not None and math.isfinite(a) for a in x):
            kept.append((i, [math.floor(64 * a) for a in x]))
    draw = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (*draw(r[0]), r[1]))[:k]]
    square = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True))
    for i in range(rounds + 1):
        near = [min(range(len(centroids)), key=lambda j: (square(v, centroids[j]), j)) for _, v in kept]
        if i == rounds:
            break
        for j in range(len(centroids)):
            own = [v for (_, v), n in zip(kept, near, strict=True) if n == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    far = [square(v, centroids[n]) for (_, v), n in zip(kept, near, strict=True)]
    by = [sum(d for d, n in zip(far, near, strict=True) if n == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in centroids]
    limit = (1 << 63) - 1
    low = lambda n: min(n, limit)
    return sorted(((i, n, low(d), low(by[n]), low(sum(far)), sha[n]) for (i, _), n, d in zip(kept, near, far, strict=True)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "x", 1, "v", 2) for i, x in rows], FIELDS).repartition(3)


def found(spark, rows, **given):
    return sorted((tuple(r[n] for n in NAMES) for r in c.clusters(frame(spark, rows), **given).collect()), key=repr)


def blobs(seed, n, spread=0.05, groups=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, 64))
    return [(i, (middles[i % groups] + spread * rng.normal(size=64)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_like_brute_force(spark, spread):
    rows = blobs(1, 400, spread)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = blobs(2, 60)
    whole = [0.5] * 64
    rows += [(0, whole), (0, whole), (1, [-0.25] * 64), (None, whole), (None, [2.0] * 64), (2**60 + 1, whole)]
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [None] + [1.0] * 63)]
    rows += [(505, [float("nan")] + [1.0] * 63), (506, [float("inf")] + [1.0] * 63), (507, [0.0] * 64)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[60:66]) == brute(rows[60:66])  # fewer vectors than clusters
    assert found(spark, [(1, whole)]) == brute([(1, whole)])
    assert found(spark, [(5, whole)] * 40) == brute([(5, whole)] * 40)
    assert found(spark, []) == [] and found(spark, [(500, None)]) == []


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(50)] + [(100, [0.5] * 64)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [1e5, 1e9, 1e15])
def test_large_numbers_stay_whole(spark, size):
    rng = random.Random(3)
    rows = [(i, [size * rng.uniform(-1, 1) for _ in range(64)]) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_vectors_with_room_are_not_scanned_again(spark):
    kept = c.whole_vectors(frame(spark, blobs(4, 3000, 0.02)))
    state = c.fit(kept, rounds=5)
    assert state.popped[-1] < 0.5 * kept.count()
    assert sum(c.live(h, state.drift).count() for h in state.heaps) == kept.count()
    assert found(spark, blobs(4, 3000, 0.02), rounds=5) == brute(blobs(4, 3000, 0.02), rounds=5)


def test_what_expires_is_a_range_of_keys(spark):
    state = c.fit(c.whole_vectors(frame(spark, blobs(5, 200))), rounds=1)
    plan = c.expired(state.heaps[0], [0.0] * 16, [1.0] * 16)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "GreaterThan(key,0.0)" in plan
    part = c.expired(state.heaps[0], [0.0] * 16, [1.0] * 16)
    assert part.where("key <= 0 OR key > 1").count() == 0 and part.agg(F.count("*")).first()[0] <= 200
