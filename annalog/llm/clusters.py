"""Centroid clustering with heap-ordered bounds.

Lloyd's rounds on whole numbers. A vector whose exact distances are known gets a gap: how
much nearer its own centroid is than any other (lower bound less upper bound). When centroids
move, the gap of every vector of a cluster shrinks by at most the same amount, the cluster's
drift; so what is kept is `key` = gap + the drift its cluster had gathered by then, and a
vector can only change its cluster once the drift gathered reaches its key.

A cluster's heap is a set of tables sorted by (cluster, key), one per round: the vectors that
were scanned in that round, with the keys they got. Nothing is rewritten. The vectors whose
gap expires in a round are a range of keys of each cluster in each table, between the
drift gathered a round ago and now; the range reaches the file's statistics as a filter, so
that the others are not read. Popped vectors are scanned against all centroids, sorted
into a new table, and move their components from one cluster's sum to another's.

Distances are compared as whole numbers; bounds are floating point with a margin. Only the
centroids (`k` of them) and sums by cluster are sent to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.session import cut_lineage

K = 16
DIMENSIONS = 64
ROUNDS = 3
SCALE = 64
SEED = 1
MARGIN = 1e-9  # of the bounds' floating point, relative and absolute
LARGEST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors of `dimensions` finite components, as whole numbers
    floor(scale * x). Numbers past 2^62 stand at that bound."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dimensions) & finite)
    bound = float(1 << 62)
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(bound)), F.lit(-bound))).cast("long"))
    return kept.select("vec_id", whole.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int = SEED) -> list[list[int]]:
    """The vectors whose SHA-256 of `seed:vec_id` is smallest; without id the last ones.
    Rows that share an id stand in the order of their components."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(draw.alias("draw"), "v").orderBy(F.col("draw").asc_nulls_last(), "v").limit(k)
    return [r.v for r in rows.collect()]


def _squares(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances (vector, centroid), exact: float64 where every sum stays below
    2^53, int64 below 2^63, else whole numbers of any size."""
    c = np.array(centroids, dtype=np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    if 4 * x.shape[1] * most * most < 1 << 53:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(axis=1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(axis=1)).astype(np.int64)
    if 4 * x.shape[1] * most * most >= 1 << 63:
        x, c = x.astype(object), c.astype(object)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    flat = lists.flatten().to_numpy()
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)


def _with(batch: pa.RecordBatch, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    arrays = [*batch.columns, *(pa.array(c) for c in columns.values())]
    return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *columns])


def scan(vectors: DataFrame, centroids: list[list[int]], gathered: list[float]) -> DataFrame:
    """(vec_id, v, was, cluster, key): each vector of (vec_id, v, was) against all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drift = np.array(gathered)
        for batch in batches:
            if not batch.num_rows:
                continue
            squares = _squares(_matrix(batch.column("v")), centroids)
            near = squares.argmin(axis=1)
            each = np.arange(len(near))
            upper = np.sqrt(squares[each, near].astype(np.float64))
            squares[each, near] = squares.max(axis=1) + 1
            lower = np.sqrt(squares.min(axis=1).astype(np.float64)) if len(centroids) > 1 else np.full(len(near), np.inf)
            key = (lower - upper) - MARGIN * (np.where(np.isinf(lower), 0, lower) + upper + 1) + drift[near]
            key = np.maximum(key, np.nextafter(drift[near], np.inf))  # live until a centroid moves
            yield _with(batch, {"cluster": near.astype(np.int32), "key": key})

    return vectors.mapInArrow(run, "vec_id long, v array<long>, was int, cluster int, key double")


def _heap(scanned: DataFrame) -> DataFrame:
    """A stored table in which every file is sorted by (cluster, key)."""
    return cut_lineage(scanned.sortWithinPartitions("cluster", "key"))


def _sums(moves: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By cluster, the count of its vectors and the sums of their components; `sign` is 1
    for a vector that enters the cluster and -1 for one that leaves. Batches are added up
    in their tasks, so a task sends one number for each cluster and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, sign, cluster = _matrix(batch.column("v")), batch.column("sign").to_numpy(), batch.column("cluster").to_numpy()
            if len(x) and int(np.abs(x).max()) * len(x) >= 1 << 62:
                x = x.astype(object)
            for c in np.unique(cluster):
                own = np.flatnonzero(cluster == c)
                sums = [sign[own].sum(), *(x[own] * sign[own, None]).sum(axis=0)]
                places = np.arange(len(sums), dtype=np.int32)
                columns = [np.full(len(sums), c, dtype=np.int32), places, [str(n) for n in sums]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "place", "s"])

    parts = moves.mapInArrow(run, "cluster int, place int, s string")
    rows = parts.groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found: dict[int, dict[int, int]] = {}
    for r in rows:
        found.setdefault(r.cluster, {})[r.place] = int(r.s)
    return {c: (v[0], [v[i] for i in range(1, len(v))]) for c, v in found.items()}


@dataclass
class Clusters:
    centroids: list[list[int]]
    heaps: list[DataFrame]
    drift: list[float]  # gathered so far, by cluster
    popped: list[int]  # vectors scanned in each round


def _moved(old: list[list[int]], new: list[list[int]]) -> list[float]:
    """How far the gap of each cluster's vectors can shrink: its own centroid's way and the
    longest way of another."""
    ways = [float(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) ** 0.5 for p, q in zip(old, new, strict=True)]
    ways = [w * (1 + MARGIN) + (MARGIN if w else 0.0) for w in ways]
    return [w + max([x for j, x in enumerate(ways) if j != i], default=0.0) for i, w in enumerate(ways)]


def live(heap: DataFrame, drift: list[float]) -> DataFrame:
    """The rows of a heap that no round has popped yet."""
    return heap.where(reduce(Column.__or__, [(F.col("cluster") == i) & (F.col("key") > d) for i, d in enumerate(drift)]))


def expired(heap: DataFrame, before: list[float], now: list[float]) -> DataFrame:
    """The rows that come off the heap while drift grows from `before` to `now`."""
    ranges = [(F.col("cluster") == i) & (F.col("key") > a) & (F.col("key") <= b) for i, (a, b) in enumerate(zip(before, now, strict=True)) if b > a]
    return heap.where(reduce(Column.__or__, ranges)) if ranges else heap.limit(0)


def fit(kept: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> Clusters | None:
    """`rounds` rounds from (vec_id, v), and the assignment after them; None without vectors."""
    start = first_centroids(kept, k, seed)
    if not start:
        return None
    nothing = [float("-inf")] * len(start)
    state = Clusters(start, [_heap(scan(kept.withColumn("was", F.lit(None).cast("int")), start, [0.0] * len(start)))], nothing, [])
    entering = state.heaps[0].select("cluster", "v", F.lit(1).alias("sign"))
    totals = {i: (0, [0] * dimensions) for i in range(len(start))}
    drift = [0.0] * len(start)
    for _ in range(rounds):
        for i, (n, s) in _sums(entering).items():
            totals[i] = (totals[i][0] + n, [a + b for a, b in zip(totals[i][1], s, strict=True)])
        after = [[s // n for s in sums] if n else state.centroids[i] for i, (n, sums) in sorted(totals.items())]
        grown = [d + m for d, m in zip(drift, _moved(state.centroids, after), strict=True)]
        # What expires: keys up to the drift gathered now, of rows that were still live.
        popped = reduce(DataFrame.union, [expired(h, state.drift, grown) for h in state.heaps])
        rescanned = _heap(scan(popped.select("vec_id", "v", F.col("cluster").alias("was")), after, grown))
        changed = rescanned.where("cluster <> was")
        entering = changed.select("cluster", "v", F.lit(1).alias("sign")).union(changed.select("was", "v", F.lit(-1)))
        state.centroids, state.drift, drift = after, grown, grown
        state.heaps.append(rescanned)
        state.popped.append(rescanned.count())
    return state


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row for each kept row of `vectors` (vec_id, embedding): vec_id, cluster, distance
    (squared, to its centroid), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of other than 64 components, or with null, NaN or infinite ones give no
    row; an empty table gives none. Repeated rows and rows that share an id are vectors of
    their own; a null id stays. With fewer than `k` vectors there are as many clusters. Equal
    distances go to the smaller cluster number; an empty cluster's centroid stays. Distances
    and sums past 2^63 - 1 stand at that number. Other columns are not read."""
    state = fit(whole_vectors(vectors), k, rounds, seed)
    spark = vectors.sparkSession
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if state is None:
        return spark.createDataFrame([], names)
    centroids = state.centroids
    rows = reduce(DataFrame.union, [live(h, state.drift).select("vec_id", "v", "cluster") for h in state.heaps])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _matrix(batch.column("v")), batch.column("cluster").to_numpy()
            squares = np.zeros(len(own), dtype=object)
            for i in np.unique(own):
                squares[own == i] = _squares(x[own == i], [centroids[i]])[:, 0]
            whole = np.array([min(int(d), LARGEST) for d in squares], dtype=np.int64)
            yield _with(batch.select(["vec_id", "cluster"]), {"distance": whole})

    rows = cut_lineage(rows.mapInArrow(run, "vec_id long, cluster int, distance long"))
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    every = min(sum(sums.values()), LARGEST)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    table = [(i, min(s, LARGEST), every, digest(centroids[i])) for i, s in sums.items()]
    named = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
