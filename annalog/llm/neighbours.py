"""Approximate nearest neighbours by a forest of hash prefixes.

A tree is a sorted array of long hash strings, one bit for the side of each of `BITS`
random planes, so the vectors that share a prefix stand side by side. A query descends
every tree to its longest match and then goes up all trees together, one bit at a time,
until the prefixes it shares hold enough entries; their vectors are its candidates, and
these are scored exactly.

The vectors are dealt by a hash of their id to shards of bounded size, each with a forest
of its own, and the queries are a stated set that visits every shard in blocks. A task
holds one shard and one block, whatever the table's size; each shard returns its best
`top`, and the best of these are the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 4_096  # vectors
BLOCK = 2_048  # queries
TREES = 80
BITS = 32
SHARE = 0.5  # entries, over all trees, against the vectors of the shard
LEAST = 100  # times `top`: entries that a small shard's prefixes must hold
SEED = 20_240


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.vectors = vectors
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * BITS))
        codes = self.codes(vectors)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Hash strings as numbers, the first bit highest: (tree, vector)."""
        sides = (vectors @ self.planes > 0).reshape(len(vectors), -1, BITS)
        return (sides @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).T

    def ranges(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """In each tree, where the entries stand that share the first `length` bits."""
        low = codes >> (BITS - length) << (BITS - length)
        high = low + (1 << (BITS - length))
        at = [(np.searchsorted(s, a), np.searchsorted(s, b)) for s, a, b in zip(self.sorted, low, high, strict=True)]
        return np.array([a for a, _ in at]), np.array([b for _, b in at])

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the numbers of its candidates, in order."""
        codes = self.codes(queries)
        low, high = self.ranges(codes, BITS)
        open_ = np.arange(len(queries))
        for length in range(BITS, -1, -1):
            if not len(open_):
                break
            low[:, open_], high[:, open_] = self.ranges(codes[:, open_], length)
            held = (high[:, open_] - low[:, open_]).sum(axis=0)
            open_ = open_[held < enough]
        for q in range(len(queries)):
            hit = np.zeros(len(self.vectors), dtype=bool)
            for order, a, b in zip(self.order, low[:, q], high[:, q], strict=True):
                hit[order[a:b]] = True
            yield np.flatnonzero(hit)

    def search(self, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: int, share: float):
        """(query id, id, score) of each query's best candidates but itself, best first, ties
        to the smaller id. The products are summed alike for every vector, so equal vectors
        have equal scores."""
        enough = max(int(share * len(ids)), LEAST * top)
        out = []
        for q, query, found in zip(query_ids, queries, self.candidates(queries, enough), strict=True):
            found = found[ids[found] != q]
            rough = self.vectors[found] @ query
            if len(found) > top:
                kth = np.partition(rough, -top)[-top]
                found = found[rough >= kth - 1e-9 * (1 + abs(kth))]
            exact = (self.vectors[found] * query).sum(axis=1)
            best = np.lexsort((ids[found], -exact))[:top]
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[found][best], "score": exact[best]}))
        return out


def usable(vector: Column) -> Column:
    """Not null, not empty, all parts finite, one of them not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, top: int = 20, share: float = SHARE, trees: int = TREES
) -> DataFrame:
    """query_id, rank from 1, vec_id, score of the `top` candidates of the largest inner
    product for each row of `vectors` (vec_id, embedding) with `is_query`.

    Rows without id and unusable vectors take no part. Rows that share an id count once,
    with the smallest of their vectors. Vectors of different length do not meet. A query
    with fewer candidates gets all of them; other columns are not read."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = rows.where(is_query)
    counts = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = (max(1, -(-n // size)) for n, size in zip(counts, (SHARD, BLOCK), strict=True))

    def of(parts: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    dealt = rows.withColumn("shard", of(shards, 1)).withColumn("block", every(blocks))
    queries = asked.withColumn("block", of(blocks, 2)).withColumn("shard", every(shards))

    def search(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if own.empty or held.empty:
            return none
        forest = Forest(np.stack(held["v"].to_list()).astype(float), trees)
        found = forest.search(
            held["vec_id"].to_numpy(), own["vec_id"].to_numpy(), np.stack(own["v"].to_list()).astype(float), top, share
        )
        return pd.concat(found) if found else none

    key = ["dim", "shard", "block"]
    best = queries.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(
        search, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
